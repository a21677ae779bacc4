"""Helpers shared by the corpus operators.

Column conventions: a document table has ``doc_id`` (integer) and ``text``
(string); every other column is carried or ignored, whatever its name.  Internal
columns start with ``_q_`` so that they cannot clash with a caller's columns.
"""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import ensure_checkpoint_dir, scratch_path

#: Rows up to which a list of 64-bit ids may be broadcast (8 MB).
MAX_BROADCAST_IDS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and stored in the shared checkpoint folder, so that a
    lost executor costs a re-read and later plans start from files."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Like ``cut`` for large results: a compressed Parquet table in the shared folder."""
    path = scratch_path(df.sparkSession, f"table-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_order(col: str = "doc_id") -> Column:
    """Order of documents: by id, null ids last."""
    return F.coalesce(F.col(col).cast("long"), F.lit(2**63 - 1))


def crc_mod(col: str, mod: int) -> Column:
    """crc32 of the id's decimal text, modulo ``mod`` (a null id counts as empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def small_side(df: DataFrame, max_rows: int = MAX_BROADCAST_IDS) -> DataFrame:
    """``df`` (fixed-width columns only) hinted for broadcast when a count proves it
    has at most ``max_rows`` rows; otherwise unchanged, and Spark shuffles the join."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


#: What each operator remembers in a Python worker, by the operator's name.
_REMEMBERED: dict[str, Callable[[], None]] = {}


def remembers(owner: str, forget: Callable[[], None]) -> None:
    """Registers how to empty what ``owner`` remembers in a worker between tasks."""
    _REMEMBERED[owner] = forget


def only(owner: str) -> None:
    """Called as a task of ``owner`` begins: reused workers keep what modules remember, so
    what other operators left there is emptied and its memory given back."""
    for other, forget in _REMEMBERED.items():
        if other != owner:
            forget()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU C library: the allocator decides
        pass
