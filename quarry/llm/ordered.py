"""Running sums along groups of any length.

The rows are dealt by range of (group, order), so a group of any size spreads over as many
tasks as it needs; each task sums up its own stretch, and only the groups that cross a border
between two tasks, at most one a border, are joined to the sums of the stretches before."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quarry.llm.common import stored


def running(df: DataFrame, group: str, order: list[str], sums: dict[str, str]) -> DataFrame:
    """``df`` (stored) with, for each ``{new: column}`` of ``sums``, the sum of the long ``column``
    over the rows before in the same ``group``, in ascending ``order`` (nulls first).  ``group`` is
    a column without nulls.  Rows of equal order come in any order, so callers make it total."""
    new, old = list(sums), list(sums.values())

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, before = None, [0] * len(old)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            g = batch.column(group)
            starts = np.ones(n, bool)
            starts[0] = last is None or g[0].as_py() != last
            if n > 1:
                starts[1:] = pc.not_equal(g.slice(1), g.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            first = np.maximum.accumulate(np.where(starts, np.arange(n), -1))
            out = []
            for k, name in enumerate(old):
                v = batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64)
                excl = np.cumsum(v) - v
                own = np.where(first < 0, excl + before[k], excl - excl[np.maximum(first, 0)])
                before[k] = int(own[-1] + v[-1])
                out.append(pa.array(own))
            last = g[n - 1].as_py()
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], names=[*batch.schema.names, *new])

    dealt = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("_q_piece", F.spark_partition_id())
    rows = stored(dealt.mapInArrow(along, StructType([*dealt.schema.fields, *(StructField(name, LongType()) for name in new)])))
    ends = rows.groupBy("_q_piece").agg(F.min(group).alias("a"), F.max(group).alias("b"))
    ends = ends.select(F.explode(F.array("a", "b")).alias(group)).distinct()  # two rows a task at most
    pieces = rows.join(F.broadcast(ends), group, "left_semi").groupBy(group, "_q_piece").agg(*(F.sum(c).alias(f"_q_sum{k}") for k, c in enumerate(old)))
    past = Window.partitionBy(group).orderBy("_q_piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(group, "_q_piece", *(F.coalesce(F.sum(f"_q_sum{k}").over(past), F.lit(0)).alias(f"_q_past{k}") for k in range(len(old))))
    joined = rows.join(F.broadcast(pieces), [group, "_q_piece"], "left")
    return joined.select(*df.columns, *((F.col(c) + F.coalesce(f"_q_past{k}", F.lit(0))).alias(c) for k, c in enumerate(new)))


def streamed_sha256(df: DataFrame, group: str, order: list[str], line: str, separator: bytes) -> DataFrame:
    """(group, sha256): the lowercase hex digest of the strings ``line`` of each ``group``, in
    ``order`` and joined by ``separator``.  The digest is one chain over a whole group by its
    definition, so a group is read in one task, but as a stream: no text is put together."""
    import hashlib

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, h = None, None
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            done = []
            for i in range(batch.num_rows):
                k, raw = keys[i].as_py(), texts[i].as_buffer()
                if h is None or k != last:
                    if h is not None:
                        done.append((last, h.hexdigest()))
                    last, h = k, hashlib.sha256()
                else:
                    h.update(separator)
                h.update(raw)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], keys.type), pa.array([d[1] for d in done], pa.string())], names=[group, "sha256"])
        if h is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], kind), pa.array([h.hexdigest()])], names=[group, "sha256"])

    name = dict(df.dtypes)[group]
    kind = {"string": pa.string(), "binary": pa.binary(), "bigint": pa.int64()}[name]
    rows = df.select(group, line, *order).repartition(group).sortWithinPartitions(group, *order).select(group, line)
    return rows.mapInArrow(hashed, f"{group} {name}, sha256 string")
