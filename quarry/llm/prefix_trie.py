"""Conversation prefix trie: every distinct sequence of first turns, with the conversations under it.

Each prefix of a conversation has one digest: running sums of hashes of (place, turn), so that
even a very long conversation is summed up in pieces (``ordered.running``).  A count-min sketch
over all prefix digests screens them: an estimate of one proves that no other conversation has
the prefix.  Such tails are complete where they lie and are emitted there; only prefixes that may
be shared are shuffled for exact grouping.  No step goes through the trie level by level:

* every node belongs to its smallest member; along one conversation those nodes are a stretch at
  its end, so one depth a conversation tells which nodes are its own;
* a subtree's leaves are the members whose last node is their own and childless, and its saved
  words are what each member repeats of others' nodes at or below the depth, a difference of two
  running sums; both are plain sums over the members of a node.

The sketch is of bounded size (``MAX_WIDTH`` counters in each of ``ROWS``, one byte each); past
some tens of millions of prefixes more estimates exceed one and more rows are shuffled, with the
same result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from quarry.llm.common import stored
from quarry.llm.ordered import running, streamed_sha256

#: The sketch: rows of counters, and the least and most counters in each.
ROWS, MIN_WIDTH, MAX_WIDTH = 3, 1 << 12, 1 << 24
#: Counters of one piece of a sketch while it is put together.
_CHUNK = 1 << 16
#: Conversations whose number is a multiple of this lend their first turns to those up to the next.
BASE = 20
_WORD = "[^\\x20\\x09-\\x0D]+"
_LOW = (1 << 31) - 1
_NO_ENDS = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"  # SHA-256 of nothing


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, turn_digest, words) of every row with a conversation, places from 1 by turn,
    null turns first; rows of one turn are ordered by the digest of role and text.  Null role or
    text is empty; rows without conv_id are left out."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("turn_digest"),
        F.size(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))).cast("long").alias("words"),
    )
    same = rows.groupBy("conv_id", "turn", "turn_digest").agg(F.first("words").alias("words"), F.count(F.lit(1)).alias("n"))
    placed = running(same, "conv_id", ["turn", "turn_digest"], {"before": "n"})
    runs = placed.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(1 << 16).cast("long"))).alias("_q_from"))
    each = F.sequence(F.col("_q_from"), F.least(F.col("n"), F.col("_q_from") + (1 << 16)) - 1)
    return runs.select("conv_id", "turn_digest", "words", "before", F.explode(each).alias("_q_k")).select(
        "conv_id", (F.col("before") + F.col("_q_k") + 1).alias("place"), "turn_digest", "words"
    )


def rebuilt(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations c with the first h turns of c - c % 20 in place of their own first h,
    h = crc32(c) % 4, as (conversations: conv_id, length) and (rows: conv_id, length, depth, turn_digest, words)."""
    lengths = own.groupBy("conv_id").agg(F.max("place").alias("n"))
    c = F.col("conv_id")
    heads = F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(4))
    lent = lengths.filter(c % BASE == 0).select(c.alias("base"), F.col("n").alias("base_n"))
    known = lengths.select("conv_id", "n", heads.alias("h"), (c - c % BASE).alias("base")).join(lent, "base", "left")
    known = known.withColumn("lent", F.least("h", F.coalesce("base_n", F.lit(0))))
    known = stored(known.select("conv_id", "base", "h", "lent", (F.col("lent") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")))
    first = own.filter((F.col("place") <= 3) & (c % BASE == 0)).withColumnRenamed("conv_id", "base")
    from_base = known.filter("lent > 0").join(first, "base").filter("place <= lent").withColumnRenamed("place", "depth")
    from_own = own.join(known, "conv_id").filter("place > h").withColumn("depth", F.col("place") - F.col("h") + F.col("lent"))
    cols = ("conv_id", "length", "depth", "turn_digest", "words")
    return known.select("conv_id", "length"), from_base.select(*cols).unionAll(from_own.select(*cols))


def _key(depth: Column, sums: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", depth.cast("string"), *(s.cast("string") for s in sums))))


def prefixes(rows: DataFrame) -> DataFrame:
    """(conv_id, length, depth, words, upto, key, parent): each prefix with its 128-bit key, its
    parent's key, the words of its last turn and of all its turns."""
    a, b = F.xxhash64("depth", "turn_digest"), F.xxhash64(F.lit(7), "turn_digest", "depth")
    lanes = [F.shiftrightunsigned(a, 33), a.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(b, 33), b.bitwiseAND(F.lit(_LOW))]
    rows = rows.select("*", *(x.cast("long").alias(f"_q_x{i}") for i, x in enumerate(lanes)))
    summed = running(rows, "conv_id", ["depth"], {"before": "words"} | {f"_q_s{i}": f"_q_x{i}" for i in range(len(lanes))})
    past = [F.col(f"_q_s{i}") for i in range(len(lanes))]
    return stored(
        summed.select(
            "conv_id", "length", "depth", "words", (F.col("before") + F.col("words")).alias("upto"),
            _key(F.col("depth"), [p + F.col(f"_q_x{i}") for i, p in enumerate(past)]).alias("key"),
            _key(F.col("depth") - 1, past).alias("parent"),
        )
    )


def _places(keys: pa.Array, width: int) -> np.ndarray:
    """The counters of 16-byte keys: one column a row of the sketch."""
    raw = np.frombuffer(b"".join(keys.to_pylist()), "<u4").reshape(-1, 4)
    return raw[:, :ROWS] & np.uint32(width - 1)


def sketch(keys: DataFrame, width: int) -> np.ndarray:
    """Count-min counters (ROWS, width) of the column ``key``, held at two: all that the screen asks."""
    per_row = max(1, width // _CHUNK)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros((ROWS, width), np.uint8)
        for batch in batches:
            if batch.num_rows:
                at = _places(batch.column(0), width)
                for r in range(ROWS):
                    some, times = np.unique(at[:, r], return_counts=True)
                    counters[r, some] = np.minimum(counters[r, some] + np.minimum(times, 2), 2)
        for r in range(ROWS):
            for k in range(per_row):
                part = counters[r, k * _CHUNK : (k + 1) * _CHUNK]
                if part.any():
                    yield pa.RecordBatch.from_arrays([pa.array([r * per_row + k]), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names=["chunk", "counters"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(zlib.decompress(packed), np.uint8)
                held[chunk] = np.minimum(held[chunk] + part, 2) if chunk in held else part
        for chunk, part in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names=["chunk", "counters"])

    schema = "chunk long, counters binary"
    parts = keys.select("key").mapInArrow(count, schema)
    # first by task group and chunk, then by chunk: no merge sees all tasks of a large job
    parts = parts.repartition(F.pmod(F.xxhash64("counters"), F.lit(32)), "chunk").mapInArrow(merged, schema)
    parts = parts.repartition("chunk").mapInArrow(merged, schema)
    out = np.zeros((ROWS, per_row, min(width, _CHUNK)), np.uint8)
    for row in parts.collect():  # ROWS * width bytes at most, by the bound of the width
        r, k = divmod(row["chunk"], per_row)
        out[r, k] = np.minimum(out[r, k] + np.frombuffer(zlib.decompress(row["counters"]), np.uint8), 2)
    return out.reshape(ROWS, width)


def screened(rows: DataFrame, *, max_width: int = MAX_WIDTH) -> DataFrame:
    """``rows`` of ``prefixes`` with ``alone`` and ``parent_alone``: the sketch proves that the prefix,
    or the one above it, is in this conversation only."""
    width = MIN_WIDTH
    wanted = 4 * rows.count()
    while width < min(wanted, max_width):
        width *= 2
    counters = rows.sparkSession.sparkContext.broadcast(sketch(rows, width))  # ROWS * max_width bytes at most

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                alone = []
                for name in ("key", "parent"):
                    at = _places(batch.column(name), width)
                    alone.append(pa.array(np.min([counters.value[r, at[:, r]] for r in range(ROWS)], axis=0) == 1))
                yield pa.RecordBatch.from_arrays([*batch.columns, *alone], names=[*batch.schema.names, "alone", "parent_alone"])

    marked = rows.mapInArrow(mark, StructType([*rows.schema.fields, *(StructField(name, BooleanType()) for name in ("alone", "parent_alone"))]))
    # the root is no prefix of the sketch: what lies below it always asks the grouping
    return stored(marked.withColumn("parent_alone", F.col("parent_alone") & (F.col("depth") > 1)))


def nodes(conversations: DataFrame, *, max_width: int = MAX_WIDTH) -> DataFrame:
    """One row per node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.  The root has depth 0 and a null parent; an empty table has
    no conversation and so no node.  Repeated rows are repeated turns.  Only conv_id, turn, role and text are read."""
    known, rows = rebuilt(turns(conversations))
    rows = screened(prefixes(rows), max_width=max_width)
    last = F.col("depth") == F.col("length")
    shared = rows.filter(~F.col("alone"))
    root = _key(F.lit(0), [F.lit(0)] * 4)

    grouped = stored(
        shared.groupBy("key").agg(
            F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n_convs"), F.min("depth").alias("depth"), F.min("parent").alias("parent")
        )
    )
    kids = (
        grouped.select("parent").unionAll(rows.filter(F.col("alone") & ~F.col("parent_alone")).select("parent"))
        .groupBy("parent").agg(F.count(F.lit(1)).alias("n_children"))
    )
    kids = stored(kids)
    counted = stored(
        grouped.join(kids.withColumnRenamed("parent", "key"), "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    )

    # what each conversation repeats of others' nodes, and whether its last node is its own leaf
    member = shared.join(counted.select("key", "owner", "n_children"), "key")
    others = F.col("owner") != F.col("conv_id")
    each = stored(
        member.groupBy("conv_id").agg(
            F.coalesce(F.max(F.when(others, F.struct("depth", "upto")))["upto"], F.lit(0).cast("long")).alias("repeated"),
            F.max(last).alias("ends_here"),
            F.max(last & ~others & (F.col("n_children") == 0)).alias("own_leaf"),
        )
    )
    leaf = F.when(~F.col("ends_here") | F.col("own_leaf"), 1).otherwise(0).cast("long")
    sums = (
        shared.join(each, "conv_id").groupBy("key")
        .agg(F.sum(leaf).alias("n_leaves"), F.sum(F.greatest(F.col("repeated") - F.col("upto") + F.col("words"), F.lit(0).cast("long"))).alias("saved_tokens"))
    )
    ended = shared.filter(last).select("key", "conv_id").unionAll(known.filter("length = 0").select(root.alias("key"), "conv_id"))
    ends = stored(streamed_sha256(ended.withColumn("id", F.col("conv_id").cast("string")), "key", ["conv_id"], "id", b",").withColumnRenamed("sha256", "ends"))

    # the root, one row, from single figures
    one_of = lambda df, column: df.filter(F.col("key") == root).agg(F.max(column)).scalar()
    total = lambda column: F.coalesce(each.agg(F.sum(column)).scalar(), F.lit(0)).cast("long")
    top = known.agg(F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n_convs"), F.count(F.when(F.col("length") > 0, 1)).alias("filled")).filter("n_convs > 0")
    top_row = top.select(
        F.col("owner").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs",
        F.coalesce(one_of(kids.withColumnRenamed("parent", "key"), "n_children"), F.lit(0)).cast("long").alias("n_children"),
        F.greatest(F.col("filled") - total(1 - leaf), F.lit(1)).cast("long").alias("n_leaves"),
        total("repeated").alias("saved_tokens"), F.coalesce(one_of(ends, "ends"), F.lit(_NO_ENDS)).alias("ends_sha256"),
    )

    least = known.agg(F.min("conv_id").alias("least")).scalar()
    above = counted.select(F.col("key").alias("parent"), F.col("owner").alias("parent_owner"))
    inner = counted.join(sums, "key").join(ends, "key", "left").join(above, "parent", "left")
    inner_rows = inner.select(
        F.col("owner").alias("conv_id"), "depth",
        F.when(F.col("depth") == 1, least).otherwise(F.coalesce("parent_owner", "owner")).alias("parent_conv_id"),
        "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(_NO_ENDS)).alias("ends_sha256"),
    )
    tail = rows.filter("alone")
    starts = tail.filter(~F.col("parent_alone") & (F.col("depth") > 1)).join(above, "parent", "left").withColumn("parent_conv_id", F.coalesce("parent_owner", "conv_id"))
    rest = tail.filter(F.col("parent_alone") | (F.col("depth") == 1)).withColumn("parent_conv_id", F.when(F.col("depth") == 1, least).otherwise(F.col("conv_id")))
    cols = ("conv_id", "depth", "length", "parent_conv_id")
    one = F.lit(1).cast("long")
    tails = starts.select(*cols).unionAll(rest.select(*cols)).select(
        "conv_id", "depth", "parent_conv_id", one.alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"), one.alias("n_leaves"),
        F.lit(0).cast("long").alias("saved_tokens"), F.when(last, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(F.lit(_NO_ENDS)).alias("ends_sha256"),
    )
    return top_row.unionByName(inner_rows).unionByName(tails)
