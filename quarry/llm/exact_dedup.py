"""Exact deduplication by deterministic block naming.

A normalised text is cut into fixed-size byte blocks.  The distinct blocks are
sorted and numbered: each gets one integer name.  Then names of adjacent blocks
are paired, the distinct pairs are sorted and numbered in turn, and so on; every
level halves a document, until one name is left.  Two documents have the same
(level, name) exactly when their normalised texts are equal: a name stands for one
block or one pair, never for a hash bucket.

Only the distinct blocks travel with their bytes (map-side combined, so a block
shared by a third of all rows is one row per map task).  Occurrences find their
block's name by a digest that is *verified* to be injective on this corpus: if two
different blocks shared a digest, a longer digest is taken.  All joins back to the
occurrences are plain two-sided shuffles of narrow rows, which AQE splits when one
name is hot.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import cut, id_order

#: Bytes in a block.
BLOCK_BYTES = 4096

#: Characters that normalisation deletes: space and U+0009..U+000D.
BLANKS = " \t\n\x0b\x0c\r"


def sha(bits: int) -> Callable[[Column], Column]:
    return lambda block: F.unhex(F.sha2(block, bits))


DIGESTS = (sha(256), sha(512))


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def _number(distinct: DataFrame, order: Sequence[str]) -> DataFrame:
    """Integer names for distinct rows, increasing in sorted order within each shuffle partition."""
    return distinct.sortWithinPartitions(*order).withColumn("_q_name", F.monotonically_increasing_id())


def _block_names(blocks: DataFrame, digests: Sequence[Callable[[Column], Column]]) -> tuple[DataFrame, Callable]:
    for digest in digests:
        named = cut(_number(blocks.select("_q_block").distinct(), ["_q_block"]).select(digest(F.col("_q_block")).alias("_q_d"), "_q_name"))
        if named.groupBy("_q_d").count().filter("count > 1").limit(1).count() == 0:
            return named, digest
    raise RuntimeError("two different blocks share every digest given")


def identities(
    docs: DataFrame, *, block_bytes: int = BLOCK_BYTES, digests: Sequence[Callable[[Column], Column]] = DIGESTS
) -> DataFrame:
    """``(_q_key, _q_level, _q_name)``: the identity of each document's normalised
    text; ``_q_key`` = struct(doc_id, sha-256 of the normalised text)."""
    norm = normalised(F.col("text"))
    rows = docs.select(
        F.struct(F.col("doc_id"), F.unhex(F.sha2(norm, 256)).alias("sha")).alias("_q_key"), F.encode(norm, "UTF-8").alias("_q_bytes")
    )
    n = F.greatest(F.lit(1), F.ceil(F.length("_q_bytes") / F.lit(block_bytes)).cast("int"))
    cutting = F.transform(
        F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col("_q_bytes"), i * block_bytes + 1, F.lit(block_bytes))
    )
    blocks = rows.select("_q_key", n.alias("_q_n"), F.posexplode(cutting).alias("_q_pos", "_q_block"))
    names, digest = _block_names(blocks, digests)
    level = cut(
        blocks.select("_q_key", "_q_n", "_q_pos", digest(F.col("_q_block")).alias("_q_d"))
        .join(names, "_q_d")
        .select("_q_key", "_q_n", "_q_pos", "_q_name")
    )
    done = [level.filter("_q_n = 1").select("_q_key", F.lit(0).alias("_q_level"), "_q_name")]
    level, depth = level.filter("_q_n > 1"), 0
    while level.limit(1).count():
        depth += 1
        odd = F.col("_q_pos") % 2 == 1
        pairs = cut(
            level.groupBy("_q_key", F.floor(F.col("_q_pos") / 2).cast("int").alias("_q_pos"))
            .agg(
                F.ceil(F.max("_q_n") / 2).cast("int").alias("_q_n"),
                F.max(F.when(~odd, F.col("_q_name"))).alias("_q_l"),
                F.coalesce(F.max(F.when(odd, F.col("_q_name"))), F.lit(-1)).alias("_q_r"),
            )
        )
        names = _number(pairs.select("_q_l", "_q_r").distinct(), ["_q_l", "_q_r"])
        level = cut(pairs.join(names, ["_q_l", "_q_r"]).select("_q_key", "_q_n", "_q_pos", "_q_name"))
        done.append(level.filter("_q_n = 1").select("_q_key", F.lit(depth).alias("_q_level"), "_q_name"))
        level = level.filter("_q_n > 1")
    out = done[0]
    for more in done[1:]:
        out = out.unionAll(more)
    return out


def groups(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deleting blanks (space, U+0009..U+000D);
    of equal texts the one with the most code points in the original stays, then
    the smallest doc_id (a null id is the largest).  Null text counts as empty, and
    all empty texts are one group.  Rows repeated with one doc_id each count in
    ``group_size`` and share ``kept``.  An empty table gives no rows.  Other columns
    of ``docs`` are not read.
    """
    docs = docs.select("doc_id", "text")
    key = F.struct(F.col("doc_id"), F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("sha")).alias("_q_key")
    names = identities(docs, **options).dropDuplicates(["_q_key"])
    rows = cut(
        docs.select(key, F.coalesce(F.length("text"), F.lit(0)).alias("_q_len")).join(names, "_q_key")
    )
    best = F.struct((-F.col("_q_len")).alias("l"), id_order("_q_key.doc_id").alias("o"), F.col("_q_key.doc_id").alias("id"))
    tops = cut(rows.groupBy("_q_level", "_q_name").agg(F.count(F.lit(1)).alias("group_size"), F.min(best).alias("_q_best")))
    return rows.join(tops, ["_q_level", "_q_name"]).select(
        F.col("_q_key.doc_id").alias("doc_id"),
        F.col("_q_best.id").alias("keep_id"),
        "group_size",
        (F.col("_q_key.doc_id").eqNullSafe(F.col("_q_best.id"))).alias("kept"),
        F.lower(F.hex("_q_key.sha")).alias("text_sha256"),
    )


def dedup(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that an equal text replaces; all columns are kept.  Rows are told apart by
    doc_id and text: rows that share an id with different texts are judged each for itself, and of rows that
    share the id and the text that stays the longest original comes once (of equal originals any one)."""
    sha = F.unhex(F.sha2(normalised(F.col("text")), 256))
    kept = groups(docs, **options).filter("kept").select(F.col("doc_id").alias("_q_id"), F.unhex("text_sha256").alias("_q_kept_sha")).distinct()
    rows = docs.withColumns({"_q_sha": sha, "_q_rank": F.struct(F.coalesce(F.length("text"), F.lit(0)).alias("l"), F.xxhash64("text").alias("x"))})
    rows = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("_q_id")) & (F.col("_q_sha") == F.col("_q_kept_sha")), "left_semi")
    best = rows.groupBy(F.col("doc_id").alias("_q_id"), F.col("_q_sha").alias("_q_kept_sha")).agg(F.max("_q_rank").alias("_q_best"))
    best_here = F.col("doc_id").eqNullSafe(F.col("_q_id")) & (F.col("_q_sha") == F.col("_q_kept_sha")) & (F.col("_q_rank") == F.col("_q_best"))
    return rows.join(best, best_here, "left_semi").dropDuplicates(["doc_id", "_q_sha"]).select(*docs.columns)
