"""A bounded, repeatable sample of labelled documents for fitting a classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import crc_mod

#: Rows taken of each class, the longest text used for fitting, and the characters of all texts of a
#: class together.  They bound what the driver sees: 2 * TOTAL_CHARS.
ROWS_PER_CLASS, MAX_CHARS, TOTAL_CHARS = 2_000, 1 << 20, 8 << 20


def sample(
    docs: DataFrame, labels: DataFrame, label: str, *, held_out_mod: tuple[int, int],
    rows_per_class: int = ROWS_PER_CLASS, max_chars: int = MAX_CHARS, total_chars: int = TOTAL_CHARS,
) -> list[tuple[str, int]]:
    """(text, 0/1) of at most ``rows_per_class`` documents of each class, in hash order of the id, as
    far as their texts stay within ``total_chars``.  ``held_out_mod`` = (m, r): ids with crc32 mod m equal
    to r are never used.  Null labels, ids and texts and texts above ``max_chars`` are left out; an id
    labelled more than once takes its largest label, and of texts that share an id the one with the
    greatest hash is taken, so that the same tables always give the same sample."""
    m, r = held_out_mod
    known = (
        labels.select("doc_id", F.col(label).cast("int").alias("y"))
        .filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & (crc_mod("doc_id", m) != r))
        .groupBy("doc_id").agg(F.max("y").alias("y"))
    )
    ids = [known.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows_per_class) for y in (0, 1)]
    texts = docs.select("doc_id", "text").filter(F.length("text") <= max_chars)
    taken = (
        texts.join(F.broadcast(ids[0].unionAll(ids[1])), "doc_id")
        .groupBy("doc_id", "y").agg(F.max_by("text", F.struct(F.xxhash64("text"), F.length("text"))).alias("text"))
        .withColumn("h", F.xxhash64("doc_id"))
    )
    so_far = F.sum(F.length("text")).over(Window.partitionBy("y").orderBy("h", "doc_id"))  # at most rows_per_class rows each
    rows = taken.withColumn("chars", so_far).filter(F.col("chars") <= total_chars).select("text", "y", "h", "doc_id").collect()
    return [(row["text"], row["y"]) for row in sorted(rows, key=lambda x: (x["h"], x["doc_id"]))]
