"""Line deduplication by overlapping three-line windows.

Every three consecutive lines of a document are hashed (the windows overlap by two
lines).  Windows that occur more than once in the corpus are found by a map-side
combined count; the first occurrence in (doc_id, line) order stays, and every line
covered by a later one goes.  Covered positions are merged per document, so a run of
repeated windows is one removed block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import cut, id_order

#: Lines in a window.
LINES = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def windows(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """One row per window: ``_q_row`` (order, doc_id, digest of the text), ``_q_at`` (first line) and its 128-bit hash."""
    rows = docs.filter(F.col("text").isNotNull()).select(
        F.struct(id_order().alias("o"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("x")).alias("_q_row"), _lines(F.col("text")).alias("_q_lines")
    )
    last = F.size("_q_lines") - lines
    hashes = F.transform(
        F.sequence(F.lit(1), last + 1), lambda i: F.unhex(F.md5(F.array_join(F.slice(F.col("_q_lines"), i, F.lit(lines)), "\n")))
    )
    return rows.filter(last >= 0).select("_q_row", F.posexplode(hashes).alias("_q_at", "_q_w"))


def covered(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """(_q_row, _q_starts): sorted first lines of the windows to remove, per document that has any."""
    every = windows(docs, lines)
    place = F.struct("_q_row", "_q_at")
    repeated = cut(
        every.groupBy("_q_w").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("_q_first")).filter("n > 1").select("_q_w", "_q_first")
    )
    later = every.join(repeated, "_q_w").filter(place > F.col("_q_first"))
    return later.groupBy("_q_row").agg(F.sort_array(F.collect_set("_q_at")).alias("_q_starts"))


def clean(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """``docs`` with ``text`` freed of covered lines, plus ``n_lines`` and ``n_removed`` (for a table that
    has columns of these names ``n_lines_before`` and ``n_lines_removed``, and so on with more underscores).

    A line is what lies between ``\\n`` characters, unchanged; an empty text is one
    empty line, a null text stays null and has none.  Documents of fewer than three
    lines keep them.  Order is doc_id (null ids last), then a hash of the text for
    rows that share an id, then line; rows equal in both id and text count as one
    place and are all cleaned alike.  All columns of ``docs`` are kept."""
    marks = covered(docs, lines)
    row = F.struct(id_order().alias("o"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("x"))
    starts = F.coalesce(F.col("_q_starts"), F.array().cast("array<int>"))
    gone = F.array_distinct(F.flatten(F.transform(starts, lambda s: F.sequence(s, s + (lines - 1)))))
    split = docs.withColumn("_q_row", row).join(marks, "_q_row", "left").withColumns({"_q_lines": _lines(F.col("text")), "_q_gone": gone})
    kept = F.when(F.size("_q_gone") == 0, F.col("text")).otherwise(
        F.array_join(
            F.transform(
                F.array_except(F.sequence(F.lit(0), F.size("_q_lines") - 1), F.col("_q_gone")), lambda i: F.element_at(F.col("_q_lines"), i + 1)
            ),
            "\n",
        )
    )
    n_lines, n_removed = "n_lines", "n_removed"
    if {n_lines, n_removed} & set(docs.columns):
        n_lines, n_removed = "n_lines_before", "n_lines_removed"
    while {n_lines, n_removed} & set(docs.columns):
        n_lines, n_removed = n_lines + "_", n_removed + "_"
    return split.select(
        *(kept.alias("text") if c == "text" else F.col(c) for c in docs.columns),
        F.when(F.col("text").isNull(), 0).otherwise(F.size("_q_lines")).cast("long").alias(n_lines), F.size("_q_gone").cast("long").alias(n_removed),
    )


def report(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 (of the kept lines joined by ``\\n``; null text counts as empty)."""
    return clean(docs.select("doc_id", "text"), lines).select(
        "doc_id", "n_lines", "n_removed", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("kept_sha256")
    )
