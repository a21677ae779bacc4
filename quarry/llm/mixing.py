"""Mixing sources to target weights with hash-threshold histograms.

Each document gets a fixed hash of 60 bits.  Per source the words are summed by the
leading hash bits; the running sum finds the bucket in which the source's budget
ends.  Only that bucket is summed again by its next bits, level by level, until the
threshold is exact.  Documents below their source's threshold are taken: a filter,
no sort of documents, and larger budgets take supersets of smaller ones.

A source's budget may exceed its size: every document is then taken whole copies
first, and the threshold decides who gets one copy more.  Histograms are
partial sums (at most 2^15 buckets a source and level), so a source with a third of
all rows is no burden.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import cut

#: Hash bits per level and number of levels.
BITS, LEVELS = 15, 4

#: Sources are given these weights in turn.
WEIGHTS = (5, 2, 1)

#: A target is at most so many times its source's size.
MAX_REPEAT = 3.0

#: Source tables of at most this many rows and characters are broadcast.
MAX_SOURCES, MAX_SOURCE_CHARS = 10_000, 1_000_000


def _with_size_and_hash(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text))
    return docs.withColumns({
        "_q_source": F.col("source").cast("string"),
        "_q_size": F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long"),
        "_q_h": F.conv(F.substring(digest, 1, BITS * LEVELS // 4), 16, 10).cast("long"),
    })


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words between blanks; null text 0) and a 60-bit hash of id and text."""
    return _with_size_and_hash(docs).select("doc_id", F.col("_q_source").alias("source"), F.col("_q_size").alias("size"), "_q_h")


def targets(by_source: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """Adds ``target`` to (source, source_size): shares of the total by weight, none
    above ``max_repeat`` times its source's size.  The uncapped targets are all
    level * weight, so the capped sources are the first ones by cap / weight."""
    turn = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    rows = by_source.withColumn("_q_w", weight).withColumn("_q_cap", F.col("source_size") * F.lit(float(max_repeat)))
    before = W.orderBy((F.col("_q_cap") / F.col("_q_w")), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    after = W.orderBy((F.col("_q_cap") / F.col("_q_w")), F.col("source").asc_nulls_last()).rowsBetween(0, W.unboundedFollowing)
    whole = W.partitionBy()
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("_q_cap").over(before), F.lit(0.0))
    rows = rows.withColumn("_q_level", left / F.sum("_q_w").over(after))
    fits = F.col("_q_level") * F.col("_q_w") <= F.col("_q_cap")
    level = F.max(F.when(fits, F.col("_q_level"))).over(whole)
    return rows.withColumn(
        "target", F.least(F.col("_q_cap"), F.coalesce(level * F.col("_q_w"), F.col("_q_cap")))
    ).select("source", "source_size", "target")


def _few(sources: DataFrame) -> bool:
    n, chars = sources.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("source")), F.lit(0))).first()
    return n <= MAX_SOURCES and chars <= MAX_SOURCE_CHARS


def thresholds(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, source_size, target, _q_copies, _q_t): take ``_q_copies`` of every
    document and one more of those with ``_q_h < _q_t``."""
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = F.floor(ratio).cast("int")
    state = cut(
        goals.withColumn("_q_copies", copies).select(
            "source", "source_size", "target", "_q_copies",
            (F.col("target") - F.col("_q_copies") * F.col("source_size")).alias("_q_left"), F.lit(0).cast("long").alias("_q_t"),
        )
    )
    few = _few(state)
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        bounds = state.select(F.col("source").alias("s"), "_q_t")
        histogram = (
            rows
            .join(F.broadcast(bounds) if few else bounds,
                  F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("_q_h", shift + BITS) == F.shiftright("_q_t", shift + BITS)))
            .groupBy("source", F.shiftright("_q_h", shift).alias("_q_b"))
            .agg(F.sum("size").alias("_q_words"))
        )
        running = F.sum("_q_words").over(W.partitionBy("source").orderBy("_q_b"))
        ends = (
            histogram.withColumn("_q_run", running)
            .join(state.select(F.col("source").alias("s"), "_q_left"), F.col("source").eqNullSafe(F.col("s")))
            .filter(F.col("_q_run") > F.col("_q_left"))
            .groupBy("s")
            .agg(F.min(F.struct("_q_b", "_q_run", "_q_words")).alias("_q_end"))
        )
        # no bucket passes the budget: everything below here is taken, up to the end of the range
        full = F.shiftleft(F.shiftright("_q_t", shift + BITS) + 1, shift + BITS)
        last = level == LEVELS - 1
        over, under = F.col("_q_end._q_run") - F.col("_q_left"), F.col("_q_left") - (F.col("_q_end._q_run") - F.col("_q_end._q_words"))
        bucket = F.col("_q_end._q_b") + (F.when(over < under, 1).otherwise(0) if last else 0)
        state = cut(
            state.join(ends, F.col("source").eqNullSafe(F.col("s")), "left").select(
                "source", "source_size", "target", "_q_copies",
                F.when(F.col("_q_end").isNull(), F.lit(0.0)).otherwise(under).alias("_q_left"),
                F.when(F.col("_q_end").isNull(), full).otherwise(F.shiftleft(bucket, shift)).alias("_q_t"),
            )
        )
    return state


def _plan(rows: DataFrame, weights: Sequence[float], max_repeat: float) -> DataFrame:
    by_source = cut(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    plan = thresholds(rows, targets(by_source, weights, max_repeat))
    side = plan.select(F.col("source").alias("_q_s"), "source_size", "target", "_q_copies", "_q_t")
    return F.broadcast(side) if _few(plan) else side


COPIES = "_q_copies + if(_q_h < _q_t, 1, 0)"


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, copies, taken.

    Null and empty texts have size 0 (their copies add no words); a null source is a
    source of its own, last in order.  Rows with the same id and text share one hash
    and fate.  A source's taken words differ from its target by less than the one
    document (or tied documents) at its threshold.  An empty table gives no rows.
    Reruns agree: the hash depends on id and text only."""
    rows = cut(sizes(docs))
    side = _plan(rows, weights, max_repeat)
    return rows.join(side, F.col("source").eqNullSafe(F.col("_q_s"))).select(
        "doc_id", "size", "source_size", "target", F.expr(COPIES).alias("copies"), F.expr(f"({COPIES}) * size").alias("taken")
    )


def take(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as the mix takes it, same columns."""
    side = _plan(cut(sizes(docs)), weights, max_repeat).select("_q_s", "_q_copies", "_q_t")
    return (
        _with_size_and_hash(docs)
        .join(side, F.col("_q_source").eqNullSafe(F.col("_q_s")))
        .withColumn("_q_n", F.expr(COPIES))
        .filter("_q_n > 0")
        .withColumn("_q_copy", F.explode(F.sequence(F.lit(1), F.col("_q_n"))))
        .select(*docs.columns)
    )
