"""Joins on keys of which a few may hold much of the data.

``heavy_keys`` finds them with a frequent-items sketch (``approx_top_k``: one pass, partial sketches
merged, a bounded number of keys) and counts those few exactly.  ``salted_join`` deals the rows of each
heavy key over salts and repeats the other side's rows of that key for every salt; all other
rows join as they are.  The result is that of the plain join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that the sketch may report, and items it tracks.
MAX_HEAVY, TRACKED = 256, 4096


def heavy_keys(df: DataFrame, key: str, *, share: float = 0.01, max_keys: int = MAX_HEAVY) -> list:
    """The values of ``key`` that hold at least ``share`` of the rows, at most ``max_keys``, largest first."""
    if not df.limit(1).count():
        return []
    top = df.filter(F.col(key).isNotNull()).select(F.expr(f"approx_top_k(`{key}`, {max_keys}, {TRACKED})").alias("t"), F.count(F.lit(1)).alias("n")).first()
    asked = [r["item"] for r in top["t"] or [] if r["count"] >= share * top["n"]]
    if not asked:
        return []
    exact = df.filter(F.col(key).isin(asked)).groupBy(key).count().filter(F.col("count") >= share * top["n"]).orderBy(F.col("count").desc(), key)
    return [r[0] for r in exact.collect()]  # at most max_keys rows


def salted_join(small: DataFrame, big: DataFrame, key: str, *, heavy: list | None = None, salts: int = 64, how: str = "inner") -> DataFrame:
    """``small`` joined to ``big`` on ``key`` (``how``: inner, right: every row of ``big``, or left_semi: the rows of
    ``big`` with a match).  ``small`` has few rows a key; ``heavy`` defaults to the ``heavy_keys`` of ``big``."""
    if how not in ("inner", "right", "left_semi"):
        raise ValueError(f"unknown how {how!r}")
    hot = heavy_keys(big, key) if heavy is None else list(heavy)
    spread = lambda n: F.explode(F.when(F.col(key).isin(hot), F.sequence(F.lit(0), F.lit(n - 1))).otherwise(F.array(F.lit(0))))
    if not hot:
        return big.join(small.select(key).distinct(), key, "left_semi") if how == "left_semi" else small.join(big, key, how)
    # a row's salt comes from all its columns, so a task that is repeated deals it to the same place
    dealt = big.withColumn("_s_salt", F.when(F.col(key).isin(hot), F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int")).otherwise(F.lit(0)))
    if how == "left_semi":
        keys = small.select(key).distinct().withColumn("_s_salt", spread(salts))
        return dealt.join(keys, [key, "_s_salt"], "left_semi").select(*big.columns)
    return small.withColumn("_s_salt", spread(salts)).join(dealt, [key, "_s_salt"], how).drop("_s_salt")
