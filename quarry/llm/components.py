"""Connected components of an edge table by alternating large and small stars.

Each step links nodes to the smallest neighbour; minima are map-side combined sums
and every join has two plain shuffled sides, so a node with very many edges is split
by AQE.  A few steps turn each component into one star around its smallest node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import cut


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component): every node that has an edge and the smallest node of its component.
    ``edges``: (u, v) longs in either direction, repeats and loops allowed."""
    edges = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = _print(edges)
    while seen[0]:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        edges = cut(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = cut(edges.groupBy("u").agg(F.min("v").alias("m")))
        moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct())
        now = _print(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return cut(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots))
