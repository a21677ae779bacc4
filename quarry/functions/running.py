"""Running sums along groups of any length.

Rows are dealt by range of (group, order) and written, so a group of any size lies in as many
stretches as it needs.  Sums inside a stretch are a window over (stretch, group); only the groups that
cross a border between two stretches, at most one a border, are joined to the sums before them.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.session import scratch_path


def running_sums(df: DataFrame, group: Sequence[str], order: Sequence[str], sums: Mapping[str, str]) -> DataFrame:
    """``df`` with, for each ``{new: column}`` of ``sums``, the sum of the long ``column`` over the rows
    before in the same group, in ascending ``order`` (nulls first).  Group columns hold no nulls;
    rows of equal order come in any order, so callers make it total."""
    group, new = list(group), list(sums)
    path = scratch_path(df.sparkSession, f"ordered-{uuid.uuid4().hex}")
    dealt = df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    dealt.withColumns({"_r_at": F.monotonically_increasing_id(), "_r_piece": F.spark_partition_id()}).write.parquet(path)
    rows = df.sparkSession.read.schema(T.StructType([*df.schema.fields, T.StructField("_r_at", T.LongType()), T.StructField("_r_piece", T.IntegerType())])).parquet(path)
    local = Window.partitionBy("_r_piece", *group).orderBy("_r_at").rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumns({n: F.coalesce(F.sum(c).over(local), F.lit(0).cast("long")) for n, c in sums.items()})
    ends = rows.groupBy("_r_piece").agg(F.min(F.struct(*group)).alias("a"), F.max(F.struct(*group)).alias("b"))
    ends = ends.select(F.explode(F.array("a", "b")).alias("g")).select("g.*").distinct()  # two rows a stretch at most
    pieces = rows.join(F.broadcast(ends), group, "left_semi").groupBy(*group, "_r_piece").agg(*(F.sum(c).alias(f"_r_{n}") for n, c in sums.items()))
    past = Window.partitionBy(*group).orderBy("_r_piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(*group, "_r_piece", *(F.coalesce(F.sum(f"_r_{n}").over(past), F.lit(0).cast("long")).alias(f"_r_{n}") for n in new))
    joined = inside.join(F.broadcast(pieces), [*group, "_r_piece"], "left")
    return joined.select(*df.columns, *((F.col(n) + F.coalesce(f"_r_{n}", F.lit(0).cast("long"))).alias(n) for n in new))


def text_chunks(df: DataFrame, group: Sequence[str], order: Sequence[str], text: str, *, max_bytes: int, lead: str | None = None) -> DataFrame:
    """(group, chunk, n_items, text): the texts of each group in order, cut into chunks that begin every
    ``max_bytes`` bytes; a chunk ends with the item that passes its bound, so no row grows with the group.  The
    chunks in order put together are the group's text.  ``lead``: a column that stands before the first item."""
    rows = df.select(*group, *order, F.col(text).alias("_t_text"), *([F.col(lead).alias("_t_lead")] if lead else []))
    rows = rows.withColumns({"_t_bytes": F.octet_length("_t_text").cast("long"), "_t_one": F.lit(1).cast("long")})
    told = running_sums(rows, group, order, {"_t_from": "_t_bytes", "_t_n": "_t_one"})
    item = F.when(F.col("_t_n") == 0, F.concat("_t_lead", "_t_text")).otherwise(F.col("_t_text")) if lead else F.col("_t_text")
    chunk = F.floor(F.col("_t_from") / F.lit(max_bytes)).cast("int")
    parts = told.select(*group, chunk.alias("chunk"), F.struct("_t_n", item.alias("t")).alias("_t_item"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("_t_item")), lambda x: x["t"]), "")
    return parts.groupBy(*group, "chunk").agg(F.count(F.lit(1)).alias("n_items"), body.alias("text"))
