"""Size guards for broadcasts.

A side is broadcast only after a bounded count proves it small; beyond the bound
the plain DataFrame is returned and Spark (with AQE) picks a shuffle join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def row_count_at_most(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` has at most ``max_rows`` rows (reads at most max_rows + 1)."""
    return df.limit(max_rows + 1).count() <= max_rows


def guarded_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """``broadcast(df)`` when it is proven to hold at most ``max_rows`` rows."""
    return F.broadcast(df) if row_count_at_most(df, max_rows) else df


def spread(df: DataFrame, *cols: str, partitions: int | None = None) -> DataFrame:
    """``df`` dealt over ``partitions`` (default: the session's shuffle partitions), by
    ``cols`` where given.  Always an exchange in the plan, whatever the input's size:
    for inputs stored in few row groups before expensive per-row work.  Later
    aggregations keyed by a superset of ``cols`` need no further shuffle."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *cols)
