"""CI and repository metadata (K1-K4) over exported pull requests and workflow runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.paths import url_owner_repo
from quarry.operators.skew import salted_join


def runs_for_prs(prs: DataFrame, runs: DataFrame, *, heavy: list | None = None) -> DataFrame:
    """Runs on the head branch of each PR (K1; the reference filters by branch).  A branch such as main may
    hold a large part of all runs: its runs are dealt over many tasks (``skew.salted_join``)."""
    return salted_join(prs.select("number", "head_ref"), runs.withColumnRenamed("branch", "head_ref"), "head_ref", heavy=heavy)


def failed_runs(runs: DataFrame, logs: DataFrame) -> DataFrame:
    """Completed runs that failed, with their log URL; runs whose log lookup
    fails are skipped (K2)."""
    failed = runs.filter((F.col("status") == "completed") & (F.col("conclusion") == "failure"))
    return failed.join(logs.withColumnRenamed("run_id", "id"), "id", "inner")


def pr_listing(prs: DataFrame) -> DataFrame:
    """``#n title [state]`` per PR (K3)."""
    return prs.select("number", F.format_string("#%d %s [%s]", "number", "title", "state").alias("line"))


def owner_repo(df: DataFrame, url: str = "url") -> DataFrame:
    """``owner, repo`` from remote URLs (K4); fewer than two parts gives nulls
    plus an ``error`` text (the reference fails)."""
    o = url_owner_repo(F.col(url))
    return df.withColumn("owner", o["owner"]).withColumn("repo", o["repo"]).withColumn(
        "error", F.when(F.col("owner").isNull(), F.lit("invalid remote URL")))
