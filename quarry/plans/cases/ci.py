"""CI queries (K1-K4) over runs and pull requests derived from ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import ci as CI
from quarry.plans.catalog import register
from quarry.plans.oracle import sql
from quarry.sources import ci as S
from quarry.sources import corpus as C
from quarry.sources.tables import read_table


@register("ci_runs_for_pr", sql(["ciprs", "ciruns"], """
    SELECT p.number, p.head_ref, r.id, r.name, r.status, r.conclusion, r.html_url
    FROM ciprs p JOIN ciruns r ON r.branch = p.head_ref"""))
def ci_runs_for_pr(spark, d):
    return CI.runs_for_prs(C.ci_prs(spark, d), C.ci_runs(spark, d)).select(
        "number", "head_ref", "id", "name", "status", "conclusion", "html_url")


def _dumps(spark, d):
    """Runs and pull requests written as an API dump's JSON lines; every run without a log is followed by a broken line."""
    import uuid

    from quarry.session import scratch_path
    out = scratch_path(spark, f"ci-dump-{uuid.uuid4().hex}")
    runs = C.ci_runs(spark, d).withColumnRenamed("branch", "head_branch")
    line = F.to_json(F.struct(*S.RUN_SCHEMA.names))
    cut = F.substring(line, F.lit(1), F.length(line) - 5)
    lines = runs.select(F.explode(F.when(F.col("name") == "purchase", F.array(line, cut)).otherwise(F.array(line))).alias("value"))
    lines.write.text(f"{out}/runs")
    prs = C.ci_prs(spark, d).withColumn("head", F.struct(F.col("head_ref").alias("ref"), F.lit("0").alias("sha")))
    prs.select(F.to_json(F.struct("number", "title", "state", "head")).alias("value")).write.text(f"{out}/prs")
    return out


@register("ci_dump_runs", sql(["ciprs", "ciruns"], """
    SELECT p.number, r.id, r.name, r.status, r.conclusion, r.html_url
    FROM ciprs p JOIN ciruns r ON r.branch = p.head_ref"""))
def ci_dump_runs(spark, d):
    """Runs of each pull request, both read from API dumps with broken lines among the runs."""
    out = _dumps(spark, d)
    return CI.runs_for_prs(S.read_prs(spark, f"{out}/prs"), S.read_runs(spark, f"{out}/runs")).drop("head_ref")


@register("ci_dump_bad_lines", sql(["ciruns"], """
    SELECT name, count(*) AS n_bad FROM ciruns WHERE name = 'purchase' GROUP BY name"""))
def ci_dump_bad_lines(spark, d):
    """How many lines of the dump could not be read, by the name that they begin with."""
    _, bad = S.read_dump(spark, f"{_dumps(spark, d)}/runs", S.RUN_SCHEMA)
    return bad.groupBy(F.regexp_extract("line", '"name":"([^"]*)"', 1).alias("name")).agg(F.count("*").alias("n_bad"))


@register("ci_failed_runs", sql(["ciruns", "cilogs"], """
    SELECT r.id, r.name, r.branch, r.html_url, l.logs_url
    FROM ciruns r JOIN cilogs l ON l.run_id = r.id WHERE r.status = 'completed' AND r.conclusion = 'failure'"""))
def ci_failed_runs(spark, d):
    return CI.failed_runs(C.ci_runs(spark, d), C.ci_logs(spark, d)).select(
        "id", "name", "branch", "html_url", "logs_url")


@register("pr_listing", sql(["ciprs"], "SELECT number, printf('#%d %s [%s]', number, title, state) AS line FROM ciprs"))
def pr_listing(spark, d):
    return CI.pr_listing(C.ci_prs(spark, d))


@register("url_owner_repo", sql([], r"""
    SELECT page_id, url,
           CASE WHEN len(string_split(regexp_replace(url, '\.git$', ''), '/')) >= 2
                THEN string_split(regexp_replace(url, '\.git$', ''), '/')[-2] END AS owner,
           CASE WHEN len(string_split(regexp_replace(url, '\.git$', ''), '/')) >= 2
                THEN string_split(regexp_replace(url, '\.git$', ''), '/')[-1] END AS repo,
           CASE WHEN len(string_split(regexp_replace(url, '\.git$', ''), '/')) < 2 THEN 'invalid remote URL' END
             AS error
    FROM pages"""))
def url_owner_repo(spark, d):
    return CI.owner_repo(read_table(spark, d, "pages", "page_id", "url"))
