"""CI exports (A10): pull requests and workflow runs as JSON lines, read with
explicit schemas (no inference), ready for ``operators.ci``.

A dump may hold lines that are no JSON or have a value of another type.  ``read_dump`` reads permissively and
gives the good rows and a table of the bad lines; ``read_prs`` and ``read_runs`` give the good rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PR_SCHEMA = T.StructType([
    T.StructField("number", T.LongType()), T.StructField("title", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("head", T.StructType([T.StructField("ref", T.StringType()), T.StructField("sha", T.StringType())])),
])
RUN_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("name", T.StringType()),
    T.StructField("head_branch", T.StringType()), T.StructField("status", T.StringType()),
    T.StructField("conclusion", T.StringType()), T.StructField("html_url", T.StringType()),
])


_BAD = "_corrupt_record"


def read_dump(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, bad): the rows of ``schema`` from JSON lines, and the lines that are not such rows as (file, line)."""
    full = T.StructType([*schema.fields, T.StructField(_BAD, T.StringType())])
    parsed = F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD})
    lines = spark.read.text(path).filter(F.trim("value") != "")
    read = lines.select("value", F.col("_metadata.file_name").alias("file"), parsed.alias("j"))
    return read.filter(F.col(f"j.{_BAD}").isNull()).select(*(F.col(f"j.{n}") for n in schema.names)), read.filter(F.col(f"j.{_BAD}").isNotNull()).select("file", F.col("value").alias("line"))


def pull_requests(dump: DataFrame) -> DataFrame:
    """``number, title, state, head_ref`` of ``PR_SCHEMA`` rows."""
    return dump.select("number", "title", "state", F.col("head.ref").alias("head_ref"))


def workflow_runs(dump: DataFrame) -> DataFrame:
    """``id, name, branch, status, conclusion, html_url`` of ``RUN_SCHEMA`` rows."""
    return dump.select("id", "name", F.col("head_branch").alias("branch"), "status", "conclusion", "html_url")


def read_prs(spark: SparkSession, path: str) -> DataFrame:
    """``number, title, state, head_ref`` from exported pull requests."""
    return pull_requests(read_dump(spark, path, PR_SCHEMA)[0])


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """``id, name, branch, status, conclusion, html_url`` from exported workflow runs."""
    return workflow_runs(read_dump(spark, path, RUN_SCHEMA)[0])
