"""File trees and document snapshots as DataFrames.

* ``read_tree``: every file below a root with Spark's ``binaryFile`` source
  (path, modification time, length, content), paths made relative to the root.
  Files that cannot be read are reported by Spark's ``ignoreCorruptFiles`` /
  ``ignoreMissingFiles`` settings, as the reference skips files whose stat fails.
  Spark's file scan skips zero-length files; a ``listing`` adds them.
* ``read_snapshot`` / ``write_snapshot``: the documents table as parquet
  partitioned by ``repository, context``; a scoped read prunes folders
  (``PartitionFilters``) and pushes the remaining predicates into the scan.
* ``read_scopes``: the rows of the scopes in a table, whose folders alone are read.
* ``write_bucketed`` / ``read_bucketed``: the documents table bucketed by its key, for syncs that
  exchange only their changes.
* ``read_documents_jdbc``: the documents table from a database, read in parallel
  ranges of ``id`` (no database exists in the test sandbox, so this path is not
  exercised by the tests).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.plans.guards import guarded_broadcast
from quarry.schemas import DOCUMENT, DOCUMENT_KEY

SCOPE = ("repository", "context")


def read_tree(spark: SparkSession, root: str, *, glob: str | None = None, with_content: bool = True,
              listing: DataFrame | None = None) -> DataFrame:
    """``path, modified_at, size[, content]`` for every file below ``root``.

    Spark's file scan does not report zero-length files.  ``listing`` (``path,
    modified_at``, relative paths, for instance from the version control's index) names all
    files: those the scan has not seen are added with size 0 and empty content, so
    that a later prune does not take them for deleted."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    df = r.load(root)
    base = root.rstrip("/")
    # binaryFile paths are URIs (file:/..., hdfs://...): strip everything up to the root.
    rel = F.regexp_replace(F.col("path"), r"^.*?" + _regex_escape(base.split(":", 1)[-1].lstrip("/")) + "/", "")
    cols = [rel.alias("path"), F.col("modificationTime").cast("timestamp_ntz").alias("modified_at"),
            F.col("length").alias("size")]
    if with_content:
        cols.append(F.col("content").cast("string").alias("content"))
    seen = df.select(*cols)
    if listing is None:
        return seen
    empty = listing.select("path", "modified_at").join(seen.select("path"), "path", "left_anti").withColumn("size", F.lit(0).cast("long"))
    return seen.unionByName(empty.withColumn("content", F.lit("")) if with_content else empty)


def _regex_escape(s: str) -> str:
    import re
    return re.escape(s)


def write_snapshot(df: DataFrame, path: str, *, partition_by: Sequence[str] = SCOPE) -> None:
    """Write a documents snapshot into a new folder, partitioned by scope."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def read_snapshot(spark: SparkSession, path: str, *, repository: str | None = None, context: str | None = None,
                  columns: Sequence[str] | None = None, where: Column | None = None) -> DataFrame:
    """Read a snapshot; scope arguments become partition filters, ``columns``
    narrows the scan (the embedding is only read when asked for)."""
    df = spark.read.schema(DOCUMENT).parquet(path)
    if repository is not None:
        df = df.filter(F.col("repository") == repository)
    if context is not None:
        df = df.filter(F.col("context") == context)
    if where is not None:
        df = df.filter(where)
    return df.select(*columns) if columns else df


def read_scopes(spark: SparkSession, path: str, scopes: DataFrame, *, columns: Sequence[str] | None = None, max_scopes: int = 100_000) -> DataFrame:
    """The rows of a snapshot whose (repository, context) is in the table ``scopes``.  The scopes' own filters
    run first and prune the snapshot's folders (dynamic partition pruning): only the asked ones are read."""
    # Spark plans the pruning only for a side that is filtered by some comparison; every scope meets this one
    known = scopes.select(*SCOPE).filter(F.octet_length("repository") >= 0).distinct()
    asked = guarded_broadcast(known, max_scopes)
    df = spark.read.schema(DOCUMENT).parquet(path).join(asked, list(SCOPE), "left_semi")
    return df.select(*columns) if columns else df


def write_bucketed(df: DataFrame, path: str, table: str, *, n_buckets: int = 64, key: Sequence[str] = DOCUMENT_KEY) -> DataFrame:
    """Write a snapshot bucketed and sorted by the document key as the external table ``table`` at ``path``, and
    read it.  Classify, prune and upsert against it exchange the changes only: the stored side lies
    dealt by the key already."""
    df.write.format("parquet").mode("overwrite").bucketBy(n_buckets, *key).sortBy(*key).option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)


def read_bucketed(spark: SparkSession, path: str, table: str, schema: T.StructType, *, n_buckets: int = 64, key: Sequence[str] = DOCUMENT_KEY) -> DataFrame:
    """A snapshot that ``write_bucketed`` has written, also from another session, whose catalog
    does not know the table yet."""
    if not spark.catalog.tableExists(table):
        cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        by = ", ".join(f"`{k}`" for k in key)
        spark.sql(f"CREATE TABLE `{table}` ({cols}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {n_buckets} BUCKETS LOCATION '{path}'")
    return spark.table(table)


def read_documents_jdbc(spark: SparkSession, url: str, *, table: str = "documents", properties: dict | None = None,
                        num_partitions: int = 64, lower_id: int = 0, upper_id: int = 1 << 40) -> DataFrame:
    """Parallel JDBC read of the documents table, split into id ranges."""
    return spark.read.jdbc(url, table, column="id", lowerBound=lower_id, upperBound=upper_id,
                           numPartitions=num_partitions, properties=properties or {})
