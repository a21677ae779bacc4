"""Continuous load (C11): changed files arrive in micro-batches and go through classify and upsert
into a documents table kept in hash buckets, of which a batch rewrites only those it changes.

Layout below ``root``::

    changes/batch=B/          what batch B changes, summarised once (a replay writes it again)
    data/batch=B/bucket=K/    the rows of bucket K as of batch B, one version for each batch that changed it
    manifest/batch=B/         (bucket, version, n_rows, max_id): which version of each bucket holds after batch B

A batch reads the manifest before its own and the buckets it touches, writes new versions beside the
old ones and last its manifest, each into folders of its own name.  So a batch that is
repeated after a crash overwrites its own output and sees the same state again, readers keep a
consistent table, and files of other buckets are never written.  Folders of versions that no wanted
manifest lists may be removed at any time.

Per key the row with the greatest (modified_at, MD5 of the content) wins whatever the order of arrival: a file
that is older than what is stored is classified fresh, and empty files are skipped.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators import enrich as EN
from quarry.operators import sync as SY
from quarry.operators.load import default_summary

FILE = T.StructType([
    T.StructField("repository", T.StringType()), T.StructField("context", T.StringType()), T.StructField("filepath", T.StringType()),
    T.StructField("content", T.StringType()), T.StructField("modified_at", T.TimestampNTZType()),
])
STATE = T.StructType([
    T.StructField("id", T.LongType()), *FILE.fields[:3], T.StructField("description", T.StringType()), T.StructField("updated_at", T.TimestampNTZType()),
    T.StructField("content_digest", T.StringType()),
])
MANIFEST = T.StructType([
    T.StructField("bucket", T.IntegerType()), T.StructField("version", T.LongType()), T.StructField("n_rows", T.LongType()), T.StructField("max_id", T.LongType()),
])
#: Buckets of a new table; the manifest and every list of buckets have at most so many rows.
N_BUCKETS = 64


def bucket_of(n_buckets: int, key: Sequence[str] = SY.KEY) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(n_buckets)).cast("int")


def _manifests(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(T.StructType([*MANIFEST.fields, T.StructField("batch", T.LongType())])).parquet(f"{root}/manifest")


def manifest(spark: SparkSession, root: str, before: int | None = None) -> list:
    """The rows of the newest manifest (of those before a batch): one for each bucket that has rows."""
    from pyspark.errors import AnalysisException

    try:
        known = _manifests(spark, root)
    except AnalysisException:  # no batch has been written
        return []
    if before is not None:
        known = known.filter(F.col("batch") < before)
    last = known.agg(F.max("batch")).first()[0]
    return [] if last is None else known.filter(F.col("batch") == last).drop("batch").collect()


def _buckets(spark: SparkSession, root: str, rows: list) -> DataFrame:
    """The rows of the listed versions; only their folders are read."""
    if not rows:
        return spark.createDataFrame([], STATE)
    paths = [f"{root}/data/batch={r['version']}/bucket={r['bucket']}" for r in rows]
    return spark.read.schema(STATE).parquet(*paths)


def read_state(spark: SparkSession, root: str) -> DataFrame:
    """The documents table as of the newest batch."""
    return _buckets(spark, root, manifest(spark, root))


def apply_batch(
    spark: SparkSession, root: str, batch: DataFrame, batch_id: int, *, n_buckets: int = N_BUCKETS, summarize: Callable[[str], str] | None = None
) -> list[int]:
    """Load the changed files of one batch; the buckets that were rewritten, at most ``n_buckets``."""
    mine = bucket_of(n_buckets)
    listed = {r["bucket"]: r for r in manifest(spark, root, before=batch_id)}
    files = batch.select(*FILE.names, F.md5("content").alias("content_digest")).filter(F.length("content") > 0)
    files = SY.latest_per_key(files, ["modified_at", "content_digest"])
    touched = {r["bucket"] for r in batch.select(mine.alias("bucket")).distinct().collect()}
    state = _buckets(spark, root, [r for b, r in listed.items() if b in touched])
    # a file of the stored time is an update by C2; the greater digest settles it below, as inside a batch
    changed = SY.changed_content(SY.classify(state, files, keep_content=False), files).withColumn("content_digest", F.md5("content"))
    if summarize is None:
        described = changed.withColumn("description", default_summary(F.col("content"), F.col("filepath")))
    else:
        described, _failed = EN.split_errors(EN.enrich_batch(changed, summarize, input_col="content", output_col="description"))
        described = described.filter(F.length("description") > 0)
    described.select(mine.alias("bucket"), *SY.KEY, "description", F.col("modified_at").alias("updated_at"), "content_digest").write.mode("overwrite").parquet(f"{root}/changes/batch={batch_id}")
    changes = spark.read.schema(T.StructType([MANIFEST["bucket"], *STATE.fields[1:]])).parquet(f"{root}/changes/batch={batch_id}")
    rewritten = sorted(r["bucket"] for r in changes.select("bucket").distinct().collect())
    if rewritten:
        old = _buckets(spark, root, [listed[b] for b in rewritten if b in listed])
        newer = F.struct("new.updated_at", "new.content_digest") > F.struct("old.updated_at", "old.content_digest")
        last_id = max((r["max_id"] for r in listed.values()), default=0)
        merged = SY.upsert(
            old, changes.drop("bucket"), on_conflict="custom", order_cols=["updated_at", "content_digest"], start_after=F.lit(last_id),
            set_cols={c: F.when(newer, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")) for c in ("description", "updated_at", "content_digest")},
        )
        merged.withColumn("bucket", mine).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/data/batch={batch_id}")
        written = spark.read.schema(T.StructType([*STATE.fields, MANIFEST["bucket"]])).parquet(f"{root}/data/batch={batch_id}")
        sizes = written.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_rows"), F.max("id").alias("max_id")).collect()
        for r in sizes:
            listed[r["bucket"]] = (r["bucket"], batch_id, r["n_rows"], r["max_id"])
    rows = [tuple(listed[b]) for b in sorted(listed)]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{root}/manifest/batch={batch_id}")
    return rewritten


def continuous_load(
    spark: SparkSession, source_dir: str, *, root: str, checkpoint: str, n_buckets: int = N_BUCKETS, max_files_per_trigger: int = 1,
    summarize: Callable[[str], str] | None = None,
) -> DataFrame:
    """Load every file of changed files (``FILE`` rows) that has arrived below ``source_dir``; the table after it."""
    query = (
        spark.readStream.schema(FILE).option("maxFilesPerTrigger", max_files_per_trigger).parquet(source_dir)
        .writeStream.foreachBatch(lambda batch, batch_id: apply_batch(spark, root, batch, batch_id, n_buckets=n_buckets, summarize=summarize) and None)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return read_state(spark, root)
