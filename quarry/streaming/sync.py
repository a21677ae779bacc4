"""Continuous sync (C11): each micro-batch of changed rows is merged into the
stored state with the same latest-per-key rule as the batch upsert.

The merge runs in ``foreachBatch``; snapshot ``n`` is written from snapshot
``n-1`` plus batch ``n`` into a folder named by the batch id, so a replayed batch
overwrites its own output and never sees itself twice.  Snapshots and the stream
checkpoint live under the shared ``spark.checkpoint.dir`` so a lost executor or
a restarted driver resumes from the last committed batch.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.sync import latest_per_key
from quarry.plans.guards import spread
from quarry.session import scratch_path
from quarry.sources.tables import read_table


def _snapshot(root: str, batch_id: int) -> str:
    return f"{root}/snapshot={batch_id:012d}"


def continuous_upsert(
    spark: SparkSession,
    source_dir: str,
    schema: T.StructType,
    *,
    key: Sequence[str],
    order_cols: Sequence[str],
    state_root: str,
    checkpoint: str,
    max_files_per_trigger: int = 1,
) -> str:
    """Run the stream over everything available now; return the final snapshot path."""
    key = list(key)

    def merge(batch: DataFrame, batch_id: int) -> None:
        rows = batch
        if batch_id > 0:
            rows = spark.read.schema(schema).parquet(_snapshot(state_root, batch_id - 1)).unionByName(batch)
        latest_per_key(rows, order_cols, key).select(*schema.names).write.mode("overwrite").parquet(
            _snapshot(state_root, batch_id))

    q = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(source_dir)
        .writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return latest_snapshot(spark, state_root, schema)


def latest_snapshot(spark: SparkSession, state_root: str, schema: T.StructType) -> str:
    """Path of the newest committed snapshot.  Snapshot folders are named
    ``snapshot=<batch id>``, so partition discovery lists them; only the
    partition column is read.  Works after a restart that had nothing new to do."""
    full = T.StructType(schema.fields + [T.StructField("snapshot", T.LongType())])
    last = spark.read.schema(full).parquet(state_root).agg(F.max("snapshot")).first()[0]
    if last is None:
        raise RuntimeError("no snapshot written")
    return _snapshot(state_root, int(last))


STREAM_SCHEMA = T.StructType([
    T.StructField("source", T.StringType()), T.StructField("doc_id", T.LongType()),
    T.StructField("lang", T.StringType()), T.StructField("n_chars", T.LongType()),
])


def stream_latest_per_key_from_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table arrives as files of several languages each, a language's rows
    dealt over all of them, in about four micro-batches; key = source, the
    largest doc_id wins.  Must equal the batch result whatever the batch order."""
    run = scratch_path(spark, f"stream-sync-{uuid.uuid4().hex}")
    docs = read_table(spark, sf_dir, "documents", "source", "doc_id", "lang", "n_chars")
    spread(docs, "lang", "doc_id").write.mode("overwrite").parquet(f"{run}/incoming")
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    final = continuous_upsert(
        spark, f"{run}/incoming", STREAM_SCHEMA, key=["source"], order_cols=["doc_id"],
        state_root=f"{run}/state", checkpoint=f"{run}/checkpoint", max_files_per_trigger=-(-files // 4),
    )
    return spark.read.schema(STREAM_SCHEMA).parquet(final).select(F.col("source"), "doc_id", "lang", "n_chars")
