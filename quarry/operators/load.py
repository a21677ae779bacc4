"""End-to-end compositions of the operators: the reference's ``load`` and
``search`` commands as single Spark jobs over whole tables.

* ``load_documents``: stored documents + the current file set -> next snapshot.
  Classification runs on keys, times and content lengths only; texts are fetched
  for changed rows only, summarised (a user function in Arrow batches, or the
  built-in line-count summary) and embedded, then upserted; stored rows of the
  loaded scopes whose files disappeared are pruned.
* ``search_context``: a query text -> its hash embedding (one row, used as a
  scalar subquery) -> scoped top-k -> file contents -> one ordered context text.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from quarry.operators import enrich as EN
from quarry.operators import retrieve as R
from quarry.operators import sync as SY
from quarry.operators import vectors as V
from quarry.session import ensure_checkpoint_dir


def default_summary(content: F.Column, filepath: F.Column) -> F.Column:
    """Built-in summary used when no summariser is given."""
    return F.concat(F.lit("summary of "), filepath, F.lit(": "), F.size(F.split(content, "\n")).cast("string"),
                    F.lit(" lines"))


def _observed(rows: DataFrame, observation: Observation | None) -> DataFrame:
    """``rows`` whose pass also counts what became of each."""
    if observation is None:
        return rows
    failed = F.col("error").isNotNull() if "error" in rows.columns else F.lit(False)
    empty = ~failed & (F.coalesce(F.length("description"), F.lit(0)) == 0)
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    return rows.observe(observation, F.count(F.lit(1)).alias("n_changed"), count(failed).alias("n_failed"), count(empty).alias("n_skipped"), count(~failed & ~empty).alias("n_ok"))


def load_documents(
    state: DataFrame,
    files: DataFrame,
    *,
    summarize: Callable[[str], str] | None = None,
    dim: int = 64,
    refresh_repository: str | None = None,
    scopes: DataFrame | None = None,
    loaded_at: dt.datetime | None = None,
    materialize: bool = True,
    observation: Observation | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Sync ``state`` (documents) with ``files`` (repository, context, filepath,
    content, modified_at).  Returns ``(next_state, errors)``; ``errors`` holds
    the changed files whose summariser call failed (they are not upserted, nor are
    files with an empty summary).  The embedding is that of the summary, and
    ``updated_at`` is ``loaded_at`` (default: now), so a file that has not changed
    since is fresh in the next load.

    ``observation`` receives the counts of changed files as they are summarised: n_changed, n_failed (the
    summariser raised), n_skipped (empty summary) and n_ok, from the pass that writes them, without another scan.

    With ``materialize`` the changed rows (keys and summaries, not the texts) are
    checkpointed to the shared ``spark.checkpoint.dir`` once, so the embedding, the
    upsert and the error report read them instead of re-running classification and
    the summariser."""
    if materialize:
        ensure_checkpoint_dir(state.sparkSession)
    if refresh_repository is not None:
        state = SY.refresh(state, refresh_repository)
    classes = SY.classify(state, files, scopes=scopes, keep_content=False)
    changed = SY.changed_content(classes, files)
    if summarize is None:
        described = _observed(changed.withColumn("description", default_summary(F.col("content"), F.col("filepath"))).drop("content"), observation)
        if materialize:
            described = described.checkpoint()
        errors = described.limit(0).withColumn("error", F.lit(None).cast("string"))
    else:
        enriched = EN.enrich_batch(changed, summarize, input_col="content", output_col="description").drop("content")
        enriched = _observed(enriched, observation)
        if materialize:
            enriched = enriched.checkpoint()
        described, errors = EN.split_errors(enriched)
        described = described.drop("error")
    described = described.filter(F.length("description") > 0)
    stamp = F.lit(loaded_at).cast("timestamp_ntz") if loaded_at is not None else F.current_timestamp().cast("timestamp_ntz")
    key = F.concat_ws("\u0001", *[F.col(c) for c in SY.KEY])
    emb = EN.hash_embed(described.select(key.alias("__k"), "description"), id_col="__k", text_col="description", dim=dim)
    changes = described.withColumn("__k", key).join(emb.select("__k", "embedding"), "__k").select(
        *SY.KEY, "description", stamp.alias("updated_at"), "embedding")
    pruned = SY.prune(state, files, scopes=scopes)
    before = state.select(F.max("id")).scalar()  # ids are never reused after a prune
    return SY.upsert(pruned, changes, start_after=before), errors


def search_context(
    spark: SparkSession,
    state: DataFrame,
    files: DataFrame,
    query: str | DataFrame,
    *,
    repository: str,
    context: str,
    k: int = 5,
    dim: int = 64,
) -> DataFrame:
    """One row: the ranked hits of ``query`` inside (repository, context), with
    their contents packed as ``File: path`` blocks in rank order.  ``query`` is a
    text, or a one-row DataFrame with a ``text`` column (used as a scalar
    subquery, so it never passes through the driver)."""
    if isinstance(query, str):
        query = spark.createDataFrame([(query,)], "text string")
    q = query.select(F.lit(0).cast("long").alias("qid"), "text")
    qtext = q.select("text").scalar()
    qvec = EN.hash_embed(q, id_col="qid", text_col="text", dim=dim).select("embedding").scalar()
    scoped = state.filter((F.col("repository") == repository) & (F.col("context") == context))
    hits = V.knn_search(scoped.select("id", "filepath", "embedding"), qvec, k)
    # k rows: numbering them in one partition is bounded by k
    ranked = hits.withColumn("pos", F.row_number().over(Window.orderBy("score", "id")) - 1).withColumn(
        "qid", F.lit(0))
    with_text = R.attach_content(ranked, files, file_path="filepath")
    block = F.concat(F.lit("File: "), F.col("filepath"), F.lit("\n"), F.coalesce("content", F.lit("")))
    return R.pack(with_text, ["qid"], "pos", block, sep="\n\n", max_items=k).select(
        qtext.alias("query"), "text", F.col("n_items").alias("n_hits"))
