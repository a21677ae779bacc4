"""Operator inputs derived from the driver tables.

The reference works on Git trees, a documents table, model output and CI
exports.  The driver gives TPC-H-like tables plus documents, embeddings, pages,
labels and conversations; these functions derive the reference's inputs from
them with DataFrame expressions only, so every query's work grows with the
tables.  ``quarry.plans.oracle.VIEWS`` holds the same definitions as DuckDB SQL.

``doc_state`` and ``doc_incoming`` split the documents into a stored state and a file
set, which is what the sync operators (C1-C9, load) compare; every other operator
reads ``doc_table`` or ``doc_file_table``, the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.plans.guards import spread
from quarry.sources import code_shapes as SH
from quarry.sources.tables import read_table

EPOCH = "2024-01-01 00:00:00"


def _minutes_after_epoch(m) -> F.Column:
    return F.lit(EPOCH).cast("timestamp_ntz") + F.make_dt_interval(mins=m.cast("int"))


def _doc_key_cols(doc_id: F.Column, lang: F.Column, source: F.Column) -> list[F.Column]:
    return [
        F.concat(F.lit("repo"), (doc_id % 2).cast("string")).alias("repository"),
        lang.alias("context"),
        F.concat(source, F.lit("/"), doc_id.cast("string"), F.lit(".txt")).alias("filepath"),
    ]


def doc_state(spark: SparkSession, d: str) -> DataFrame:
    """The stored side of a sync: id, repository, context, filepath, description, updated_at."""
    return doc_table(spark, d).filter(F.col("id") % 3 != 0)


def doc_table(spark: SparkSession, d: str) -> DataFrame:
    """Every row of ``documents``, with the columns of ``doc_state``."""
    docs = read_table(spark, d, "documents", "doc_id", "text", "lang", "source")
    i = F.col("doc_id")
    return docs.select(
        i.alias("id"), *_doc_key_cols(i, F.col("lang"), F.col("source")),
        F.col("text").alias("description"),
        _minutes_after_epoch((i * 37) % 1440).alias("updated_at"),
    )


def doc_file_table(spark: SparkSession, d: str) -> DataFrame:
    """Every row of ``documents`` as a file, with the columns of ``doc_incoming``."""
    return _as_files(read_table(spark, d, "documents", "doc_id", "text", "lang", "source"))


def doc_versions(spark: SparkSession, d: str, paths: int) -> DataFrame:
    """Every document as a version of one of ``paths`` files of its source, with the columns of ``doc_incoming``."""
    docs = read_table(spark, d, "documents", "doc_id", "text", "lang", "source")
    i = F.col("doc_id")
    path = F.concat(F.col("source"), F.lit("/"), (i % paths).cast("string"), F.lit(".txt"))
    return docs.select(
        F.concat(F.lit("repo"), (i % 2).cast("string")).alias("repository"), F.col("lang").alias("context"), path.alias("filepath"),
        F.col("text").alias("content"), _minutes_after_epoch((i * 53) % 1440).alias("modified_at"),
    )


def doc_incoming(spark: SparkSession, d: str) -> DataFrame:
    """The current file set: repository, context, filepath, content, modified_at."""
    docs = read_table(spark, d, "documents", "doc_id", "text", "lang", "source")
    return _as_files(docs.filter(F.col("doc_id") % 5 != 0))


def _as_files(docs: DataFrame) -> DataFrame:
    i = F.col("doc_id")
    return docs.select(
        *_doc_key_cols(i, F.col("lang"), F.col("source")),
        F.col("text").alias("content"),
        _minutes_after_epoch((i * 53) % 1440).alias("modified_at"),
    )


def doc_files(spark: SparkSession, d: str) -> DataFrame:
    """Every document as a file: path, content."""
    docs = read_table(spark, d, "documents", "doc_id", "text", "source")
    return docs.select(
        F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.col("text").alias("content"),
    )


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings with a document scope: id, repository, context, filepath, embedding, label."""
    e = read_table(spark, d, "embeddings", "vec_id", "embedding", "label")
    v = F.col("vec_id")
    return e.select(
        v.alias("id"),
        F.concat(F.lit("repo"), (F.col("label") % 2).cast("string")).alias("repository"),
        F.concat(F.lit("ctx"), (F.col("label") % 5).cast("string")).alias("context"),
        F.concat(F.lit("src"), (v % 20).cast("string"), F.lit("/"), v.cast("string"), F.lit(".txt")).alias("filepath"),
        "embedding", "label",
    )


def site_files(spark: SparkSession, d: str) -> DataFrame:
    """Web pages as a file tree: path = URL without scheme, query and fragment;
    the smallest page_id wins when two URLs give the same path."""
    p = read_table(spark, d, "pages", "page_id", "url", "html")
    path = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "/?([?#].*)?$", "")
    return (
        p.select(path.alias("path"), "page_id", "html")
        .groupBy("path")
        .agg(F.min("page_id").alias("page_id"), F.min_by("html", "page_id").alias("content"))
    )


def go_files(spark: SparkSession, d: str) -> DataFrame:
    """One Go file per part, of one of the shapes in ``code_shapes``."""
    # the keys are dealt out before the texts are made: lexing them is heavy work for each row
    p = spread(read_table(spark, d, "part", "p_partkey", "p_size"), "p_partkey")
    k = F.col("p_partkey")
    return p.select(F.concat(F.lit("f"), k.cast("string"), F.lit(".go")).alias("path"),
                    SH.by_shape(k, [g.text for g in SH.GO], k=k, v=F.col("p_size")).alias("content"))


def hcl_files(spark: SparkSession, d: str) -> DataFrame:
    """One HCL file per supplier, of one of the shapes in ``code_shapes``."""
    s = spread(read_table(spark, d, "supplier", "s_suppkey", "s_nationkey"), "s_suppkey")
    k = F.col("s_suppkey")
    return s.select(F.concat(F.lit("s"), k.cast("string"), F.lit(".tf")).alias("path"),
                    SH.by_shape(k, [h.text for h in SH.HCL], k=k, v=F.col("s_nationkey")).alias("content"))


def plans(spark: SparkSession, d: str) -> DataFrame:
    """One change plan per order; its line items are the changes, in line order."""
    o = read_table(spark, d, "orders", "o_orderkey", "o_orderpriority")
    # hash-partitioned by order once: the per-order aggregate below needs no other shuffle
    li = spread(read_table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_linenumber"), "l_orderkey")
    ch = li.select(
        F.col("l_orderkey").alias("o_orderkey"), "l_linenumber",
        F.struct(
            F.struct(
                F.concat(F.lit("f"), F.col("l_partkey").cast("string"), F.lit(".go")).alias("path"),
                F.lit("function").alias("target_type"),
                F.concat(F.lit("F"), F.col("l_partkey").cast("string")).alias("target_name"),
                F.lit("").alias("content"),
            ).alias("block"),
            F.concat(F.lit("return "), F.col("l_linenumber").cast("string")).alias("new_content"),
            F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("new_comment"),
        ).alias("change"),
    )
    per_order = ch.groupBy("o_orderkey").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "change"))), lambda x: x["change"])
        .alias("changes"))
    return o.join(per_order, "o_orderkey").select(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("query"), "changes")


def reviews(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders", "o_orderkey", "o_orderstatus")
    return o.select(
        F.col("o_orderkey").cast("string").alias("plan_id"),
        (F.col("o_orderstatus") == "F").alias("result"),
        F.concat(F.lit("status "), F.col("o_orderstatus")).alias("comment"),
    )


def ci_runs(spark: SparkSession, d: str) -> DataFrame:
    """Workflow runs: one per event; the branch is the user; errors are failures."""
    e = read_table(spark, d, "events", "event_id", "user_id", "event_type")
    return e.select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("name"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("branch"),
        F.lit("completed").alias("status"),
        F.when(F.col("event_type") == "error", F.lit("failure")).otherwise(F.lit("success")).alias("conclusion"),
        F.concat(F.lit("https://ci.example.com/runs/"), F.col("event_id").cast("string")).alias("html_url"),
    )


def ci_prs(spark: SparkSession, d: str) -> DataFrame:
    """Pull requests: one per user with events."""
    e = read_table(spark, d, "events", "user_id").distinct()
    u = F.col("user_id")
    return e.select(
        u.alias("number"),
        F.concat(F.lit("Change by user "), u.cast("string")).alias("title"),
        F.when(u % 3 == 0, F.lit("closed")).otherwise(F.lit("open")).alias("state"),
        F.concat(F.lit("u"), u.cast("string")).alias("head_ref"),
    )


def ci_logs(spark: SparkSession, d: str) -> DataFrame:
    """Log locations for runs; runs of purchase events have none (lookup failure)."""
    e = read_table(spark, d, "events", "event_id", "event_type")
    return e.filter(F.col("event_type") != "purchase").select(
        F.col("event_id").alias("run_id"),
        F.concat(F.lit("https://ci.example.com/logs/"), F.col("event_id").cast("string")).alias("logs_url"),
    )
