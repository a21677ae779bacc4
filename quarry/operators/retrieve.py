"""Retrieval and context assembly.

Ranked lists are tables ``(qid, path, rank)``; every per-query group is bounded
by the retriever's k (or by a conversation), so ordered ``collect_list`` per
query is safe.  Content is joined by path after ranking, never carried through
the k-NN step.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Message roles understood by the chat format; others become system.
ROLES = ("system", "user", "assistant")


def first_per_path(hits: DataFrame, *, qid: str = "qid", path: str = "filepath", rank: str = "rank") -> DataFrame:
    """Keep the best-ranked hit per (query, path), then renumber 1..n."""
    best = hits.groupBy(qid, path).agg(F.min(rank).alias(rank))
    w = Window.partitionBy(qid).orderBy(rank, path)
    return best.withColumn(rank, F.row_number().over(w))


def attach_content(hits: DataFrame, files: DataFrame, *, path: str = "filepath",
                   file_path: str = "path", content: str = "content") -> DataFrame:
    """Left join content by path; ``missing`` flags hits without a file (the
    reference aborts the whole retrieval; ``require_content`` does that).

    The files are first semi-joined to the hit paths (at most queries x k
    distinct paths, broadcast by AQE when small), so only the texts that are
    needed reach the shuffle of the outer join."""
    f = files.select(F.col(file_path).alias(path), F.col(content).alias("content"))
    f = f.join(hits.select(path).distinct(), path, "left_semi")
    return hits.join(f, path, "left").withColumn("missing", F.col("content").isNull())


def require_content(hits: DataFrame) -> DataFrame:
    """Fail the job when any hit has no content (strict reference behaviour)."""
    return hits.withColumn("content", F.when(~F.col("missing"), F.col("content")).otherwise(
        F.raise_error(F.concat(F.lit("file not found: "), F.col("filepath")))))


def paths_from_lists(lists: DataFrame, files: DataFrame, *, qid: str = "qid", paths: str = "paths",
                     file_path: str = "path") -> DataFrame:
    """Ordered path lists to (qid, pos, path, content); unknown paths are
    skipped, duplicates kept (E2)."""
    ex = lists.select(qid, F.posexplode(paths).alias("pos", "path"))
    return ex.join(files.withColumnRenamed(file_path, "path"), "path", "inner")


def ensemble(lists: Sequence[DataFrame], *, qid: str = "qid", path: str = "filepath",
             rank: str = "rank") -> DataFrame:
    """Concatenate ranked lists in priority order; the first occurrence of a path
    wins (E3).  Output ``qid, path, retriever, rank, position``."""
    tagged = None
    for i, df in enumerate(lists):
        t = df.select(qid, path, rank).withColumn("retriever", F.lit(i + 1))
        tagged = t if tagged is None else tagged.unionByName(t)
    first = tagged.groupBy(qid, path).agg(F.min(F.struct("retriever", rank)).alias("__b")).select(
        qid, path, F.col("__b.retriever").alias("retriever"), F.col(f"__b.{rank}").alias(rank))
    w = Window.partitionBy(qid).orderBy("retriever", rank, path)
    return first.withColumn("position", F.row_number().over(w))


def relevance_filter(files: DataFrame, verdicts: DataFrame, *, on: Sequence[str], answer: str = "answer") -> DataFrame:
    """Keep files whose judge verdict is yes."""
    return files.join(verdicts.filter(F.col(answer)).select(*on), list(on), "left_semi")


def verify_paths(located: DataFrame, manifest: DataFrame, *, path: str = "path", strict: bool = False) -> DataFrame:
    """Flag located paths that exist in the manifest (E5); strict keeps only those."""
    if strict:
        return located.join(manifest.select(path), path, "left_semi")
    m = manifest.select(path).distinct().withColumn("exists", F.lit(True))
    return located.join(m, path, "left").withColumn("exists", F.coalesce("exists", F.lit(False)))


def pack(df: DataFrame, group: Sequence[str], order: str, text: Column, *, sep: str = "\n",
         out: str = "text", max_items: int = 200) -> DataFrame:
    """Ordered concatenation of ``text`` per group (E6), cut into chunks of
    ``max_items`` consecutive positions: ``chunk = order div max_items``.  The
    order column holds unique 0-based integer positions within a group (turn numbers),
    so a chunk holds at most ``max_items`` items and no window is needed: a hot
    group is spread over many chunks and tasks."""
    d = df.withColumn("__t", text).withColumn("chunk", F.floor(F.col(order) / max_items).cast("int"))
    items = F.collect_list(F.struct(F.col(order), F.col("__t")))
    return d.groupBy(*group, "chunk").agg(
        F.array_join(F.transform(F.array_sort(items), lambda x: x["__t"]), sep).alias(out),
        F.count("*").alias("n_items"))


def located_file(path: Column, content: Column) -> Column:
    """A file in the locator's layout (E6); files follow each other in path order with nothing between."""
    return F.concat(F.lit("\n### File: "), path, F.lit(" ###\n```\n"), F.coalesce(content, F.lit("")), F.lit("\n```"))


def planned_file(path: Column, content: Column, blocks: Column) -> Column:
    """A file in the planner's layout with its blocks, ``array<struct<target_type, target_name>>`` or null."""
    listed = F.array_join(F.transform(blocks, lambda b: F.concat(F.lit("\n- "), b["target_type"], F.lit(": "), b["target_name"])), "")
    return F.concat(F.lit("\n--------------------\nfilepath:"), path, F.lit("\n--"), F.coalesce(content, F.lit("")),
                    F.lit("\n--- content end---\n--- blocks ---\n"), F.when(blocks.isNull(), F.lit("No blocks found")).otherwise(listed))


def investigated_file(path: Column, content: Column) -> Column:
    """A relevant file in the layout of the investigation."""
    return F.concat(F.lit("--- "), path, F.lit(" start ---\n"), F.coalesce(content, F.lit("")), F.lit("\n--- "), path, F.lit(" end ---\n"))


def chat_role(role) -> Column:
    r = F.col(role) if isinstance(role, str) else role
    return F.when(r.isin(*ROLES), r).otherwise(F.lit("system"))


def messages(df: DataFrame, *, group: str, order: str, role: str = "role", content: str = "text",
             max_items: int = 200) -> DataFrame:
    """Ordered ``array<struct<type, content>>`` per conversation (E7), in chunks
    of ``max_items`` consecutive turns (``chunk = turn div max_items``)."""
    items = F.collect_list(F.struct(F.col(order).alias("o"), chat_role(role).alias("type"),
                                    F.col(content).alias("content")))
    d = df.withColumn("chunk", F.floor(F.col(order) / max_items).cast("int"))
    return d.groupBy(group, "chunk").agg(F.transform(F.array_sort(items), lambda x: F.struct(
        x["type"].alias("type"), x["content"].alias("content"))).alias("messages"))


def judge_filter(files: DataFrame, judge, *, input_col: str = "content", strict: bool = True) -> DataFrame:
    """Relevance filter with a judge function (E4 via C10): ``judge(text) -> bool``
    runs in Arrow batches; rows it accepts are kept.  As in the reference, any
    judge error fails the job when ``strict``; otherwise failed rows are dropped."""
    from pyspark.sql import types as T

    from quarry.operators.enrich import enrich_batch

    out = enrich_batch(files, judge, input_col=input_col, output_col="__answer", output_type=T.BooleanType())
    if strict:
        out = out.withColumn("__answer", F.when(F.col("error").isNull(), F.col("__answer")).otherwise(
            F.raise_error(F.concat(F.lit("relevance judge failed: "), F.col("error")))))
    return out.filter(F.coalesce(F.col("__answer"), F.lit(False))).drop("__answer", "error")
