"""Directory and repository digests.

A directory's digest concatenates one entry per file.  A directory may hold a
large share of all files, so the digest is cut into ``ceil(n / max_files)``
chunks by a hash of the path (``chunk`` 0, 1, ...; entries in path order inside
a chunk): no output row or group grows with the directory, and no window or
single task ever sees a whole directory.

``directory_text``, ``repository_text`` and ``summary_parts`` keep the order of the reference's texts across
chunks: chunks are bounded in bytes, and joined in order they are the text (``functions.running``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.paths import dirname
from quarry.functions.running import text_chunks


def _entry(path: Column, summary: Column) -> Column:
    return F.concat(F.lit("File: "), path, F.lit("\nSummary: "), summary, F.lit("\n"))


# 8 hex digits of md5(path) choose the chunk.
CHUNK_HEX_DIGITS = 8


def path_chunk(path: Column, n_chunks: Column) -> Column:
    """Deterministic chunk of a path among ``n_chunks`` (md5-based, SQL-reproducible)."""
    h = F.conv(F.substring(F.md5(path), 1, CHUNK_HEX_DIGITS), 16, 10).cast("long")
    return F.pmod(h, n_chunks.cast("long")).cast("int")


def directory_digest(docs: DataFrame, *, path: str = "filepath", summary: str = "description",
                     max_files: int = 200) -> DataFrame:
    """``Directory: d`` followed by ``File:``/``Summary:`` lines per file, files in
    path order, in ``ceil(n / max_files)`` hash chunks per directory (F1)."""
    d = docs.select(dirname(F.col(path)).alias("directory"), F.col(path).alias("path"),
                    _entry(F.col(path), F.col(summary)).alias("entry"))
    sizes = d.groupBy("directory").agg(F.ceil(F.count("*") / F.lit(max_files)).cast("int").alias("__n"))
    d = d.join(sizes, "directory").withColumn("chunk", path_chunk(F.col("path"), F.col("__n")))
    items = F.array_sort(F.collect_list(F.struct("path", "entry")))
    return d.groupBy("directory", "chunk").agg(
        F.count("*").alias("n_files"),
        F.concat(F.lit("Directory: "), F.col("directory"), F.lit("\n"),
                 F.array_join(F.transform(items, lambda x: x["entry"]), "")).alias("digest"))


def repository_digest(dir_summaries: DataFrame, *, repository: str = "repository", directory: str = "directory",
                      summary: str = "summary") -> DataFrame:
    """Directory summaries of a repository joined by a blank line, ordered by
    directory (F2; the reference iterates a Go map, whose order is random)."""
    items = F.array_sort(F.collect_list(F.struct(F.col(directory).alias("d"), F.col(summary).alias("s"))))
    return dir_summaries.groupBy(repository).agg(
        F.count("*").alias("n_directories"),
        F.array_join(F.transform(items, lambda x: x["s"]), "\n\n").alias("digest"))


def merge_summaries(overall: DataFrame, directories: DataFrame, *, key: str = "repository") -> DataFrame:
    """Overall summary struct + map directory -> summary struct, as JSON (F3);
    map entries in directory order so the text is deterministic.  The map holds
    one entry per directory of the repository."""
    entries = F.array_sort(F.collect_list(F.struct("directory", F.struct("purpose", "components", "description"))))
    m = directories.groupBy(key).agg(F.map_from_entries(entries).alias("directory_summaries"))
    j = overall.join(m, key, "left")
    return j.select(key, F.to_json(F.struct("summary", "directory_summaries")).alias("json"))


#: Bytes after which a chunk of an ordered text ends.
CHUNK_BYTES = 64 << 10


def directory_text(docs: DataFrame, *, path: str = "filepath", summary: str = "description", max_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(directory, chunk, n_files, digest): F1 in path order; the first chunk begins with ``Directory: d``."""
    d = docs.select(dirname(F.col(path)).alias("directory"), F.col(path).alias("path"), _entry(F.col(path), F.coalesce(F.col(summary), F.lit(""))).alias("entry"))
    d = d.withColumn("head", F.concat(F.lit("Directory: "), F.col("directory"), F.lit("\n")))
    return text_chunks(d, ["directory"], ["path"], "entry", max_bytes=max_bytes, lead="head").select("directory", "chunk", F.col("n_items").alias("n_files"), F.col("text").alias("digest"))


def repository_text(dir_summaries: DataFrame, *, repository: str = "repository", directory: str = "directory", summary: str = "summary",
                    max_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(repository, chunk, n_directories, digest): F2 in directory order, summaries apart by a blank line (which
    ends every summary but the last: it is taken off the last chunk)."""
    d = dir_summaries.select(F.col(repository).alias("repository"), F.col(directory).alias("directory"), F.concat(F.col(summary), F.lit("\n\n")).alias("entry"))
    chunks = text_chunks(d, ["repository"], ["directory"], "entry", max_bytes=max_bytes)
    last = chunks.groupBy("repository").agg(F.max("chunk").alias("last"))
    text = F.when(F.col("chunk") == F.col("last"), F.expr("left(text, length(text) - 2)")).otherwise(F.col("text"))
    return chunks.join(last, "repository").select("repository", "chunk", F.col("n_items").alias("n_directories"), text.alias("digest"))


def summary_parts(overall: DataFrame, directories: DataFrame, *, key: str = "repository", max_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(key, part, json): F3 as fragments of its JSON text, in order of ``part``; joined they are the text of
    ``merge_summaries``.  Part 0 opens the document with the overall summary, the last one closes it."""
    name = F.regexp_extract(F.to_json(F.struct(F.col("directory").alias("d"))), r"(?s)^\{\"d\":(.*)\}$", 1)
    entry = F.concat(F.lit(","), name, F.lit(":"), F.to_json(F.struct("purpose", "components", "description")))
    chunks = text_chunks(directories.select(key, "directory", entry.alias("entry")), [key], ["directory"], "entry", max_bytes=max_bytes)
    head = overall.select(key, F.to_json(F.struct("summary")).alias("head"))
    head = head.withColumn("head", F.concat(F.expr("left(head, length(head) - 1)"), F.when(F.col("head") == "{}", F.lit("")).otherwise(F.lit(",")), F.lit('"directory_summaries":{')))
    body = chunks.select(key, (F.col("chunk") + 1).alias("part"), F.when(F.col("chunk") == 0, F.expr("substring(text, 2)")).otherwise(F.col("text")).alias("json"))
    known = chunks.groupBy(key).agg((F.max("chunk") + 2).alias("last"))
    tail = head.join(known, key).select(key, F.col("last").alias("part"), F.lit("}}").alias("json"))
    alone = head.join(known, key, "left_anti").select(key, F.lit(0).alias("part"), F.regexp_replace("head", ',?"directory_summaries":\\{$', "}").alias("json"))
    opened = head.join(known, key, "left_semi").select(key, F.lit(0).alias("part"), F.col("head").alias("json"))
    return body.unionByName(opened).unionByName(tail).unionByName(alone)
