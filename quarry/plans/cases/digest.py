"""Summary digests (F1-F4) over the stored documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.paths import dirname
from quarry.operators import digest as DG
from quarry.plans.catalog import register
from quarry.plans.oracle import derived, sql
from quarry.sources import corpus as C

MAX_FILES = 200
SCOPE_REPOSITORY, SCOPE_CONTEXT = "repo1", "en"

_DIR = "CASE WHEN position('/' IN filepath) = 0 THEN '.' ELSE regexp_replace(filepath, '/[^/]*$', '') END"

derived("dirfiles", ("doctable",), f"""
    SELECT repository, {_DIR} AS directory, filepath,
           'File: ' || filepath || chr(10) || 'Summary: ' || description || chr(10) AS entry FROM doctable""")


@register("dir_digest", sql(["dirfiles"], f"""
    SELECT directory, chunk, count(*) AS n_files,
           'Directory: ' || directory || chr(10) || string_agg(entry, '' ORDER BY filepath) AS digest
    FROM (SELECT f.*, (('0x' || substr(md5(filepath), 1, 8))::BIGINT % n.nch)::INTEGER AS chunk
          FROM dirfiles f JOIN (SELECT directory, ceil(count(*) / {MAX_FILES})::BIGINT AS nch
                                FROM dirfiles GROUP BY directory) n USING (directory))
    GROUP BY directory, chunk"""))
def dir_digest(spark, d):
    return DG.directory_digest(C.doc_table(spark, d), max_files=MAX_FILES)


def _dir_summaries(spark, d):
    s = C.doc_table(spark, d)
    return s.groupBy("repository", dirname("filepath").alias("directory")).agg(F.count("*").alias("n")).select(
        "repository", "directory",
        F.concat(F.lit("Directory: "), "directory", F.lit(" ("), F.col("n").cast("string"), F.lit(" files)"))
        .alias("summary"))


@register("repo_digest", sql(["dirfiles"], """
    SELECT repository, count(*) AS n_directories,
           string_agg('Directory: ' || directory || ' (' || n::VARCHAR || ' files)', chr(10) || chr(10)
                      ORDER BY directory) AS digest
    FROM (SELECT repository, directory, count(*) AS n FROM dirfiles GROUP BY 1, 2) GROUP BY repository"""))
def repo_digest(spark, d):
    return DG.repository_digest(_dir_summaries(spark, d))


# Bytes of a chunk in the registered queries (small, so that several chunks occur).
_CHUNK = 4096


def _sql_chunks(group: str, order: str, src: str) -> str:
    """``src`` with the number of each entry in its group and its chunk."""
    return f"""SELECT *, row_number() OVER w - 1 AS n,
        ((sum(strlen(entry)) OVER (PARTITION BY {group} ORDER BY {order} ROWS UNBOUNDED PRECEDING) - strlen(entry)) // {_CHUNK})::INTEGER AS chunk
      FROM ({src}) WINDOW w AS (PARTITION BY {group} ORDER BY {order})"""


@register("dir_digest_text", sql(["dirfiles"], f"""
    SELECT directory, chunk, count(*) AS n_files,
           string_agg(CASE WHEN n = 0 THEN 'Directory: ' || directory || chr(10) ELSE '' END || entry, '' ORDER BY n) AS digest
    FROM ({_sql_chunks('directory', 'filepath', 'SELECT * FROM dirfiles')}) GROUP BY directory, chunk"""))
def dir_digest_text(spark, d):
    """Directory digests in path order, in chunks that joined are the whole text."""
    return DG.directory_text(C.doc_table(spark, d), max_bytes=_CHUNK)


derived("dirsummaries", ("dirfiles",), """
    SELECT repository, directory, 'Directory: ' || directory || ' (' || count(*)::VARCHAR || ' files)' AS summary
    FROM dirfiles GROUP BY 1, 2""")


@register("repo_summary_merge", sql(["dirsummaries", "doctable"], """
    SELECT repository, to_json({'summary': {'project_name': repository, 'purpose': 'documents: ' || n::VARCHAR},
                                'directory_summaries': m})::VARCHAR AS json
    FROM (SELECT repository, count(*) AS n FROM doctable GROUP BY repository)
    JOIN (SELECT repository, map_from_entries(list({'k': directory, 'v': {'purpose': summary,
                                                    'components': [directory], 'description': summary}}
                                                   ORDER BY directory)) AS m
          FROM dirsummaries GROUP BY repository) USING (repository)"""))
def repo_summary_merge(spark, d):
    return DG.merge_summaries(*_summaries(spark, d))


def _summaries(spark, d):
    ds = _dir_summaries(spark, d).select(
        "repository", "directory", F.col("summary").alias("purpose"),
        F.array(F.col("directory")).alias("components"), F.col("summary").alias("description"))
    overall = C.doc_table(spark, d).groupBy("repository").agg(F.count("*").alias("n")).select(
        "repository", F.struct(
            F.col("repository").alias("project_name"),
            F.concat(F.lit("documents: "), F.col("n").cast("string")).alias("purpose"),
        ).alias("summary"))
    return overall, ds


@register("documents_scope", sql(["doctable"], f"""
    SELECT id, filepath, description FROM doctable
    WHERE repository = '{SCOPE_REPOSITORY}' AND context = '{SCOPE_CONTEXT}'"""))
def documents_scope(spark, d):
    s = C.doc_table(spark, d)
    return s.filter((F.col("repository") == SCOPE_REPOSITORY) & (F.col("context") == SCOPE_CONTEXT)).select(
        "id", "filepath", "description")


@register("repo_digest_text", sql(["dirsummaries"], f"""
    SELECT repository, chunk, count(*) AS n_directories,
           string_agg(CASE WHEN n = last THEN substr(entry, 1, length(entry) - 2) ELSE entry END, '' ORDER BY n) AS digest
    FROM (SELECT *, max(n) OVER (PARTITION BY repository) AS last
          FROM ({_sql_chunks('repository', 'directory', "SELECT repository, directory, summary || chr(10) || chr(10) AS entry FROM dirsummaries")}))
    GROUP BY repository, chunk"""))
def repo_digest_text(spark, d):
    return DG.repository_text(_dir_summaries(spark, d), max_bytes=_CHUNK)


@register("repo_summary_parts", sql(["dirsummaries", "doctable"], f"""
    SELECT repository, chunk + 1 AS part, string_agg(CASE WHEN n = 0 THEN substr(entry, 2) ELSE entry END, '' ORDER BY n) AS json
    FROM ({_sql_chunks('repository', 'directory', """SELECT repository, directory, ',' || to_json(directory)::VARCHAR || ':' ||
            to_json({'purpose': summary, 'components': [directory], 'description': summary})::VARCHAR AS entry FROM dirsummaries""")})
    GROUP BY repository, chunk
    UNION ALL
    SELECT repository, 0, '{{"summary":' || to_json({{'project_name': repository, 'purpose': 'documents: ' || count(*)::VARCHAR}})::VARCHAR
           || ',"directory_summaries":{{' FROM doctable GROUP BY repository
    UNION ALL
    SELECT repository, max(chunk) + 2, '}}}}'
    FROM ({_sql_chunks('repository', 'directory', """SELECT repository, directory, ',' || to_json(directory)::VARCHAR || ':' ||
            to_json({'purpose': summary, 'components': [directory], 'description': summary})::VARCHAR AS entry FROM dirsummaries""")})
    GROUP BY repository"""))
def repo_summary_parts(spark, d):
    return DG.summary_parts(*_summaries(spark, d), max_bytes=_CHUNK)


@register("documents_scopes", sql(["doctable"], """
    SELECT id, repository, context, filepath, description FROM doctable
    WHERE repository = 'repo1' AND context IN (SELECT lang FROM documents GROUP BY lang HAVING count(*) >= 0.2 * (SELECT count(*) FROM documents))"""))
def documents_scopes(spark, d):
    """The documents of the scopes in a table (one repository, its larger languages), from a snapshot in folders."""
    import uuid

    from quarry.session import scratch_path
    from quarry.sources.files import read_scopes, write_snapshot
    path = scratch_path(spark, f"scoped-{uuid.uuid4().hex}")
    docs = C.doc_table(spark, d)
    write_snapshot(docs.withColumn("embedding", F.array().cast("array<float>")), path)
    scopes = docs.groupBy("repository", "context").agg(F.count("*").alias("n"))
    per = docs.groupBy("context").agg(F.count("*").alias("all")).withColumn("rows", docs.select(F.count("*")).scalar())
    asked = scopes.join(per.filter(F.col("all") >= 0.2 * F.col("rows")), "context").filter(F.col("repository") == "repo1")
    return read_scopes(spark, path, asked, columns=["id", "repository", "context", "filepath", "description"])
