"""Sync and mutation queries (C1-C11) over documents split into a stored state and
an incoming file set (see ``quarry.sources.corpus``)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from quarry.operators import enrich as EN
from quarry.operators import sync as SY
from quarry.plans.catalog import register
from quarry.plans.oracle import derived, sql
from quarry.sources import corpus as C

REFRESH_REPOSITORY = "repo0"
LOADED_AT = "2024-02-01 00:00:00"  # the time of the load, after every modification time
STALE_BEFORE = "2024-01-01 12:00:00"

KEYS = "repository, context, filepath"
ON_KEY = "a.repository = b.repository AND a.context = b.context AND a.filepath = b.filepath"


def describe(content: F.Column, filepath: F.Column) -> F.Column:
    """Deterministic stand-in for the model summary of a changed file."""
    return F.concat(F.lit("summary of "), filepath, F.lit(": "),
                    F.size(F.split(content, "\n")).cast("string"), F.lit(" lines"))


SQL_DESCRIBE = "'summary of ' || filepath || ': ' || len(string_split(content, chr(10)))::VARCHAR || ' lines'"

derived("cls", ("state", "incoming"), """
    SELECT coalesce(a.repository, b.repository) AS repository, coalesce(a.context, b.context) AS context,
           coalesce(a.filepath, b.filepath) AS filepath, a.id, a.updated_at, b.modified_at, b.content,
           CASE WHEN b.filepath IS NULL THEN (CASE WHEN sc.repository IS NOT NULL THEN 'prune' ELSE 'keep' END)
                WHEN a.filepath IS NULL THEN (CASE WHEN coalesce(length(b.content), 0) = 0 THEN 'skip' ELSE 'insert' END)
                WHEN a.updated_at > b.modified_at THEN 'fresh'
                WHEN coalesce(length(b.content), 0) = 0 THEN 'skip'
                ELSE 'update' END AS class
    FROM state a FULL OUTER JOIN incoming b
      ON a.repository = b.repository AND a.context = b.context AND a.filepath = b.filepath
    LEFT JOIN (SELECT DISTINCT repository, context FROM incoming) sc
      ON sc.repository = coalesce(a.repository, b.repository) AND sc.context = coalesce(a.context, b.context)""")
derived("changes", ("cls",), f"""
    SELECT repository, context, filepath, {SQL_DESCRIBE} AS description, TIMESTAMP '{LOADED_AT}' AS updated_at
    FROM cls WHERE class IN ('insert', 'update')""")
derived("allchanges", ("incoming",), f"""
    SELECT repository, context, filepath, {SQL_DESCRIBE} AS description, modified_at AS updated_at FROM incoming""")


def sql_with_new_ids(kept: str, fresh: str, cols: str = "id, repository, context, filepath, description, updated_at") -> str:
    """SQL of ``kept UNION ALL fresh-with-dense-ids`` (same bucketing as functions.ids)."""
    rest = cols.split(", ", 1)[1]
    return f"""
    , kept AS ({kept}), fresh AS ({fresh}),
    mx AS (SELECT coalesce(max(id), 0) AS m FROM state),
    bk AS (SELECT *, ('0x' || substr(md5(concat_ws(chr(1), repository, context, filepath)), 1, 4))::INTEGER AS b
           FROM fresh),
    offs AS (SELECT b, coalesce(sum(n) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
             FROM (SELECT b, count(*) AS n FROM bk GROUP BY b))
    SELECT {cols} FROM kept
    UNION ALL
    SELECT (mx.m + offs.off + row_number() OVER (PARTITION BY bk.b ORDER BY repository, context, filepath))::BIGINT
             AS id, {rest}
    FROM bk JOIN offs ON bk.b = offs.b CROSS JOIN mx"""


def _changes(spark, d):
    inc = C.doc_incoming(spark, d)
    cls = SY.classify(C.doc_state(spark, d), inc, keep_content=False)
    return SY.changed_content(cls, inc).select(
        *SY.KEY, describe(F.col("content"), F.col("filepath")).alias("description"),
        F.lit(LOADED_AT).cast("timestamp_ntz").alias("updated_at"))


def _all_changes(spark, d):
    inc = C.doc_incoming(spark, d)
    return inc.select(*SY.KEY, describe(F.col("content"), F.col("filepath")).alias("description"),
                      F.col("modified_at").alias("updated_at"))


@register("sync_classify", sql(["cls"], f"SELECT {KEYS}, id, class FROM cls"))
def sync_classify(spark, d):
    return SY.classify(C.doc_state(spark, d), C.doc_incoming(spark, d), keep_content=False).select(
        *SY.KEY, "id", "class")


@register("sync_prune", sql(["state", "incoming"], f"""
    SELECT a.* FROM state a
    WHERE EXISTS (SELECT 1 FROM incoming b WHERE {ON_KEY})
       OR NOT EXISTS (SELECT 1 FROM incoming b WHERE b.repository = a.repository AND b.context = a.context)"""))
def sync_prune(spark, d):
    return SY.prune(C.doc_state(spark, d), C.doc_incoming(spark, d))


@register("sync_refresh", sql(["state"], f"SELECT * FROM state WHERE repository <> '{REFRESH_REPOSITORY}'"))
def sync_refresh(spark, d):
    return SY.refresh(C.doc_state(spark, d), REFRESH_REPOSITORY)


_MERGE_UPDATE = f"""
    SELECT a.id, coalesce(a.repository, b.repository) AS repository, coalesce(a.context, b.context) AS context,
           coalesce(a.filepath, b.filepath) AS filepath,
           CASE WHEN b.filepath IS NOT NULL THEN b.description ELSE a.description END AS description,
           CASE WHEN b.filepath IS NOT NULL THEN b.updated_at ELSE a.updated_at END AS updated_at
    FROM state a FULL OUTER JOIN changes b ON {ON_KEY}"""


@register("upsert_new_values", sql(["state", "changes"], sql_with_new_ids(
    f"SELECT * FROM ({_MERGE_UPDATE}) WHERE id IS NOT NULL", f"SELECT * FROM ({_MERGE_UPDATE}) WHERE id IS NULL")))
def upsert_new_values(spark, d):
    return SY.upsert(C.doc_state(spark, d), _changes(spark, d), on_conflict="update")


@register("upsert_bucketed", sql(["state", "changes"], sql_with_new_ids(
    f"SELECT * FROM ({_MERGE_UPDATE}) WHERE id IS NOT NULL", f"SELECT * FROM ({_MERGE_UPDATE}) WHERE id IS NULL")))
def upsert_bucketed(spark, d):
    """Classify and upsert against a state stored in buckets of the document key: only the changes are exchanged."""
    import uuid

    from quarry.session import scratch_path
    from quarry.sources.files import write_bucketed
    name = f"documents_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    state = write_bucketed(C.doc_state(spark, d), scratch_path(spark, name), name, n_buckets=n)
    inc = C.doc_incoming(spark, d)
    changed = SY.changed_content(SY.classify(state, inc, keep_content=False), inc)
    changes = changed.select(*SY.KEY, describe(F.col("content"), F.col("filepath")).alias("description"), F.lit(LOADED_AT).cast("timestamp_ntz").alias("updated_at"))
    return SY.upsert(state, changes, on_conflict="update")


@register("upsert_ignore", sql(["state", "changes"], sql_with_new_ids(
    "SELECT * FROM state",
    f"SELECT b.* FROM changes b WHERE NOT EXISTS (SELECT 1 FROM state a WHERE {ON_KEY})")))
def upsert_ignore(spark, d):
    return SY.upsert(C.doc_state(spark, d), _changes(spark, d), on_conflict="ignore")


_MERGE_CUSTOM = f"""
    SELECT a.id, coalesce(a.repository, b.repository) AS repository, coalesce(a.context, b.context) AS context,
           coalesce(a.filepath, b.filepath) AS filepath,
           CASE WHEN b.filepath IS NULL THEN a.description WHEN a.id IS NULL THEN b.description
                ELSE b.description || ' (was ' || length(a.description)::VARCHAR || ' chars)' END AS description,
           CASE WHEN b.filepath IS NULL THEN a.updated_at WHEN a.id IS NULL THEN b.updated_at
                ELSE greatest(a.updated_at, b.updated_at) END AS updated_at
    FROM state a FULL OUTER JOIN changes b ON {ON_KEY}"""


@register("upsert_custom", sql(["state", "changes"], sql_with_new_ids(
    f"SELECT * FROM ({_MERGE_CUSTOM}) WHERE id IS NOT NULL", f"SELECT * FROM ({_MERGE_CUSTOM}) WHERE id IS NULL")))
def upsert_custom(spark, d):
    sets = {
        "description": F.concat(F.col("new.description"), F.lit(" (was "),
                                F.length("old.description").cast("string"), F.lit(" chars)")),
        "updated_at": F.greatest(F.col("old.updated_at"), F.col("new.updated_at")),
    }
    return SY.upsert(C.doc_state(spark, d), _changes(spark, d), on_conflict="custom", set_cols=sets)


@register("insert_checked", sql(["state", "allchanges"], sql_with_new_ids(
    "SELECT * FROM state",
    f"""SELECT b.* FROM allchanges b WHERE coalesce(length(b.description), 0) > 0
          AND NOT EXISTS (SELECT 1 FROM state a WHERE {ON_KEY})""")))
def insert_checked(spark, d):
    nxt, _rejected = SY.insert_checked(C.doc_state(spark, d), _all_changes(spark, d), required=["description"])
    return nxt


@register("key_violations", sql(["state", "allchanges"], f"""
    SELECT {KEYS}, count(*) AS n FROM (SELECT {KEYS} FROM state UNION ALL SELECT {KEYS} FROM allchanges)
    GROUP BY {KEYS} HAVING count(*) > 1"""))
def key_violations(spark, d):
    return SY.key_violations(C.doc_state(spark, d), _all_changes(spark, d))


@register("update_where", sql(["state"], f"""
    SELECT id, repository, context, filepath,
           CASE WHEN context = 'en' AND updated_at < TIMESTAMP '{STALE_BEFORE}' THEN 'stale' ELSE description END
             AS description, updated_at
    FROM state"""))
def update_where(spark, d):
    pred = (F.col("context") == "en") & (F.col("updated_at") < F.lit(STALE_BEFORE).cast("timestamp_ntz"))
    return SY.update_where(C.doc_state(spark, d), pred, {"description": F.lit("stale")})


@register("update_where_two", sql(["state"], f"""
    SELECT id, repository, context, filepath,
           CASE WHEN updated_at < TIMESTAMP '{STALE_BEFORE}' THEN 'stale' ELSE description END AS description,
           CASE WHEN updated_at < TIMESTAMP '{STALE_BEFORE}' THEN TIMESTAMP '{LOADED_AT}' ELSE updated_at END AS updated_at
    FROM state"""))
def update_where_two(spark, d):
    """Two columns set, one of them the predicate's own."""
    return SY.update_where(C.doc_state(spark, d), F.col("updated_at") < F.lit(STALE_BEFORE).cast("timestamp_ntz"), {
        "updated_at": F.lit(LOADED_AT).cast("timestamp_ntz"), "description": F.lit("stale")})


# every change twice, the second time without a description: the field check comes first
_TWICE = """SELECT repository, context, filepath, description, updated_at FROM allchanges
            UNION ALL SELECT repository, context, filepath, NULL, updated_at FROM allchanges"""


@register("insert_rejected", sql(["state", "allchanges"], f"""
    SELECT {KEYS}, description, CASE WHEN description IS NULL OR description = '' THEN 'missing required field'
      ELSE 'unique key violation' END AS reason
    FROM ({_TWICE}) a
    WHERE description IS NULL OR description = '' OR EXISTS (SELECT 1 FROM state b WHERE {ON_KEY})"""))
def insert_rejected(spark, d):
    every = _all_changes(spark, d)
    blank = every.withColumn("description", F.lit(None).cast("string"))
    _nxt, rejected = SY.insert_checked(C.doc_state(spark, d), every.unionByName(blank), required=["description"])
    return rejected.select(*SY.KEY, "description", "reason")


@register("update_affected", sql(["state"], f"""
    SELECT count(*) AS affected FROM state WHERE context = 'en' AND updated_at < TIMESTAMP '{STALE_BEFORE}'"""))
def update_affected(spark, d):
    pred = (F.col("context") == "en") & (F.col("updated_at") < F.lit(STALE_BEFORE).cast("timestamp_ntz"))
    return SY.affected(C.doc_state(spark, d), pred)


@register("delete_where", sql(["state"], """
    SELECT * FROM state WHERE NOT (context = 'de' AND starts_with(filepath, 'src1'))"""))
def delete_where(spark, d):
    pred = (F.col("context") == "de") & F.col("filepath").startswith("src1")
    return SY.delete_where(C.doc_state(spark, d), pred)


# Fixed values of the example summariser: ASCII whitespace separates words.
WHITESPACE = " \t\n\r\f\v"


def word_summary(text):
    """Example enrichment function (stands in for a model call): fails on empty text."""
    import re
    if text is None or not text.strip(WHITESPACE):
        raise ValueError("empty content")
    words = re.split(r"[ \t\n\r\f\v]+", text.strip(WHITESPACE))
    return f"{len(words)} words, {text.count(chr(10)) + 1} lines"


_SQL_WS = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"


@register("enrich_batch", sql(["allfiles"], f"""
    SELECT repository, context, filepath,
           CASE WHEN content IS NULL OR trim(content, {_SQL_WS}) = '' THEN NULL
                ELSE len(string_split_regex(trim(content, {_SQL_WS}), '[ \\t\\n\\r\\f\\v]+'))::VARCHAR || ' words, '
                     || (length(content) - length(replace(content, chr(10), '')) + 1)::VARCHAR || ' lines' END
             AS summary,
           CASE WHEN content IS NULL OR trim(content, {_SQL_WS}) = '' THEN 'ValueError: empty content' END AS error
    FROM allfiles"""))
def enrich_batch(spark, d):
    files = C.doc_file_table(spark, d)
    out = EN.enrich_batch(files, word_summary, input_col="content", output_col="summary")
    return out.select(*SY.KEY, "summary", "error")


@register("stream_sync", sql([], """
    SELECT source, doc_id, lang, n_chars FROM (
      SELECT source, doc_id, lang, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS rn
      FROM documents) WHERE rn = 1"""))
def stream_sync(spark, d):
    from quarry.streaming.sync import stream_latest_per_key_from_table
    return stream_latest_per_key_from_table(spark, d)


# Versions of files: the documents of a source share its forty paths, the latest holds.
_VERSION_PATHS = 40


@register("stream_documents", sql([], f"""
    SELECT repository, context, filepath, description, updated_at FROM (
      SELECT *, row_number() OVER (PARTITION BY repository, context, filepath ORDER BY updated_at DESC, md5(content) DESC) AS rn,
             'summary of ' || filepath || ': ' || (length(content) - length(replace(content, chr(10), '')) + 1)::VARCHAR || ' lines' AS description
      FROM (SELECT 'repo' || (doc_id % 2)::VARCHAR AS repository, lang AS context, text AS content,
                   source || '/' || (doc_id % {_VERSION_PATHS})::VARCHAR || '.txt' AS filepath,
                   TIMESTAMP '2024-01-01 00:00:00' + to_minutes(((doc_id * 53) % 1440)::BIGINT) AS updated_at FROM documents)
      WHERE length(content) > 0)
    WHERE rn = 1"""))
def stream_documents(spark, d):
    """Every document arrives as a version of a file, in about four micro-batches in no order of time;
    the table in buckets ends with the latest version of each."""
    import uuid

    from quarry.session import scratch_path
    from quarry.streaming.documents import continuous_load
    root = scratch_path(spark, f"stream-documents-{uuid.uuid4().hex}")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    C.doc_versions(spark, d, _VERSION_PATHS).repartition(n, F.xxhash64("content")).write.parquet(f"{root}/incoming")
    state = continuous_load(spark, f"{root}/incoming", root=f"{root}/state", checkpoint=f"{root}/checkpoint", max_files_per_trigger=-(-n // 4))
    return state.select(*SY.KEY, "description", "updated_at")


# The load command end to end: prune + classify + summarise + embed + upsert.
_EMBED_DIM = 64
derived("loadchanges", ("cls", "incoming"), f"""
    SELECT c.repository, c.context, c.filepath, i.content, c.modified_at FROM cls c
    JOIN incoming i ON i.repository = c.repository AND i.context = c.context AND i.filepath = c.filepath
    WHERE c.class IN ('insert', 'update')""")
derived("loadembed", ("loadchanges",), f"""
    SELECT repository, context, filepath,
           CASE WHEN sumsq > 0 THEN list_transform(counts, lambda x: (x / sqrt(sumsq))::FLOAT) END AS embedding
    FROM (SELECT *, list_sum(list_transform(counts, lambda x: (x * x)::DOUBLE)) AS sumsq FROM (
      SELECT repository, context, filepath,
             list_transform(range(0, {_EMBED_DIM}), lambda j: len(list_filter(b, lambda x: x = j))::BIGINT) AS counts
      FROM (SELECT repository, context, filepath,
                   list_transform(list_filter(string_split_regex(lower({SQL_DESCRIBE}), '{EN.TOKEN_SPLIT}'), lambda w: w <> ''),
                                  lambda w: ('0x' || substr(md5(w), 1, {EN.HASH_HEX_DIGITS}))::INTEGER % {_EMBED_DIM})
                     AS b
            FROM loadchanges)))""")
derived("loadpruned", ("state", "incoming"), f"""
    SELECT a.*, NULL::FLOAT[] AS embedding FROM state a
    WHERE EXISTS (SELECT 1 FROM incoming b WHERE {ON_KEY})
       OR NOT EXISTS (SELECT 1 FROM incoming b WHERE b.repository = a.repository AND b.context = a.context)""")
_MERGE_LOAD = f"""
    SELECT a.id, coalesce(a.repository, b.repository) AS repository, coalesce(a.context, b.context) AS context,
           coalesce(a.filepath, b.filepath) AS filepath,
           CASE WHEN b.filepath IS NOT NULL THEN b.description ELSE a.description END AS description,
           CASE WHEN b.filepath IS NOT NULL THEN b.updated_at ELSE a.updated_at END AS updated_at,
           CASE WHEN b.filepath IS NOT NULL THEN b.embedding ELSE a.embedding END AS embedding
    FROM loadpruned a FULL OUTER JOIN (
      SELECT c.repository, c.context, c.filepath, {SQL_DESCRIBE.replace("filepath", "c.filepath")} AS description,
             TIMESTAMP '{LOADED_AT}' AS updated_at, e.embedding
      FROM loadchanges c JOIN loadembed e
        ON e.repository = c.repository AND e.context = c.context AND e.filepath = c.filepath) b ON {ON_KEY}"""


@register("load_documents", sql(["loadpruned", "loadchanges", "loadembed"], sql_with_new_ids(
    f"SELECT * FROM ({_MERGE_LOAD}) WHERE id IS NOT NULL", f"SELECT * FROM ({_MERGE_LOAD}) WHERE id IS NULL",
    cols="id, repository, context, filepath, description, updated_at, embedding")))
def load_documents(spark, d):
    from quarry.operators.load import load_documents as load
    state = C.doc_state(spark, d).withColumn("embedding", F.lit(None).cast("array<float>"))
    nxt, _errors = load(state, C.doc_incoming(spark, d), dim=_EMBED_DIM, loaded_at=dt.datetime.fromisoformat(LOADED_AT))
    return nxt


@register("sync_twice", sql(["cls"], """
    SELECT CASE WHEN class IN ('insert', 'update') THEN 'fresh' ELSE class END AS class, count(*) AS n
    FROM cls WHERE class <> 'prune' GROUP BY 1"""))
def sync_twice(spark, d):
    """What a second load of the same files finds: nothing to insert or update."""
    inc = C.doc_incoming(spark, d)
    state = C.doc_state(spark, d)
    once = SY.upsert(SY.prune(state, inc), _changes(spark, d))
    return SY.classify(once, inc, keep_content=False).groupBy("class").agg(F.count("*").alias("n"))
