"""Vector search queries (D1-D8) over the ``embeddings`` table."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import enrich as EN
from quarry.operators import vector_index as VI
from quarry.operators import vectors as V
from quarry.plans.catalog import register
from quarry.plans.oracle import cosine, l2, sql
from quarry.sources import corpus as C
from quarry.sources.tables import read_table

QUERY_ID = 0  # the vector used as the search query
K_SEARCH = 10  # retrieval k of the reference
K_NEIGHBORS = 5
DIM = 64


def _scoped_query(v):
    """The query row as a one-row scalar subquery struct (scope + vector)."""
    return v.filter(F.col("id") == QUERY_ID).select(F.struct("repository", "context", "embedding")).scalar()


def flagship(spark, d):
    v = C.vectors(spark, d)
    scoped = v.withColumn("__qs", _scoped_query(v)).filter(
        (F.col("repository") == F.col("__qs.repository")) & (F.col("context") == F.col("__qs.context")))
    hits = V.knn_search(scoped, F.col("__qs.embedding"), K_SEARCH)
    return hits.select("id", "repository", "context", "filepath", "score")


register("vector_search_l2", sql(["vectors"], f"""
    SELECT v.id, v.repository, v.context, v.filepath, {l2('v.embedding', 'q.embedding')} AS score
    FROM vectors v, (SELECT * FROM vectors WHERE id = {QUERY_ID}) q
    WHERE v.repository = q.repository AND v.context = q.context
    ORDER BY score, v.id LIMIT {K_SEARCH}"""))(flagship)


@register("l2_distance", sql(["vectors"], f"""
    SELECT v.id, {l2('v.embedding', 'q.embedding')} AS score
    FROM vectors v, (SELECT embedding FROM vectors WHERE id = {QUERY_ID}) q"""))
def l2_distance(spark, d):
    v = C.vectors(spark, d)
    q = v.filter(F.col("id") == QUERY_ID).select("embedding").scalar()
    from quarry.functions.vectors import l2_distance as l2d
    return v.withColumn("__q", q).select("id", l2d("embedding", "__q").alias("score"))


# Queries: the vectors whose id is divisible by 100, against all vectors (of their scope).
QUERY_EVERY = 100
BATCH_SQL = f"""
    SELECT qid, id, score, rank FROM (
      SELECT q.id AS qid, c.id AS id, {l2('c.embedding', 'q.embedding')} AS score,
             row_number() OVER (PARTITION BY q.id ORDER BY {l2('c.embedding', 'q.embedding')}, c.id) AS rank
      FROM vectors q JOIN vectors c ON q.repository = c.repository AND q.context = c.context
      WHERE q.id % {QUERY_EVERY} = 0)
    WHERE rank <= {K_SEARCH}"""

NEIGHBORS_SQL = f"""
    SELECT qid, id, score, rank FROM (
      SELECT q.id AS qid, c.id AS id, {cosine('c.embedding', 'q.embedding')} AS score,
             row_number() OVER (PARTITION BY q.id ORDER BY {cosine('c.embedding', 'q.embedding')} NULLS LAST, c.id)
               AS rank
      FROM vectors q, vectors c WHERE q.id <> c.id AND q.id % {QUERY_EVERY} = 0)
    WHERE rank <= {{k}}"""


def batch_hits(spark, d):
    v = C.vectors(spark, d)
    q = v.filter(F.col("id") % QUERY_EVERY == 0).select(F.col("id").alias("qid"), "repository", "context", "embedding")
    return V.knn_join(q, v, K_SEARCH, scope=["repository", "context"]).select(
        "qid", "id", "score", F.col("rank").cast("long"))


def neighbor_hits(spark, d, k):
    v = C.vectors(spark, d)
    q = v.filter(F.col("id") % QUERY_EVERY == 0).select(F.col("id").alias("qid"), "embedding")
    return V.knn_join(q, v, k,
                      metric="cosine", exclude_self=True).select("qid", "id", "score", F.col("rank").cast("long"))


register("vector_search_batch", sql(["vectors"], BATCH_SQL))(batch_hits)


@register("vector_neighbors_cosine", sql(["vectors"], NEIGHBORS_SQL.format(k=K_NEIGHBORS)))
def vector_neighbors_cosine(spark, d):
    return neighbor_hits(spark, d, K_NEIGHBORS)


def _index(spark, rows):
    """A new index over the vectors in the shared scratch folder."""
    import uuid

    from quarry.session import scratch_path
    return VI.build(rows, scratch_path(spark, f"index-{uuid.uuid4().hex}"), dim=DIM, k=K_SEARCH)


def _index_queries(v):
    return v.filter(F.col("id") % QUERY_EVERY == 0).select(F.col("id").alias("qid"), "embedding")


@register("vector_search_ann")
def vector_search_ann(spark, d):
    """Every vector whose id is divisible by 100 against all, through the calibrated index."""
    v = C.vectors(spark, d)
    return VI.search(_index(spark, v), _index_queries(v), K_SEARCH).select("qid", "id", "score", F.col("rank").cast("long"))


@register("vector_index_full", sql(["vectors"], f"""
    SELECT qid, id, score, rank FROM (
      SELECT q.id AS qid, c.id AS id, {l2('c.embedding', 'q.embedding')} AS score,
             row_number() OVER (PARTITION BY q.id ORDER BY {l2('c.embedding', 'q.embedding')}, c.id) AS rank
      FROM vectors q, vectors c WHERE q.id % {QUERY_EVERY} = 0)
    WHERE rank <= {K_SEARCH}"""))
def vector_index_full(spark, d):
    """An index of two labels in three, the others added to it later, searched in all cells: exact."""
    v = C.vectors(spark, d)
    index = VI.add(_index(spark, v.filter(F.col("label") % 3 != 0)), v.filter(F.col("label") % 3 == 0))
    hits = VI.search(index, _index_queries(v), K_SEARCH, nprobe=len(index.cells))
    return hits.select("qid", "id", "score", F.col("rank").cast("long"))


@register("search_report", sql(["vectors"], f"""
    SELECT rank, filepath, score, printf('%d. %s (Score: %.2f)', rank, filepath, score) AS line FROM (
      SELECT v.filepath, v.id, {l2('v.embedding', 'q.embedding')} AS score,
             row_number() OVER (ORDER BY {l2('v.embedding', 'q.embedding')}, v.id)::INTEGER AS rank
      FROM vectors v, (SELECT * FROM vectors WHERE id = {QUERY_ID}) q
      WHERE v.repository = q.repository AND v.context = q.context)
    WHERE rank <= {K_SEARCH}"""))
def search_report(spark, d):
    hits = flagship(spark, d)
    from pyspark.sql import Window
    # k rows only: ranking them in one partition is bounded by k.
    ranked = hits.withColumn("rank", F.row_number().over(Window.orderBy("score", "id")))
    return V.search_report(ranked).select("rank", "filepath", "score", "line")


@register("hash_embed", sql([], f"""
    WITH t AS (
      SELECT doc_id, list_transform(list_filter(string_split_regex(lower(text), '{EN.TOKEN_SPLIT}'),
                                                lambda w: w <> ''),
                                    lambda w: ('0x' || substr(md5(w), 1, {EN.HASH_HEX_DIGITS}))::INTEGER % {DIM}) AS b
      FROM documents),
    c AS (
      SELECT doc_id, list_transform(range(0, {DIM}), lambda i: len(list_filter(b, lambda x: x = i))::BIGINT) AS counts
      FROM t),
    n AS (SELECT doc_id, counts, list_sum(list_transform(counts, lambda x: (x * x)::DOUBLE)) AS sumsq FROM c)
    SELECT doc_id, counts,
           CASE WHEN sumsq > 0 THEN list_transform(counts, lambda x: (x / sqrt(sumsq))::FLOAT) END AS embedding
    FROM n"""))
def hash_embed(spark, d):
    docs = read_table(spark, d, "documents", "doc_id", "text")
    return EN.hash_embed(docs, id_col="doc_id", text_col="text", dim=DIM)


@register("vector_dim_check", sql([], f"""
    SELECT len(embedding)::INTEGER AS dim, count(*) AS n_vectors,
           sum(CASE WHEN list_count(embedding) < len(embedding) THEN 1 ELSE 0 END)::BIGINT AS n_with_nulls,
           (len(embedding) = {DIM} AND sum(CASE WHEN list_count(embedding) < len(embedding) THEN 1 ELSE 0 END) = 0)
             AS ok
    FROM embeddings GROUP BY len(embedding)"""))
def vector_dim_check(spark, d):
    e = read_table(spark, d, "embeddings", "vec_id", "embedding")
    return V.dimension_report(e, DIM)
