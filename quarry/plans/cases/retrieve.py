"""Retrieval and context queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry import schemas as S
from quarry.operators import retrieve as R
from quarry.plans.cases.vectors import BATCH_SQL, K_SEARCH, NEIGHBORS_SQL, batch_hits, neighbor_hits
from quarry.plans.catalog import register
from quarry.plans.oracle import derived, l2, sql
from quarry.sources import corpus as C
from quarry.sources.tables import read_table

derived("vhits", ("vectors",), f"""
    SELECT h.qid, v.filepath, h.rank FROM ({BATCH_SQL}) h JOIN vectors v ON v.id = h.id""")
derived("vfirst", ("vhits",), """
    SELECT qid, filepath, row_number() OVER (PARTITION BY qid ORDER BY r, filepath) AS rank
    FROM (SELECT qid, filepath, min(rank) AS r FROM vhits GROUP BY qid, filepath)""")
derived("nhits", ("vectors",), f"""
    SELECT h.qid, v.filepath, h.rank FROM ({NEIGHBORS_SQL.format(k=K_SEARCH)}) h JOIN vectors v ON v.id = h.id""")


def _with_paths(hits, v):
    return hits.join(v.select("id", "filepath"), "id").select("qid", "filepath", "rank")


def _vector_first(spark, d):
    return R.first_per_path(_with_paths(batch_hits(spark, d), C.vectors(spark, d)))


@register("retrieve_vector", sql(["vfirst", "docfiles"], """
    SELECT h.qid, h.rank, h.filepath, f.content IS NULL AS missing, length(f.content) AS content_chars
    FROM vfirst h LEFT JOIN docfiles f ON f.path = h.filepath"""))
def retrieve_vector(spark, d):
    hits = R.attach_content(_vector_first(spark, d), C.doc_files(spark, d))
    return hits.select("qid", "rank", "filepath", "missing", F.length("content").cast("long").alias("content_chars"))


def _path_lists(spark, d):
    """Ordered file lists per order, round-tripped through the model's JSON shape."""
    li = read_table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_linenumber")
    lists = li.groupBy(F.col("l_orderkey").alias("qid")).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("l_linenumber", F.concat(F.lit("f"), F.col("l_partkey").cast("string"),
                                                                      F.lit(".go")).alias("p")))),
        lambda x: x["p"]).alias("paths"))
    js = lists.select("qid", F.to_json(F.struct("paths")).alias("json"))
    return js.select("qid", F.from_json("json", S.FILE_LIST)["paths"].alias("paths"))


@register("retrieve_paths", sql(["gofiles"], """
    SELECT l.qid, l.pos, l.path, length(f.content) AS content_chars
    FROM (SELECT l_orderkey AS qid, 'f' || l_partkey::VARCHAR || '.go' AS path,
                 (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, 'f' || l_partkey::VARCHAR || '.go')
                  - 1)::INTEGER AS pos FROM lineitem) l
    JOIN gofiles f ON f.path = l.path"""))
def retrieve_paths(spark, d):
    out = R.paths_from_lists(_path_lists(spark, d), C.go_files(spark, d))
    return out.select("qid", "pos", "path", F.length("content").cast("long").alias("content_chars"))


@register("retrieve_ensemble", sql(["vfirst", "nhits"], """
    SELECT qid, filepath, retriever, rank,
           row_number() OVER (PARTITION BY qid ORDER BY retriever, rank, filepath) AS position
    FROM (SELECT *, row_number() OVER (PARTITION BY qid, filepath ORDER BY retriever, rank) AS k
          FROM (SELECT qid, filepath, 1 AS retriever, rank FROM vfirst
                UNION ALL SELECT qid, filepath, 2 AS retriever, rank FROM nhits))
    WHERE k = 1"""))
def retrieve_ensemble(spark, d):
    v = C.vectors(spark, d)
    second = _with_paths(neighbor_hits(spark, d, K_SEARCH), v)
    return R.ensemble([_vector_first(spark, d), second])


@register("relevance_filter", sql([], """
    SELECT doc_id, source || '/' || doc_id::VARCHAR || '.txt' AS path FROM documents
    WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)"""))
def relevance_filter(spark, d):
    docs = read_table(spark, d, "documents", "doc_id", "source").select(
        "doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"))
    verdicts = read_table(spark, d, "labels", "doc_id", "quality").select(
        "doc_id", (F.col("quality") == 1).alias("answer"))
    return R.relevance_filter(docs, verdicts, on=["doc_id"])


derived("located", (), """
    SELECT DISTINCT path FROM (
      SELECT 'f' || l_partkey::VARCHAR || '.go' AS path FROM lineitem
      UNION ALL SELECT 's' || l_suppkey::VARCHAR || '.tf' FROM lineitem
      UNION ALL SELECT 's' || l_suppkey::VARCHAR || '.go' FROM lineitem)""")


def _located(spark, d):
    li = read_table(spark, d, "lineitem", "l_partkey", "l_suppkey")
    p, s = F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
    return li.select(F.explode(F.array(F.concat(F.lit("f"), p, F.lit(".go")), F.concat(F.lit("s"), s, F.lit(".tf")),
                                       F.concat(F.lit("s"), s, F.lit(".go")))).alias("path")).distinct()


@register("paths_verified", sql(["located", "gofiles", "hclfiles"], """
    SELECT l.path, m.path IS NOT NULL AS "exists"
    FROM located l LEFT JOIN (SELECT path FROM gofiles UNION SELECT path FROM hclfiles) m ON m.path = l.path"""))
def paths_verified(spark, d):
    man = C.go_files(spark, d).select("path").unionByName(C.hcl_files(spark, d).select("path"))
    return R.verify_paths(_located(spark, d), man)


MAX_TURNS = 200
_CHUNK = f"floor(turn / {MAX_TURNS})::INTEGER AS chunk"


@register("context_pack", sql([], f"""
    SELECT conv_id, chunk, string_agg(role || ': ' || text, chr(10) || chr(10) ORDER BY turn) AS text,
           count(*) AS n_items
    FROM (SELECT *, {_CHUNK} FROM conversations) GROUP BY conv_id, chunk"""))
def context_pack(spark, d):
    c = read_table(spark, d, "conversations", "conv_id", "turn", "role", "text")
    return R.pack(c, ["conv_id"], "turn", F.concat("role", F.lit(": "), "text"), sep="\n\n", max_items=MAX_TURNS)


@register("message_pack", sql([], f"""
    SELECT conv_id, chunk, list({{'type': CASE WHEN role IN {tuple(R.ROLES)} THEN role ELSE 'system' END,
                                  'content': text}} ORDER BY turn) AS messages
    FROM (SELECT *, {_CHUNK} FROM conversations) GROUP BY conv_id, chunk"""))
def message_pack(spark, d):
    c = read_table(spark, d, "conversations", "conv_id", "turn", "role", "text")
    return R.messages(c, group="conv_id", order="turn", max_items=MAX_TURNS)


@register("context_layouts", sql(["gofiles", "gofuncs"], """
    , f AS (SELECT p_size AS qid, p_partkey AS pos, (p_partkey // 200)::INTEGER AS chunk, g.path, g.content, n.name
            FROM part JOIN gofiles g ON g.path = 'f' || p_partkey::VARCHAR || '.go' LEFT JOIN gofuncs n ON n.path = g.path)
    SELECT qid, chunk, count(*) AS n_items,
           string_agg(chr(10) || '### File: ' || path || ' ###' || chr(10) || '```' || chr(10) || content || chr(10) || '```', '' ORDER BY pos) AS located,
           string_agg(chr(10) || '--------------------' || chr(10) || 'filepath:' || path || chr(10) || '--' || content || chr(10) || '--- content end---' || chr(10)
                      || '--- blocks ---' || chr(10) || coalesce(chr(10) || '- function: ' || name, 'No blocks found'), '' ORDER BY pos) AS planned,
           string_agg('--- ' || path || ' start ---' || chr(10) || content || chr(10) || '--- ' || path || ' end ---' || chr(10), '' ORDER BY pos) AS investigated
    FROM f GROUP BY qid, chunk"""))
def context_layouts(spark, d):
    """The Go files of each part size as context, in the layouts of the locator, the planner and the investigation."""
    from quarry.operators import blocks as BK
    files = C.go_files(spark, d)
    funcs, _ = BK.go_index(files)
    listed = funcs.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start", F.lit("function").alias("target_type"), F.col("name").alias("target_name")))).alias("blocks"))
    ranked = read_table(spark, d, "part", "p_partkey", "p_size").select(F.col("p_size").alias("qid"), F.col("p_partkey").alias("pos"), F.concat(F.lit("f"), F.col("p_partkey").cast("string"), F.lit(".go")).alias("path"))
    rows = ranked.join(files, "path").join(listed, "path", "left")
    path, content = F.col("path"), F.col("content")
    packed = [R.pack(rows, ["qid"], "pos", text, sep="", out=name, max_items=200) for name, text in (
        ("located", R.located_file(path, content)), ("planned", R.planned_file(path, content, F.col("blocks"))), ("investigated", R.investigated_file(path, content)))]
    out = packed[0]
    for p in packed[1:]:
        out = out.join(p.drop("n_items"), ["qid", "chunk"])
    return out


# The search command end to end: every document embedded, the query text taken
# from the benchmark table, scoped top-k, contents packed in rank order.
SEARCH_ITEM, SEARCH_REPOSITORY, SEARCH_CONTEXT, SEARCH_K = 0, "repo0", "en", 5


def _embed_sql(src: str, id_col: str) -> str:
    from quarry.operators import enrich as EN
    return f"""
      SELECT {id_col}, CASE WHEN sumsq > 0 THEN list_transform(counts, lambda x: (x / sqrt(sumsq))::FLOAT) END
               AS embedding
      FROM (SELECT *, list_sum(list_transform(counts, lambda x: (x * x)::DOUBLE)) AS sumsq FROM (
        SELECT {id_col}, list_transform(range(0, 64), lambda j: len(list_filter(b, lambda x: x = j))::BIGINT) AS counts
        FROM (SELECT {id_col}, list_transform(list_filter(string_split_regex(lower(text), '{EN.TOKEN_SPLIT}'),
                                                          lambda w: w <> ''),
                                              lambda w: ('0x' || substr(md5(w), 1, {EN.HASH_HEX_DIGITS}))::INTEGER % 64)
                       AS b
              FROM {src})))"""


@register("search_documents", sql(["doctable", "docfiles"], f"""
    , emb AS ({_embed_sql("documents", "doc_id")}),
    q AS ({_embed_sql(f"(SELECT 0 AS qid, text FROM benchmark WHERE item_id = {SEARCH_ITEM})", "qid")}),
    hits AS (
      SELECT s.id, s.filepath, {l2('e.embedding', 'q.embedding')} AS score
      FROM doctable s JOIN emb e ON e.doc_id = s.id CROSS JOIN q
      WHERE s.repository = '{SEARCH_REPOSITORY}' AND s.context = '{SEARCH_CONTEXT}'
      ORDER BY score NULLS LAST, s.id LIMIT {SEARCH_K})
    SELECT (SELECT text FROM benchmark WHERE item_id = {SEARCH_ITEM}) AS query,
           string_agg('File: ' || h.filepath || chr(10) || coalesce(f.content, ''), chr(10) || chr(10)
                      ORDER BY h.score NULLS LAST, h.id) AS text,
           count(*) AS n_hits
    FROM hits h LEFT JOIN docfiles f ON f.path = h.filepath"""))
def search_documents(spark, d):
    from quarry.operators import enrich as EN
    from quarry.operators.load import search_context
    emb = EN.hash_embed(read_table(spark, d, "documents", "doc_id", "text"), id_col="doc_id", text_col="text")
    state = C.doc_table(spark, d).join(emb.select(F.col("doc_id").alias("id"), "embedding"), "id")
    files = C.doc_files(spark, d).withColumnRenamed("path", "filepath")
    query = read_table(spark, d, "benchmark", "item_id", "text").filter(F.col("item_id") == SEARCH_ITEM)
    return search_context(spark, state, files, query, repository=SEARCH_REPOSITORY, context=SEARCH_CONTEXT,
                          k=SEARCH_K)
