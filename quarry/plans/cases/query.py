"""Relational API queries (J1-J13) on the stored documents table."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import query as Q
from quarry.plans.catalog import register
from quarry.plans.oracle import sql
from quarry.sources import corpus as C
from quarry.sources.tables import read_table

T0, T1 = "2024-01-01 06:00:00", "2024-01-01 18:00:00"


def _state(spark, d):
    return C.doc_table(spark, d)


def _ts(s):
    return F.lit(s).cast("timestamp_ntz")


@register("pred_eq", sql(["doctable"], "SELECT * FROM doctable WHERE context = 'en' AND repository <> 'repo1'"))
def pred_eq(spark, d):
    return _state(spark, d).filter((F.col("context") == "en") & (F.col("repository") != "repo1"))


@register("pred_in", sql(["doctable"], """
    SELECT * FROM doctable WHERE context IN ('de', 'fr') AND repository NOT IN ('repo0')"""))
def pred_in(spark, d):
    s = _state(spark, d)
    return s.filter(F.col("context").isin("de", "fr") & ~F.col("repository").isin("repo0"))


@register("pred_range", sql(["doctable"], f"""
    SELECT * FROM doctable WHERE updated_at >= TIMESTAMP '{T0}' AND updated_at < TIMESTAMP '{T1}'
      AND filepath > 'src5'"""))
def pred_range(spark, d):
    s = _state(spark, d)
    return s.filter((F.col("updated_at") >= _ts(T0)) & (F.col("updated_at") < _ts(T1))
                    & (F.col("filepath") > "src5"))


@register("pred_string", sql(["doctable"], """
    SELECT * FROM doctable WHERE contains(description, 'the') AND starts_with(filepath, 'src1')
      AND suffix(filepath, '1.txt')"""))
def pred_string(spark, d):
    s = _state(spark, d)
    return s.filter(F.col("description").contains("the") & F.col("filepath").startswith("src1")
                    & F.col("filepath").endswith("1.txt"))


@register("pred_fold", sql(["doctable"], """
    SELECT * FROM doctable WHERE lower(context) = lower('EN') OR contains(lower(description), lower('ÉTION'))"""))
def pred_fold(spark, d):
    s = _state(spark, d)
    return s.filter(Q.equal_fold("context", "EN") | Q.contains_fold("description", "ÉTION"))


@register("pred_bool", sql(["doctable"], """
    SELECT * FROM doctable WHERE NOT ((context = 'en' AND repository = 'repo0') OR starts_with(filepath, 'src2'))"""))
def pred_bool(spark, d):
    s = _state(spark, d)
    return s.filter(~(((F.col("context") == "en") & (F.col("repository") == "repo0"))
                      | F.col("filepath").startswith("src2")))


@register("project", sql(["doctable"], "SELECT filepath, context FROM doctable"))
def project(spark, d):
    return _state(spark, d).select("filepath", "context")


@register("project_entity", sql(["doctable"], "SELECT id, filepath, context FROM doctable"))
def project_entity(spark, d):
    return _state(spark, d).select("id", "filepath", "context")


@register("order_by", sql(["doctable"], "SELECT id, filepath, updated_at FROM doctable ORDER BY updated_at DESC, id"))
def order_by(spark, d):
    return _state(spark, d).select("id", "filepath", "updated_at").orderBy(F.desc("updated_at"), "id")


@register("page", sql(["doctable"], "SELECT id, filepath FROM doctable ORDER BY filepath, id LIMIT 20 OFFSET 10"))
def page(spark, d):
    return Q.page(_state(spark, d).select("id", "filepath"), ["filepath", "id"], offset=10, limit=20)


@register("only", sql(["doctable"], "SELECT * FROM doctable WHERE filepath = 'src1/1.txt'"))
def only(spark, d):
    return Q.only(_state(spark, d).filter(F.col("filepath") == "src1/1.txt"))


@register("ids", sql(["doctable"], "SELECT id FROM doctable WHERE context = 'fr'"))
def ids(spark, d):
    return _state(spark, d).filter(F.col("context") == "fr").select("id")


@register("count_where", sql(["doctable"], "SELECT count(*) AS n FROM doctable WHERE context = 'en'"))
def count_where(spark, d):
    return Q.count_where(_state(spark, d), F.col("context") == "en")


@register("exists_where", sql(["doctable"], """
    SELECT count(*) > 0 AS "exists" FROM (SELECT 1 FROM doctable WHERE starts_with(filepath, 'src19/') LIMIT 1)"""))
def exists_where(spark, d):
    return Q.exists(_state(spark, d).filter(F.col("filepath").startswith("src19/")))


@register("distinct_fields", sql(["doctable"], "SELECT DISTINCT repository, context FROM doctable"))
def distinct_fields(spark, d):
    return _state(spark, d).select("repository", "context").distinct()


@register("count_distinct", sql(["doctable"], """
    SELECT count(DISTINCT context) AS n_contexts, count(DISTINCT repository) AS n_repositories FROM doctable"""))
def count_distinct(spark, d):
    return _state(spark, d).agg(F.countDistinct("context").alias("n_contexts"),
                                F.countDistinct("repository").alias("n_repositories"))


@register("group_by", sql(["doctable"], "SELECT repository, context, count(*) AS n FROM doctable GROUP BY 1, 2"))
def group_by(spark, d):
    return _state(spark, d).groupBy("repository", "context").agg(F.count("*").alias("n"))


@register("agg_group", sql(["doctable"], """
    SELECT context, count(*) AS n, max(updated_at) AS max_updated, min(updated_at) AS min_updated,
           avg(length(description)) AS mean_chars, sum(id)::BIGINT AS sum_id
    FROM doctable GROUP BY context"""))
def agg_group(spark, d):
    return _state(spark, d).groupBy("context").agg(
        F.count("*").alias("n"), F.max("updated_at").alias("max_updated"), F.min("updated_at").alias("min_updated"),
        F.avg(F.length("description")).alias("mean_chars"), F.sum("id").alias("sum_id"))


@register("agg_global", sql(["doctable"], """
    SELECT count(*) AS n, max(id) AS max_id, min(id) AS min_id, avg(id) AS mean_id, sum(id)::BIGINT AS sum_id
    FROM doctable"""))
def agg_global(spark, d):
    return _state(spark, d).agg(F.count("*").alias("n"), F.max("id").alias("max_id"), F.min("id").alias("min_id"),
                                F.avg("id").alias("mean_id"), F.sum("id").alias("sum_id"))


@register("pred_id", sql(["doctable"], """
    SELECT id, filepath FROM doctable WHERE id IN (3, 5, 8) OR (id >= 20 AND id < 90 AND id <> 50) OR id > 150"""))
def pred_id(spark, d):
    i = F.col("id")
    return _state(spark, d).filter(i.isin(3, 5, 8) | ((i >= 20) & (i < 90) & (i != 50)) | (i > 150)).select("id", "filepath")


@register("pred_embedding", sql(["vectors"], """
    SELECT v.id, v.embedding = q.embedding AS same, v.embedding > q.embedding AS greater
    FROM vectors v, (SELECT embedding FROM vectors WHERE id = 1) q WHERE v.embedding <> q.embedding OR v.embedding <= q.embedding"""))
def pred_embedding(spark, d):
    """Equality and order of whole vectors, element by element as arrays compare."""
    v = C.vectors(spark, d)
    one = v.withColumn("__q", v.filter(F.col("id") == 1).select("embedding").scalar())
    e, q = F.col("embedding"), F.col("__q")
    return one.filter((e != q) | (e <= q)).select("id", (e == q).alias("same"), (e > q).alias("greater"))


@register("first_row", sql(["doctable"], "SELECT id, filepath, updated_at FROM doctable ORDER BY updated_at DESC, id LIMIT 1"))
def first_row(spark, d):
    return Q.first(_state(spark, d).select("id", "filepath", "updated_at"), [F.desc("updated_at"), F.col("id")])


@register("get_row", sql(["doctable"], "SELECT * FROM doctable WHERE id = 7"))
def get_row(spark, d):
    return Q.get(_state(spark, d), 7)


@register("offset_rows", sql(["doctable"], "SELECT id, filepath FROM doctable ORDER BY filepath, id OFFSET 25"))
def offset_rows(spark, d):
    """Everything after the first 25 rows, without a limit."""
    return Q.page(_state(spark, d).select("id", "filepath"), ["filepath", "id"], offset=25)


@register("update_one", sql(["doctable"], "SELECT id, CASE WHEN id = 7 THEN 'set' ELSE filepath END AS filepath FROM doctable"))
def update_one(spark, d):
    return Q.update_one(_state(spark, d).select("id", "filepath"), 7, {"filepath": F.lit("set")})


@register("scan_typed", sql([], """
    SELECT doc_id::VARCHAR AS strings, n_chars::INTEGER AS ints, n_chars::DOUBLE AS float64s, (n_chars % 2)::BOOLEAN AS bools FROM documents"""))
def scan_typed(spark, d):
    """The scalar forms side by side over every document."""
    docs = read_table(spark, d, "documents", "doc_id", "n_chars")
    cols = {"strings": F.col("doc_id"), "ints": F.col("n_chars"), "float64s": F.col("n_chars"), "bools": F.col("n_chars") % 2}
    return docs.select(*(c.alias(k) for k, c in cols.items())).select(*(F.col(k).cast(Q.SCALARS[k]).alias(k) for k in cols))
