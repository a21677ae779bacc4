"""Block index queries (G1-G7) over Go, HCL and Python files derived from the
part and supplier tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import blocks as BK
from quarry.plans.catalog import register
from quarry.plans.oracle import sql
from quarry.sources import code_shapes as SH
from quarry.sources import corpus as C
from quarry.sources.tables import read_table


def _go(spark, d):
    return BK.go_index(C.go_files(spark, d))


@register("block_index_go", sql(["gofuncs", "govars"], """
    SELECT 'function' AS kind, path, name, start_line, end_line, content FROM gofuncs
    UNION ALL SELECT 'var', path, name, start_line, end_line, name FROM govars"""))
def block_index_go(spark, d):
    funcs, vars_ = _go(spark, d)
    cols = ["path", "name", "start_line", "end_line", "content"]
    return funcs.select(F.lit("function").alias("kind"), *cols).unionByName(
        vars_.select(F.lit("var").alias("kind"), *cols))


@register("block_index_hcl", sql(["hclblocks"], """
    SELECT path, block_type, block_name, start_line, end_line, content FROM hclblocks"""))
def block_index_hcl(spark, d):
    blocks, _ = BK.hcl_index(C.hcl_files(spark, d))
    return blocks.select("path", "block_type", "block_name", "start_line", "end_line", "content")


@register("hcl_attributes", sql(["hclattrs"], "SELECT * FROM hclattrs"))
def hcl_attributes(spark, d):
    _, attrs = BK.hcl_index(C.hcl_files(spark, d))
    return attrs.select("path", "block_name", "block_start", "name", "value", "line_no")


def py_files(spark, d):
    """One Python file per part: a function, a nested function and two assignments."""
    p = read_table(spark, d, "part", "p_partkey", "p_size")
    k = F.col("p_partkey").cast("string")
    content = F.concat(F.lit("def f"), k, F.lit("():\n    def inner():\n        return "), F.col("p_size").cast("string"),
                       F.lit("\n    return inner()\n\n\nx"), k, F.lit(" = 1\ny, z = 2, 3\n"))
    return p.select(F.concat(F.lit("p"), k, F.lit(".py")).alias("path"), content.alias("content"))


@register("block_index_python", sql([], """
    SELECT 'p' || p_partkey::VARCHAR || '.py' AS path, kind, name, start_line, end_line, NULL::VARCHAR AS error
    FROM part, (VALUES ('function', 'f', 1, 4), ('function', 'inner', 2, 3), ('var', 'x', 7, 7))
               AS t(kind, prefix, start_line, end_line),
         LATERAL (SELECT CASE WHEN prefix = 'inner' THEN 'inner' ELSE prefix || p_partkey::VARCHAR END AS name)"""))
def block_index_python(spark, d):
    return BK.python_index(py_files(spark, d))


def _all_files(spark, d):
    return C.go_files(spark, d).unionByName(C.hcl_files(spark, d)).unionByName(py_files(spark, d))


@register("block_candidates", sql(["gofuncs", "hclblocks"], """
    SELECT path, 'function' AS target_type, name AS target_name, start_line, end_line FROM gofuncs
    UNION ALL
    SELECT path, block_type, block_name, start_line, end_line FROM hclblocks
    UNION ALL
    SELECT 'p' || p_partkey::VARCHAR || '.py', 'file', 'p' || p_partkey::VARCHAR || '.py', 1, 9 FROM part"""))
def block_candidates(spark, d):
    return BK.block_candidates(_all_files(spark, d))


def _requests(spark, d):
    li = read_table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_linenumber")
    k = F.col("l_partkey").cast("string")
    return li.select(F.concat(F.col("l_orderkey").cast("string"), F.lit(":"), F.col("l_linenumber").cast("string"),
                              F.lit(":"), k).alias("req_id"),
                     F.concat(F.lit("f"), k, F.lit(".go")).alias("path"), F.lit("function").alias("target_type"),
                     F.concat(F.lit("F"), k).alias("target_name"))


@register("block_lookup", sql(["gofuncs"], """
    SELECT DISTINCT r.path, r.target_type, r.target_name, f.start_line, f.end_line, f.content, f.path IS NOT NULL AS found
    FROM (SELECT 'f' || l_partkey::VARCHAR || '.go' AS path, 'function' AS target_type,
                 'F' || l_partkey::VARCHAR AS target_name FROM lineitem
          UNION ALL SELECT 's' || s_suppkey::VARCHAR || '.tf', 'function', 'F' || s_suppkey::VARCHAR FROM supplier) r
    LEFT JOIN gofuncs f ON f.path = r.path AND f.name = r.target_name"""))
def block_lookup(spark, d):
    funcs, _ = _go(spark, d)
    index = funcs.select("path", F.lit("function").alias("target_type"), F.col("name").alias("target_name"),
                         "start_line", "end_line", "content")
    s = read_table(spark, d, "supplier", "s_suppkey")
    missing = s.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit(".tf")).alias("path"),
                       F.lit("function").alias("target_type"),
                       F.concat(F.lit("F"), F.col("s_suppkey").cast("string")).alias("target_name"))
    req = _requests(spark, d).drop("req_id").unionByName(missing)
    return BK.block_lookup(index, req).distinct()


# the formatted bodies of the supplier resources, by shape
_BODIES = (
    '\nname = "a}b"\nnested {\n  nation = <v>\n}\n',
    None,
    '\nname   = "${var.a["}"]}-x" // c\nnation = { id = <v>, n = 2 }\n\nnested "l" {\n  on = true\n}\n',
)


@register("resource_content", sql([], " UNION ALL ".join(f"""
    SELECT 's' || s_suppkey::VARCHAR || '.tf' AS path, 's' || s_suppkey::VARCHAR AS name,
           {SH.sql(body, v="s_nationkey")} AS content, NULL::VARCHAR AS error
    FROM supplier WHERE s_suppkey % 3 = {i}""" for i, body in enumerate(_BODIES) if body) + """
    UNION ALL SELECT 's' || s_suppkey::VARCHAR || '.tf', 'none' || s_suppkey::VARCHAR, NULL,
           'resource block not found: none' || s_suppkey::VARCHAR FROM supplier"""))
def resource_content(spark, d):
    """Bodies of the resources of two shapes, and a request for a name that no file has."""
    blocks, _ = BK.hcl_index(C.hcl_files(spark, d))
    s = read_table(spark, d, "supplier", "s_suppkey")
    k = F.col("s_suppkey").cast("string")
    path = F.concat(F.lit("s"), k, F.lit(".tf")).alias("path")
    known = s.filter(F.col("s_suppkey") % 3 != 1).select(path, F.concat(F.lit("s"), k).alias("name"))
    return BK.resource_content(blocks, known.unionByName(s.select(path, F.concat(F.lit("none"), k).alias("name"))))


@register("block_match", sql(["gofuncs", "hclblocks"], """
    SELECT DISTINCT l_orderkey::VARCHAR || ':' || l_linenumber::VARCHAR || ':' || l_partkey::VARCHAR AS req_id,
           f.path, 'function' AS target_type, f.name AS target_name, f.start_line, f.end_line
    FROM lineitem JOIN gofuncs f ON f.path = 'f' || l_partkey::VARCHAR || '.go' AND f.name = 'F' || l_partkey::VARCHAR
    UNION ALL
    SELECT 'file:' || s_suppkey::VARCHAR, b.path, b.block_type, b.block_name, b.start_line, b.end_line
    FROM supplier JOIN hclblocks b ON b.path = 's' || s_suppkey::VARCHAR || '.tf'"""))
def block_match(spark, d):
    cands = BK.block_candidates(C.go_files(spark, d).unionByName(C.hcl_files(spark, d)))
    s = read_table(spark, d, "supplier", "s_suppkey")
    whole = s.select(F.concat(F.lit("file:"), F.col("s_suppkey").cast("string")).alias("req_id"),
                     F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit(".tf")).alias("path"),
                     F.lit("file").alias("target_type"), F.lit("").alias("target_name"))
    return BK.block_match(_requests(spark, d).unionByName(whole), cands).distinct()


def located_json(spark, d):
    """The locator's output per order, as JSON text in the model's exact key casing."""
    o = read_table(spark, d, "orders", "o_orderkey", "o_orderpriority")
    li = read_table(spark, d, "lineitem", "l_orderkey", "l_partkey")
    files = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct(
        F.concat(F.lit("f"), F.col("l_partkey").cast("string"), F.lit(".go")).alias("path"),
        F.array(F.struct(F.lit("function").alias("block_type"),
                         F.concat(F.lit("F"), F.col("l_partkey").cast("string")).alias("name"))).alias("blocks"),
    ))).alias("files"))
    j = o.join(files, "o_orderkey").select(F.to_json(F.struct(
        F.col("o_orderpriority").alias("Query"), F.struct("files").alias("BlockList"))).alias("json"))
    return j


@register("located_blocks", sql([], """
    SELECT o_orderpriority AS query, 'f' || l_partkey::VARCHAR || '.go' AS path, 'function' AS block_type,
           'F' || l_partkey::VARCHAR AS name
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey"""))
def located_blocks(spark, d):
    return BK.located_blocks(located_json(spark, d))
