"""File-tree queries (A1-A7, A11, B1-B5) over the web pages seen as a file tree."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quarry import schemas as S
from quarry.functions import paths as P
from quarry.operators import nested as NE
from quarry.operators import tree as T
from quarry.plans.catalog import register
from quarry.plans.oracle import derived, sql
from quarry.session import scratch_path
from quarry.sources import corpus as C

# Fixed rule set of the tree queries: an include below an excluded directory
# shows the difference between flat rules (A4) and ancestor pruning (A5).
TARGET = "blog.tionsh.example.net"
EXCLUDE = ["blog.tionsh.example.net/en", "ads-track.", "www.cheap-pills.example.com"]
INCLUDE = ["blog.tionsh.example.net/en/1", "ads-track.example.org/en/5"]

_ANC = "list_transform(range(1, len(string_split({p}, '/'))), lambda i: array_to_string(string_split({p}, '/')[1:i], '/'))"
_NODE = """path, string_split(path, '/')[-1] AS name,
       CASE WHEN position('/' IN path) = 0 THEN '' ELSE regexp_replace(path, '/[^/]*$', '') END AS parent,
       len(string_split(path, '/'))::INTEGER AS depth, string_split(path, '/') AS segments"""

derived("sitedirs", ("sitefiles",), f"""
    SELECT DISTINCT unnest({_ANC.format(p='path')}) AS path FROM sitefiles""")
derived("manifest", ("sitefiles", "sitedirs"), f"""
    SELECT {_NODE}, false AS is_dir FROM sitefiles
    UNION ALL SELECT {_NODE}, true AS is_dir FROM sitedirs""")


def _sql_any_prefix(p: str, prefixes: list[str]) -> str:
    return "(" + " OR ".join(f"starts_with({p}, '{x}')" for x in prefixes) + ")" if prefixes else "false"


def _sql_skip(p: str) -> str:
    return f"({_sql_any_prefix(p, EXCLUDE)} AND NOT {_sql_any_prefix(p, INCLUDE)})"


def _manifest(spark, d):
    return T.manifest(C.site_files(spark, d))


@register("manifest", sql(["manifest"], "SELECT path, name, parent, depth, segments, is_dir FROM manifest"))
def manifest(spark, d):
    return _manifest(spark, d)


@register("content_hash", sql(["sitefiles"], """
    SELECT path, sha1('blob ' || octet_length(encode(content))::VARCHAR || chr(0) || content) AS blob_hash,
           octet_length(encode(content))::BIGINT AS size
    FROM sitefiles"""))
def content_hash(spark, d):
    f = C.site_files(spark, d)
    return f.select("path", P.git_blob_hash("content").alias("blob_hash"),
                    F.octet_length("content").cast("long").alias("size"))


@register("subtree_scope", sql(["sitefiles"], f"""
    SELECT path, page_id FROM sitefiles WHERE starts_with(path, '{TARGET}/')"""))
def subtree_scope(spark, d):
    return T.subtree_scope(C.site_files(spark, d), TARGET).select("path", "page_id")


@register("path_rules_flat", sql(["sitefiles"], f"""
    SELECT path FROM sitefiles WHERE NOT {_sql_skip('path')}"""))
def path_rules_flat(spark, d):
    return T.apply_rules_flat(C.site_files(spark, d), EXCLUDE, INCLUDE).select("path")


@register("path_rules_pruned", sql(["sitefiles"], f"""
    SELECT path FROM sitefiles
    WHERE list_bool_and(list_transform(list_append({_ANC.format(p='path')}, path), lambda x: NOT {_sql_skip('x')}))"""))
def path_rules_pruned(spark, d):
    return T.apply_rules_pruned(C.site_files(spark, d), EXCLUDE, INCLUDE).select("path")


@register("path_rules_table", sql(["sitefiles"], f"""
    SELECT path FROM sitefiles WHERE NOT {_sql_skip('path')}"""))
def path_rules_table(spark, d):
    rules = spark.createDataFrame([("exclude", x) for x in EXCLUDE] + [("include", x) for x in INCLUDE],
                                  "kind string, prefix string")
    return T.apply_rule_table(C.site_files(spark, d), rules).select("path")


@register("manifest_roundtrip", sql(["manifest"], "SELECT path, name, parent, depth, segments, is_dir FROM manifest"))
def manifest_roundtrip(spark, d):
    out = scratch_path(spark, f"manifest-{uuid.uuid4().hex}")
    _manifest(spark, d).write.mode("overwrite").json(out)
    return spark.read.schema(S.MANIFEST_NODE).json(out)


@register("manifest_nested", sql(["manifest"], "SELECT path, name, parent, depth, segments, is_dir FROM manifest"))
def manifest_nested(spark, d):
    """The manifest written as one nested JSON document a host, and read back at any depth."""
    out = scratch_path(spark, f"nested-{uuid.uuid4().hex}")
    man = _manifest(spark, d).withColumn("tree", F.element_at("segments", 1))
    NE.to_nested(man, generated_at="2024-01-01T00:00:00Z").select("json").write.text(out)
    return NE.from_nested(spark.read.text(out), json="value").select("path", "name", "parent", "depth", "segments", "is_dir")


@register("documents_scan", sql(["doctable"], "SELECT * FROM doctable"))
def documents_scan(spark, d):
    return C.doc_table(spark, d)


@register("scan_column", sql(["doctable"], "SELECT filepath FROM doctable"))
def scan_column(spark, d):
    return C.doc_table(spark, d).select(F.col("filepath").cast("string"))


@register("tree_preorder", sql(["manifest"], "SELECT path, depth, is_dir FROM manifest"))
def tree_preorder(spark, d):
    return T.preorder(_manifest(spark, d)).select("path", "depth", "is_dir")


@register("tree_rollup", sql(["sitefiles"], f"""
    SELECT directory, count(*) AS n_files
    FROM (SELECT unnest({_ANC.format(p='path')}) AS directory FROM sitefiles) GROUP BY directory"""))
def tree_rollup(spark, d):
    return T.subtree_file_counts(C.site_files(spark, d))


derived("treeflags", ("manifest",), """
    SELECT m.path, m.name, m.depth, m.name = l.last_name AS is_last
    FROM manifest m JOIN (SELECT parent, max(name) AS last_name FROM manifest GROUP BY parent) l USING (parent)""")


@register("tree_lines", sql(["treeflags", "manifest"], f"""
    , ind AS (
      SELECT a.path, string_agg(CASE WHEN f.is_last THEN '    ' ELSE '│   ' END, '' ORDER BY f.depth) AS indent
      FROM (SELECT path, unnest({_ANC.format(p='path')}) AS anc FROM manifest) a JOIN treeflags f ON f.path = a.anc
      GROUP BY a.path)
    SELECT t.path, t.depth,
           coalesce(ind.indent, '') || CASE WHEN t.is_last THEN '└── ' ELSE '├── ' END || t.name AS line
    FROM treeflags t LEFT JOIN ind USING (path)"""))
def tree_lines(spark, d):
    return T.tree_lines(_manifest(spark, d)).select("path", "depth", "line")


@register("dir_groups", sql(["doctable"], """
    SELECT CASE WHEN position('/' IN filepath) = 0 THEN '.' ELSE regexp_replace(filepath, '/[^/]*$', '') END
             AS directory, count(*) AS n_files
    FROM doctable GROUP BY 1"""))
def dir_groups(spark, d):
    return T.directory_groups(C.doc_table(spark, d))


@register("dir_children", sql(["manifest"], """
    SELECT parent, count(*) AS n_children, sum(is_dir::INTEGER)::BIGINT AS n_dirs FROM manifest GROUP BY parent"""))
def dir_children(spark, d):
    return T.children_counts(_manifest(spark, d))
