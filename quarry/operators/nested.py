"""The nested manifest (A6): one JSON document a tree, as the reference writes it, and the flat manifest.

``to_nested`` folds the flat manifest from the deepest level up: a directory's text is its own fields
around the texts of its children in name order.  ``from_nested`` reads such documents as ``VARIANT`` and
opens them level by level, at any depth, keys in any case and unknown keys ignored.  One step a level; the
document of a tree is one row by its format, so a very large tree is better kept flat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import paths as P
from quarry.functions.variant import keyed, pick
from quarry.session import ensure_checkpoint_dir

#: Fields of a node before and after its children, in the order of the document.
_BEFORE, _AFTER = ("name", "path", "description", "is_dir"), ("blob_hash", "modified_at", "size")
_KINDS = {"name": "string", "path": "string", "description": "string", "is_dir": "boolean", "blob_hash": "string", "modified_at": "timestamp_ntz", "size": "bigint"}


def _cut(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def _node(children: Column, have: set[str]) -> Column:
    """The JSON text of a node; empty and zero fields are left out."""
    def part(names):
        cols = [F.when((F.col(n) != "") if _KINDS[n] == "string" and n not in ("name", "path") else (F.col(n) != 0) if n == "size" else F.lit(True), F.col(n)).alias(n)
                for n in names if n in have]
        return F.to_json(F.struct(*cols)) if cols else F.lit("{}")

    head, tail = part(_BEFORE), part(_AFTER)
    return F.concat(
        F.substring(head, 1, F.length(head) - 1),
        F.when(children.isNotNull(), F.concat(F.lit(',"children":['), children, F.lit("]"))).otherwise(F.lit("")),
        F.when(F.length(tail) > 2, F.concat(F.lit(","), F.substring(tail, F.lit(2), F.length(tail)))).otherwise(F.lit("}")),
    )


def to_nested(manifest: DataFrame, *, generated_at: str, tree: str = "tree") -> DataFrame:
    """(tree, json): the document of each tree of a flat manifest with the column ``tree``, ``path``, ``parent``
    ('' at the top), ``name``, ``depth``, ``is_dir`` and any of the other fields."""
    have = set(manifest.columns) & set(_KINDS)
    rows = _cut(manifest.select(tree, "parent", "depth", *have))
    depth = rows.agg(F.max("depth")).first()[0] or 0
    below = None  # (tree, path of the directory, its children)
    for level in range(depth, 0, -1):
        here = rows.filter(F.col("depth") == level)
        if below is not None:
            here = here.join(below.withColumnRenamed("dir", "path"), [tree, "path"], "left")
        text = _node(F.col("children") if below is not None else F.lit(None).cast("string"), have)
        nodes = here.select(tree, F.col("parent").alias("dir"), F.struct("name", text.alias("json")).alias("node"))
        joined = F.array_join(F.transform(F.array_sort(F.collect_list("node")), lambda x: x["json"]), ",")
        below = _cut(nodes.groupBy(tree, "dir").agg(joined.alias("children")))
    trees = rows.select(tree).distinct()
    tops = trees.withColumn("children", F.lit(None).cast("string")) if below is None else trees.join(below.drop("dir"), tree, "left")
    root = F.concat(F.lit('{"name":"","path":"","is_dir":true'), F.when(F.col("children").isNotNull(), F.concat(F.lit(',"children":['), F.col("children"), F.lit("]"))).otherwise(F.lit("")), F.lit("}"))
    stamp = F.to_json(F.struct(F.lit(generated_at).alias("generated_at")))
    return tops.select(tree, F.concat(F.substring(stamp, 1, F.length(stamp) - 1), F.lit(',"root":'), root, F.lit("}")).alias("json"))


def from_nested(documents: DataFrame, *, json: str = "json", keep: tuple[str, ...] = ()) -> DataFrame:
    """The flat manifest of nested documents: ``keep`` columns of the document, path, name, parent, depth, segments,
    is_dir, description, blob_hash, modified_at, size.  The root is no row; text that is not JSON gives none.
    A node without a path has the path of its parent and its name."""
    opened = documents.select(*keep, keyed(pick(keyed(F.try_parse_json(F.col(json))), "root")).alias("node"))
    level = opened.filter("node IS NOT NULL").withColumn("at", F.coalesce(F.try_variant_get(pick(F.col("node"), "path"), "$", "string"), F.lit("")))
    out = None
    while True:
        inner = level.select(*keep, F.col("at").alias("parent"), F.explode(F.try_variant_get(pick(F.col("node"), "children"), "$", "array<variant>")).alias("child"))
        inner = inner.select(*keep, "parent", keyed(F.col("child")).alias("node")).filter("node IS NOT NULL")
        told = inner.select(*keep, "parent", "node", *(F.try_variant_get(pick(F.col("node"), n), "$", k).alias(n) for n, k in _KINDS.items()))
        own = F.coalesce(F.nullif("path", F.lit("")), F.concat(F.when(F.col("parent") != "", F.concat("parent", F.lit("/"))).otherwise(F.lit("")), F.coalesce("name", F.lit(""))))
        level = _cut(told.withColumn("at", own))
        if level.isEmpty():
            break
        flat = level.select(
            *keep, F.col("at").alias("path"), F.coalesce("name", P.basename("at")).alias("name"), P.parent("at").alias("parent"), F.size(P.segments("at")).alias("depth"),
            P.segments("at").alias("segments"), F.coalesce("is_dir", F.lit(False)).alias("is_dir"), *(n for n in ("description", *_AFTER)))
        out = flat if out is None else out.unionAll(flat)
    if out is None:
        level = level.select(*keep, F.col("at").alias("path"), "name", "parent", F.lit(0).alias("depth"), F.array().cast("array<string>").alias("segments"), "is_dir", "description", *_AFTER)
        return level
    return out
