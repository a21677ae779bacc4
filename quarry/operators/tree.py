"""File-tree operators over a flat manifest.

Spark has no recursive types, so the reference's nested FileInfo tree becomes a
flat table: one row per file or directory with ``path, name, parent, depth,
segments, is_dir``.  Directories are derived by exploding each file's ancestors
(map side) and de-duplicating (one hash aggregate with partial combine).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import paths as P
from quarry.session import ensure_checkpoint_dir


def file_rows(files: DataFrame, *, path_col: str = "path", content_col: str | None = "content",
              modified_col: str | None = None) -> DataFrame:
    """Normalise a files table into manifest rows for files (``is_dir = false``)."""
    p = F.col(path_col)
    cols = [
        p.alias("path"),
        P.basename(p).alias("name"),
        P.parent(p).alias("parent"),
        F.size(P.segments(p)).alias("depth"),
        P.segments(p).alias("segments"),
        F.lit(False).alias("is_dir"),
    ]
    if content_col:
        c = F.col(content_col)
        cols += [P.git_blob_hash(c).alias("blob_hash"), F.octet_length(c).cast("long").alias("size"),
                 c.alias("content")]
    if modified_col:
        cols.append(F.col(modified_col).alias("modified_at"))
    return files.select(*cols)


def directory_rows(files: DataFrame, *, path_col: str = "path") -> DataFrame:
    """Every proper ancestor directory of the files, once."""
    d = files.select(F.explode(P.ancestors(F.col(path_col))).alias("path")).distinct()
    return d.select(
        "path",
        P.basename("path").alias("name"),
        P.parent("path").alias("parent"),
        F.size(P.segments("path")).alias("depth"),
        P.segments("path").alias("segments"),
        F.lit(True).alias("is_dir"),
    )


def manifest(files: DataFrame, *, path_col: str = "path", with_dirs: bool = True) -> DataFrame:
    """Files plus derived directories (A1).  Content columns stay on file rows only."""
    f = file_rows(files, path_col=path_col, content_col=None)
    return f.unionByName(directory_rows(files, path_col=path_col)) if with_dirs else f


def subtree_scope(files: DataFrame, target: str, *, path_col: str = "path", missing_ok: bool = True) -> DataFrame:
    """Keep paths strictly below ``target``; empty target keeps everything (A3).  With ``missing_ok=False`` a
    target that no path lies below is an error, as in the reference; that reads up to the first such path."""
    scoped = files.filter(P.below(F.col(path_col), target))
    if not missing_ok and target and scoped.select(path_col).isEmpty():
        raise FileNotFoundError(f"no file below {target!r}")
    return scoped


def apply_rules_flat(files: DataFrame, exclude: Sequence[str], include: Sequence[str], *,
                     path_col: str = "path", segment_aware: bool = False) -> DataFrame:
    """Drop a path when an exclude prefix matches and no include prefix does (A4).

    Folded into one predicate, so every prefix test is pushed to the scan."""
    return files.filter(~P.skip(F.col(path_col), exclude, include, segment_aware))


def apply_rules_pruned(files: DataFrame, exclude: Sequence[str], include: Sequence[str], *,
                       target: str = "", path_col: str = "path") -> DataFrame:
    """A4 applied to the file and to every ancestor directory below ``target`` (A5).

    An include below an excluded directory never takes effect, because the
    traversal skips the directory first."""
    p = F.col(path_col)
    base = len([s for s in target.strip("/").split("/") if s]) if target else 0
    anc = P.ancestors(p)
    below_target = F.slice(anc, base + 1, F.greatest(F.size(anc) - base, F.lit(0))) if base else anc
    checked = F.concat(below_target, F.array(p))

    def ok(x: Column) -> Column:
        return ~P.skip(x, exclude, include)

    return files.filter(F.forall(checked, ok))


def apply_rule_table(files: DataFrame, rules: DataFrame, *, path_col: str = "path") -> DataFrame:
    """A4 with rules given as a table ``(kind, prefix)``, kind include/exclude.

    A prefix test is turned into an equi-join: every path is cut at the distinct
    rule lengths only (a scalar-subquery array, bounded by the longest prefix),
    and the cuts are hash-joined to the rules.  No nested-loop join, and the
    work per path does not grow with the number of rules."""
    r = rules.select("kind", "prefix")
    lens = r.agg(F.array_sort(F.collect_set(F.length("prefix")))).scalar()
    p = F.col(path_col)
    cuts = (
        files.select(p.alias("__path")).withColumn("__lens", lens)
        .select("__path", F.explode(F.filter("__lens", lambda n: n <= F.length("__path"))).alias("__n"))
        .select("__path", F.substring("__path", 1, F.col("__n")).alias("prefix"))
    )
    hits = cuts.join(r, "prefix").groupBy("__path").agg(
        F.max((F.col("kind") == "exclude").cast("int")).alias("__exc"),
        F.max((F.col("kind") == "include").cast("int")).alias("__inc"))
    dropped = hits.filter((F.col("__exc") == 1) & (F.col("__inc") == 0)).select(F.col("__path").alias(path_col))
    return files.join(dropped, path_col, "left_anti")


def preorder(man: DataFrame) -> DataFrame:
    """Pre-order flatten (B1): sort by the segment array (parent before child,
    siblings by name).  The sort is a distributed range sort."""
    return man.orderBy("segments")


def subtree_file_counts(files: DataFrame, *, path_col: str = "path") -> DataFrame:
    """Number of files below every directory (B2); partial counts are combined map side."""
    return (
        files.select(F.explode(P.ancestors(F.col(path_col))).alias("directory"))
        .groupBy("directory")
        .agg(F.count("*").alias("n_files"))
    )


def children_counts(man: DataFrame) -> DataFrame:
    """Direct children (files and directories) per directory (B5); '' is the root."""
    return man.groupBy("parent").agg(
        F.count("*").alias("n_children"),
        F.sum(F.col("is_dir").cast("int")).cast("long").alias("n_dirs"),
    )


def tree_lines(man: DataFrame) -> DataFrame:
    """One rendered line per node (B3): ``├── ``/``└── `` and 4-column indents.

    ``is_last`` = the node holds the greatest name among its siblings, a grouped max kept with the
    parent directory.  A directory's indent is put together by pointer doubling over the
    directories alone: each knows the piece of itself and an ancestor to go on from, and every
    round joins it to that ancestor's piece, so a tree of depth d takes log2(d) rounds.  Nodes are joined
    once, to their parent."""
    last = man.groupBy("parent").agg(F.max("name").alias("last_name"))
    dirs = man.filter("is_dir").select("path", "parent", "name", "depth").join(last, "parent")
    piece = F.when(F.col("name") == F.col("last_name"), F.lit("    ")).otherwise(F.lit("│   "))
    known = dirs.select("path", F.col("parent").alias("up"), piece.alias("indent"))
    deepest = dirs.agg(F.max("depth")).first()[0] or 0
    ensure_checkpoint_dir(man.sparkSession)
    known = known.checkpoint()
    reach = 1  # directories that a piece covers
    while reach < deepest:
        above = known.select(F.col("path").alias("up"), F.col("up").alias("next"), F.col("indent").alias("more"))
        known = known.join(above, "up", "left").select(
            "path", F.coalesce("next", F.lit("")).alias("up"), F.concat(F.coalesce("more", F.lit("")), "indent").alias("indent")).checkpoint()
        reach *= 2
    parents = last.join(known.select(F.col("path").alias("parent"), "indent"), "parent", "left")
    return man.select("path", "name", "parent", "depth", "segments").join(parents, "parent").select(
        "path", "segments", "depth",
        F.concat(F.coalesce("indent", F.lit("")), F.when(F.col("name") == F.col("last_name"), F.lit("└── ")).otherwise(F.lit("├── ")), F.col("name")).alias("line"),
    )


def directory_groups(docs: DataFrame, *, path_col: str = "filepath") -> DataFrame:
    """Documents per directory (B4); no slash means directory ``.``."""
    return docs.groupBy(P.dirname(F.col(path_col)).alias("directory")).agg(F.count("*").alias("n_files"))
