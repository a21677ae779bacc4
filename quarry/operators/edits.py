"""Edits applied to a files table in one job (H1-H8).

Every edit becomes a *splice* ``(path, start, stop, new_text, seq)``: the characters
[start, stop) of the file are replaced by ``new_text`` (an empty range inserts).
Splices come from the block index (``operators.blocks``), are grouped by path, and are
applied inside the file's row; the only shuffle of text is the join of edited files
with their splices.  Results are new files tables; nothing is written in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.blocks import line_table

# Fixed values of edit eligibility.
EDITABLE_EXTENSIONS = (".go", ".hcl", ".tf")

SPLICE = ("path", "start", "stop", "new_text", "seq")


def splice(files: DataFrame, splices: DataFrame, *, path: str = "path", content: str = "content") -> DataFrame:
    """Apply non-overlapping splices; returns ``path, content`` for every file
    (files without splices unchanged).  Overlaps must be resolved before
    (``resolve_overlaps``)."""
    grouped = splices.groupBy("path").agg(F.array_sort(F.collect_list(F.struct(
        F.col("start").cast("int").alias("start"), F.col("stop").cast("int").alias("stop"), "new_text"))).alias("__s"))
    text, s = F.col("content"), F.col("__s")
    before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.try_element_at(s, i)["stop"])
    pieces = F.transform(s, lambda x, i: F.concat(
        F.substring(text, before(i) + 1, F.greatest(x["start"] - before(i), F.lit(0))), F.coalesce(x["new_text"], F.lit(""))))
    rest = F.substring(text, F.element_at(s, -1)["stop"] + 1, F.length(text))
    f = files.select(F.col(path).alias("path"), F.col(content).alias("content"))
    return f.join(grouped, "path", "left").select(
        "path", F.when(s.isNull(), text).otherwise(F.concat(F.array_join(pieces, ""), rest)).alias("content"))


def resolve_overlaps(splices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Same range edited several times: the highest ``seq`` wins.  Remaining
    partial overlaps are returned separately as conflicts (H8)."""
    last = splices.groupBy("path", "start", "stop").agg(F.max(F.struct("seq", "new_text")).alias("w")).select(
        "path", "start", "stop", F.col("w.seq").alias("seq"), F.col("w.new_text").alias("new_text"))
    w = Window.partitionBy("path").orderBy("start", "stop")
    chk = last.withColumn("prev_end", F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    conflict = F.col("prev_end").isNotNull() & (F.col("start") < F.col("prev_end"))
    return chk.filter(~conflict).drop("prev_end"), chk.filter(conflict).drop("prev_end")


def latest_edits(edits: DataFrame, *, key: tuple[str, ...] = ("path", "target_name"), seq: str = "seq") -> DataFrame:
    """Several edits of the same block: keep the highest ``seq`` (H8, last wins),
    reduced by a partial aggregate before any splice is built."""
    rest = [c for c in edits.columns if c not in key and c != seq]
    w = edits.groupBy(*key).agg(F.max(F.struct(seq, *rest)).alias("__w"))
    return w.select(*key, F.col(f"__w.{seq}").alias(seq), *[F.col(f"__w.{c}").alias(c) for c in rest])


def replace_files(files: DataFrame, edits: DataFrame, *, path: str = "path", content: str = "content") -> DataFrame:
    """Whole-file replacement (H1); empty new content keeps the file."""
    e = edits.filter(F.length("new_content") > 0).select(F.col("path").alias(path), "new_content")
    return files.join(e, path, "left").select(path, F.coalesce("new_content", F.col(content)).alias(content))


def indent_body(text: Column) -> Column:
    """Body text indented one tab per non-empty line (gofmt layout of a top-level function)."""
    return F.array_join(F.transform(F.split(text, "\n"), lambda x: F.when(x == "", x).otherwise(F.concat(F.lit("\t"), x))),
                        "\n")


def function_body_splices(funcs: DataFrame, edits: DataFrame) -> DataFrame:
    """Replace the body of every function named in ``edits`` (H2): what stands between
    its braces, whatever the layout.  Empty new content keeps it; a function without a
    body has no splice (``edit_errors`` reports it)."""
    e = edits.filter(F.length("new_content") > 0)
    j = funcs.filter("body_from IS NOT NULL").join(
        e.select("path", F.col("target_name").alias("name"), "new_content", "seq"), ["path", "name"])
    body = F.regexp_replace("new_content", r"^\s*\n|\s+$", "")
    return j.select("path", F.col("body_from").alias("start"), F.col("body_to").alias("stop"),
                    F.concat(F.lit("\n"), indent_body(body), F.lit("\n")).alias("new_text"), "seq")


def edit_errors(funcs: DataFrame, edits: DataFrame) -> DataFrame:
    """Body edits that cannot be applied: ``path, target_name, error``."""
    known = funcs.groupBy("path", F.col("name").alias("target_name")).agg(F.max(F.col("body_from").isNotNull()).alias("__body"))
    e = edits.filter(F.length("new_content") > 0).join(known, ["path", "target_name"], "left")
    return e.select("path", "target_name", F.when(F.col("__body").isNull(), F.concat(F.lit("function "), "target_name", F.lit(" not found")))
                    .when(~F.col("__body"), F.concat(F.lit('function "'), "target_name", F.lit('" has no body'))).alias("error")).filter("error IS NOT NULL")


def comment_splices(funcs: DataFrame, edits: DataFrame) -> DataFrame:
    """Set the ``//`` doc comment above a function (H3): the contiguous comment lines
    directly above the declaration are replaced, or a comment is inserted."""
    e = edits.filter(F.length("new_comment") > 0)
    j = funcs.join(e.select("path", F.col("target_name").alias("name"), "new_comment", "seq"), ["path", "name"])
    text = F.array_join(F.transform(F.split("new_comment", "\n"), lambda x: F.concat(F.lit("// "), x, F.lit("\n"))), "")
    return j.select("path", F.col("doc_from").alias("start"), F.col("start").alias("stop"), text.alias("new_text"), "seq")


def replace_functions(files: DataFrame, edits: DataFrame, *, path: str = "path", content: str = "content") -> DataFrame:
    """Replace whole functions by name, found as ``func Name(`` and the braces that
    follow, counted in the raw text (H2, text form).  ``edits``: one row per path with
    ``target_name, new_content``; returns ``path, content, error`` for every file."""
    f = files.select(F.col(path).alias("path"), F.col(content).alias("content"))
    j = f.join(edits.select("path", "target_name", "new_content"), "path", "left")
    at = F.instr(F.col("content"), F.concat(F.lit("func "), "target_name", F.lit("(")))
    tail = F.split(F.expr("substring(content, __at)"), "")
    # position after the brace at which the count comes back to 0: one pass over the tail
    walk = F.aggregate(
        tail, F.struct(F.lit(0).alias("i"), F.lit(0).alias("open"), F.lit(0).alias("end")),
        lambda s, c: F.when(s["end"] > 0, s).otherwise(F.struct(
            (s["i"] + 1).alias("i"), (s["open"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)).alias("open"),
            F.when((c == "}") & (s["open"] == 1), s["i"] + 1).otherwise(0).alias("end"))))
    j = j.withColumn("__at", at).withColumn("__end", F.when(F.col("__at") > 0, walk["end"]))
    error = (F.when(F.col("__at") == 0, F.concat(F.lit("function "), "target_name", F.lit(" not found")))
             .when(F.col("__end") == 0, F.concat(F.lit("could not determine the end of function "), "target_name")))
    new = F.concat(F.expr("substring(content, 1, __at - 1)"), "new_content", F.expr("substring(content, __at + __end)"))
    return j.select("path", F.when(F.col("__end") > 0, new).otherwise(F.col("content")).alias("content"), error.alias("error"))


def hcl_block_splices(blocks: DataFrame, edits: DataFrame) -> DataFrame:
    """Replace the body of the first block whose type and joined labels match (H4), laid
    out anew (two blanks a level, aligned ``=``).  Empty new content keeps the body."""
    from quarry.functions.source_code import format_hcl

    first = blocks.groupBy("path", "block_type", "block_name").agg(F.min(F.struct("start", "body_from", "body_to", "level")).alias("b"))
    e = edits.filter(F.length(F.trim("new_content")) > 0).select(
        "path", F.col("target_type").alias("block_type"), F.col("target_name").alias("block_name"), "new_content", "seq")
    j = first.join(e, ["path", "block_type", "block_name"])

    @F.pandas_udf("string")
    def laid_out(text, level):
        import pandas as pd
        return pd.Series(["\n" + format_hcl(t, int(n) + 1) + "\n" + "  " * int(n) for t, n in zip(text, level)])

    return j.select("path", F.col("b.body_from").alias("start"), F.col("b.body_to").alias("stop"),
                    laid_out("new_content", "b.level").alias("new_text"), "seq")


def hcl_attribute_splices(attrs: DataFrame, blocks: DataFrame, sets: DataFrame) -> DataFrame:
    """Set existing attributes of the first matching block to a quoted string (H5); only
    the value changes.  ``sets``: ``path, block_name, name, value, seq``."""
    first = blocks.groupBy("path", "block_name").agg(F.min("start_line").alias("block_start"))
    j = attrs.drop("value").join(first, ["path", "block_name", "block_start"]).join(sets, ["path", "block_name", "name"])
    quoted = F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace("value", r"\\", r"\\\\"), '"', r'\\"'), F.lit('"'))
    return j.select("path", "start", "stop", quoted.alias("new_text"), "seq")


def validate(changes: DataFrame, *, path: str = "path", target_type: str = "target_type") -> DataFrame:
    """Edit eligibility (H6): .go/.hcl/.tf or type ``file``; .go accepts only
    ``function`` changes.  Adds ``error`` (null when valid)."""
    p, t = F.col(path), F.col(target_type)
    editable = F.lit(False)
    for ext in EDITABLE_EXTENSIONS:
        editable = editable | p.endswith(ext)
    err = (
        F.when(p.endswith(".go") & (t != "function"), F.concat(F.lit("unsupported change type for go file: "), t))
        .when(~editable & (t != "file"), F.concat(F.lit("unsupported file type: "), p))
    )
    return changes.withColumn("error", err)


def line_delta(before: DataFrame, after: DataFrame, *, path: str = "path", content: str = "content",
               lines_before: DataFrame | None = None, lines_after: DataFrame | None = None) -> DataFrame:
    """Dry-run diff as a multiset line delta per file (H7): ``path, op, text, n``.

    One signed count per (path, line text): +1 per line before, -1 per line
    after, summed by a partial aggregate; positive totals were removed, negative
    ones added (equal to ``exceptAll`` both ways, with a single shuffle)."""
    b = (lines_before if lines_before is not None else line_table(before, path=path, content=content))
    a = (lines_after if lines_after is not None else line_table(after, path=path, content=content))
    signed = b.select("path", "text", F.lit(1).alias("d")).unionByName(a.select("path", "text", F.lit(-1).alias("d")))
    net = signed.groupBy("path", "text").agg(F.sum("d").alias("net")).filter(F.col("net") != 0)
    return net.select("path", F.when(F.col("net") > 0, F.lit("-")).otherwise(F.lit("+")).alias("op"), "text",
                      F.abs("net").cast("long").alias("n"))


def hcl_rename_splices(blocks: DataFrame, renames: DataFrame) -> DataFrame:
    """Rename the second label of the blocks with the given type and joined labels
    (H5).  ``renames``: ``path, block_type, block_name, new_name, seq``."""
    own = blocks.filter("level = 0 AND label_from IS NOT NULL")
    return own.join(renames, ["path", "block_type", "block_name"]).select(
        "path", F.col("label_from").alias("start"), F.col("label_to").alias("stop"), F.col("new_name").alias("new_text"), "seq")


def block_text(block_type: Column, labels: Column, content: Column) -> Column:
    """Text of a new block around raw ``content``; its closing brace stands one blank in."""
    head = F.concat_ws(" ", block_type, F.transform(labels, lambda x: F.concat(F.lit('"'), x, F.lit('"'))))
    return F.concat(head, F.lit(" {\n"), content, F.lit(" }\n"))


def append_blocks(files: DataFrame, additions: DataFrame, *, path: str = "path", content: str = "content") -> DataFrame:
    """Append new blocks at the end of files (H5), in ``seq`` order, each on a new line.
    ``additions``: ``path, text, seq``, ``text`` as ``block_text`` gives it."""
    add = additions.groupBy("path").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "").alias("__add"))
    f = files.select(F.col(path).alias("path"), F.col(content).alias("content"))
    gap = F.when(F.col("content").endswith("\n") | (F.col("content") == ""), F.lit("")).otherwise(F.lit("\n"))
    return f.join(add, "path", "left").select("path", F.when(F.col("__add").isNull(), F.col("content")).otherwise(
        F.concat("content", gap, "__add")).alias("content"))
