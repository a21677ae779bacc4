"""Edit queries (H1-H8) over the generated Go and HCL files."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import blocks as BK
from quarry.operators import diff as DF
from quarry.operators import edits as ED
from quarry.plans.catalog import register
from quarry.plans.oracle import derived, sql
from quarry.sources import code_shapes as SH
from quarry.sources import corpus as C
from quarry.sources.tables import read_table

# ---------------------------------------------------------------- edit tables


def go_edits(spark, d):
    """One edit per part with line items: new body ``return <count>``, a doc comment."""
    li = read_table(spark, d, "lineitem", "l_partkey")
    g = li.groupBy("l_partkey").agg(F.count("*").alias("n"))
    k = F.col("l_partkey").cast("string")
    return g.select(F.concat(F.lit("f"), k, F.lit(".go")).alias("path"), F.lit("function").alias("target_type"),
                    F.concat(F.lit("F"), k).alias("target_name"),
                    F.concat(F.lit("return "), F.col("n").cast("string")).alias("new_content"),
                    F.concat(F.lit("F"), k, F.lit(" has "), F.col("n").cast("string"), F.lit(" line items"))
                    .alias("new_comment"),
                    F.lit(1).alias("seq"))


_COUNTS = "(SELECT l_partkey AS k, count(*) AS n, max(l_orderkey) AS o FROM lineitem GROUP BY l_partkey)"
_NOTE = "// F<k> has <n> line items\n"


def _go_sql(edited: list[str]) -> str:
    """``path, content`` of the Go files: the edited template where the part has line items."""
    plain = SH.sql_by_shape("p_partkey", [g.text for g in SH.GO], k="p_partkey", v="p_size")
    return f"""SELECT 'f' || p_partkey::VARCHAR || '.go' AS path, CASE WHEN c.k IS NULL THEN {plain}
      ELSE {SH.sql_by_shape("p_partkey", edited, k="p_partkey", v="p_size", n="c.n", o="c.o")} END AS content
    FROM part LEFT JOIN {_COUNTS} c ON c.k = p_partkey"""


def _hcl_sql(edited: list[str]) -> str:
    return f"""SELECT 's' || s_suppkey::VARCHAR || '.tf' AS path,
      {SH.sql_by_shape("s_suppkey", edited, k="s_suppkey", v="s_nationkey")} AS content FROM supplier"""


derived("editedgo", (), _go_sql([g.pre + g.doc + g.decl + "\n\treturn <n>\n" + g.rest for g in SH.GO]))


def _edited_go(spark, d):
    files = C.go_files(spark, d)
    funcs, _ = BK.go_index(files)
    return ED.splice(files, ED.function_body_splices(funcs, go_edits(spark, d)))


# ---------------------------------------------------------------- queries


@register("edit_file", sql(["gofiles"], """
    SELECT f.path, coalesce(e.new_content, f.content) AS content FROM gofiles f
    LEFT JOIN (SELECT 'f' || p_partkey::VARCHAR || '.go' AS path,
                      'package p' || chr(10) || '// replaced: ' || p_name || chr(10) AS new_content
               FROM part WHERE p_size > 25) e ON e.path = f.path"""))
def edit_file(spark, d):
    p = read_table(spark, d, "part", "p_partkey", "p_name", "p_size")
    edits = p.filter(F.col("p_size") > 25).select(
        F.concat(F.lit("f"), F.col("p_partkey").cast("string"), F.lit(".go")).alias("path"),
        F.concat(F.lit("package p\n// replaced: "), F.col("p_name"), F.lit("\n")).alias("new_content"))
    return ED.replace_files(C.go_files(spark, d), edits)


@register("edit_function", sql(["editedgo"], "SELECT path, content FROM editedgo"))
def edit_function(spark, d):
    return _edited_go(spark, d)


@register("edit_comment", sql([], _go_sql([g.pre + _NOTE + g.decl + g.body + g.rest for g in SH.GO])))
def edit_comment(spark, d):
    files = C.go_files(spark, d)
    funcs, _ = BK.go_index(files)
    return ED.splice(files, ED.comment_splices(funcs, go_edits(spark, d)))


_WHOLE = "func F<k>() int {\n\treturn <n> // {}\n}"


@register("edit_function_text", sql([], f"""
    SELECT path, content, error FROM (
      SELECT 'f' || p_partkey::VARCHAR || '.go' AS path,
             CASE WHEN c.k IS NULL THEN {SH.sql_by_shape("p_partkey", [g.text for g in SH.GO], k="p_partkey", v="p_size")}
                  WHEN p_partkey % 4 < 2 THEN {SH.sql_by_shape("p_partkey", [g.pre + g.doc + _WHOLE + g.rest[1:] for g in SH.GO], k="p_partkey", v="p_size", n="c.n")}
                  WHEN p_partkey % 4 = 2 THEN {SH.sql(SH.GO[2].pre + _WHOLE + chr(10) + "`" + chr(10) + chr(9) + "return len(s) + <v>" + chr(10) + SH.GO[2].rest, k="p_partkey", v="p_size", n="c.n")}
                  ELSE {SH.sql(SH.GO[3].text, k="p_partkey", v="p_size")} END AS content,
             CASE WHEN c.k IS NOT NULL AND p_partkey % 4 = 3 THEN 'function F' || p_partkey::VARCHAR || ' not found' END AS error
      FROM part LEFT JOIN {_COUNTS} c ON c.k = p_partkey)"""))
def edit_function_text(spark, d):
    """Whole functions replaced by counting raw braces: the brace in shape 2's string ends
    the function there, and shape 3's method is not found by ``func Name(``."""
    edits = go_edits(spark, d).select("path", "target_name", SH.column(
        _WHOLE, k=F.substring("target_name", 2, 20), n=F.regexp_extract("new_content", r"(\d+)", 1)).alias("new_content"))
    return ED.replace_functions(C.go_files(spark, d), edits)


def hcl_edits(spark, d):
    s = read_table(spark, d, "supplier", "s_suppkey", "s_nationkey")
    k = F.col("s_suppkey").cast("string")
    return s.select(F.concat(F.lit("s"), k, F.lit(".tf")).alias("path"), F.lit("resource").alias("target_type"),
                    F.concat(F.lit("supplier,s"), k).alias("target_name"),
                    F.concat(F.lit('\nname = "s'), k, F.lit('-renamed"\nnation_id = '),
                             F.col("s_nationkey").cast("string")).alias("new_content"),
                    F.lit(1).alias("seq"))


_NEW_BODY = '\n  name      = "s<k>-renamed"\n  nation_id = <v>\n'


@register("edit_hcl_block", sql([], _hcl_sql([h.pre + h.head + _NEW_BODY + h.rest for h in SH.HCL])))
def edit_hcl_block(spark, d):
    files = C.hcl_files(spark, d)
    blocks, _ = BK.hcl_index(files)
    return ED.splice(files, ED.hcl_block_splices(blocks, hcl_edits(spark, d)))


@register("edit_hcl_attr", sql([], _hcl_sql([h.named for h in SH.HCL])))
def edit_hcl_attr(spark, d):
    files = C.hcl_files(spark, d)
    blocks, attrs = BK.hcl_index(files)
    s = read_table(spark, d, "supplier", "s_suppkey")
    k = F.col("s_suppkey").cast("string")
    sets = s.select(F.concat(F.lit("s"), k, F.lit(".tf")).alias("path"),
                    F.concat(F.lit("supplier,s"), k).alias("block_name"), F.lit("name").alias("name"),
                    F.concat(F.lit("n"), k).alias("value"), F.lit(1).alias("seq"))
    return ED.splice(files, ED.hcl_attribute_splices(attrs, blocks, sets))


@register("edit_validate", sql([], """
    SELECT path, target_type,
           CASE WHEN suffix(path, '.go') AND target_type <> 'function'
                  THEN 'unsupported change type for go file: ' || target_type
                WHEN NOT (suffix(path, '.go') OR suffix(path, '.hcl') OR suffix(path, '.tf')) AND target_type <> 'file'
                  THEN 'unsupported file type: ' || path END AS error
    FROM (SELECT CASE l_returnflag WHEN 'R' THEN 'p' || l_partkey::VARCHAR || '.py'
                                   ELSE 'f' || l_partkey::VARCHAR || '.go' END AS path,
                 CASE l_returnflag WHEN 'A' THEN 'file' ELSE 'function' END AS target_type FROM lineitem)"""))
def edit_validate(spark, d):
    li = read_table(spark, d, "lineitem", "l_partkey", "l_returnflag")
    k = F.col("l_partkey").cast("string")
    ch = li.select(
        F.when(F.col("l_returnflag") == "R", F.concat(F.lit("p"), k, F.lit(".py")))
        .otherwise(F.concat(F.lit("f"), k, F.lit(".go"))).alias("path"),
        F.when(F.col("l_returnflag") == "A", F.lit("file")).otherwise(F.lit("function")).alias("target_type"))
    return ED.validate(ch)


def _lines(src: str) -> str:
    return f"""SELECT path, unnest(string_split(content, chr(10))) AS text FROM {src}"""


@register("edit_delta", sql(["gofiles", "editedgo"], f"""
    SELECT path, op, text, count(*) AS n FROM (
      SELECT *, '-' AS op FROM ({_lines('gofiles')} EXCEPT ALL {_lines('editedgo')})
      UNION ALL
      SELECT *, '+' AS op FROM ({_lines('editedgo')} EXCEPT ALL {_lines('gofiles')}))
    GROUP BY path, op, text"""))
def edit_delta(spark, d):
    return ED.line_delta(C.go_files(spark, d), _edited_go(spark, d))


def _shape_hunks() -> str:
    """The unified hunks of each shape's edit, from its two templates (placeholders hold no line feed)."""
    import difflib
    parts = []
    for i, g in enumerate(SH.GO):
        after = g.pre + g.doc + g.decl + "\n\treturn <n>\n" + g.rest
        diff, hunks = list(difflib.unified_diff(g.text.split("\n")[:-1], after.split("\n")[:-1], lineterm=""))[2:], []
        assert g.text.endswith("\n") and after.endswith("\n")
        for line in diff:
            if line.startswith("@@"):
                hunks.append([line])
            else:
                hunks[-1].append(line)
        for n, (header, *body) in enumerate(hunks, 1):
            parts.append(f"""SELECT 'f' || p_partkey::VARCHAR || '.go' AS path, {n}::BIGINT AS hunk, '{header}' AS header,
                {SH.sql(chr(10).join(body), k="p_partkey", v="p_size", n="c.n")} AS text
              FROM part JOIN {_COUNTS} c ON c.k = p_partkey WHERE p_partkey % {len(SH.GO)} = {i}
                AND {SH.sql(g.text, k="p_partkey", v="p_size", n="c.n")} <> {SH.sql(after, k="p_partkey", v="p_size", n="c.n")}""")
    return " UNION ALL ".join(parts)


@register("edit_diff", _shape_hunks())
def edit_diff(spark, d):
    """The dry run of the function edits as unified hunks in line order."""
    return DF.unified(C.go_files(spark, d), _edited_go(spark, d))


@register("diff_replay", sql(["editedgo"], "SELECT path, content FROM editedgo"))
def diff_replay(spark, d):
    """The line script between the files and their edited form, applied to the files."""
    files = C.go_files(spark, d)
    return DF.replay(files, DF.script(files, _edited_go(spark, d)))


@register("diff_moved_line", """
    WITH l AS (SELECT doc_id::VARCHAR AS path, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
    m AS (SELECT path, len(l)::BIGINT AS n, '1: ' || l[1] AS text FROM l WHERE len(l) > 1)
    SELECT path, '-' AS op, 1::BIGINT AS a_line, NULL::BIGINT AS b_line, text FROM m
    UNION ALL SELECT path, '+', NULL, n, text FROM m""")
def diff_moved_line(spark, d):
    """The first line of every document moves to its end; the script shows that line alone."""
    docs = read_table(spark, d, "documents", "doc_id", "text")
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x, i: F.concat((i + 1).cast("string"), F.lit(": "), x))
    text = lambda c: F.concat(F.array_join(c, "\n"), F.lit("\n"))
    path = F.col("doc_id").cast("string").alias("path")
    before = docs.select(path, text(lines).alias("content"))
    after = docs.select(path, text(F.concat(F.slice(lines, 2, F.size(lines)), F.slice(lines, 1, 1))).alias("content"))
    return DF.script(before, after).select("path", "op", "a_line", "b_line", "text")


@register("edit_apply_all", sql([], _go_sql([g.pre + _NOTE + g.decl + "\n\treturn <o>\n" + g.rest for g in SH.GO])))
def edit_apply_all(spark, d):
    """Every line item edits its part's function in order (last one wins), and
    the per-part doc comment is set in the same pass."""
    files = C.go_files(spark, d)
    funcs, _ = BK.go_index(files)
    li = read_table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_linenumber")
    k = F.col("l_partkey").cast("string")
    body_edits = li.select(F.concat(F.lit("f"), k, F.lit(".go")).alias("path"), F.concat(F.lit("F"), k)
                           .alias("target_name"),
                           F.concat(F.lit("return "), F.col("l_orderkey").cast("string")).alias("new_content"),
                           F.struct("l_orderkey", "l_linenumber").alias("seq"))
    bodies = ED.function_body_splices(funcs, ED.latest_edits(body_edits))
    comments = ED.comment_splices(funcs, go_edits(spark, d)).withColumn(
        "seq", F.struct(F.lit(0).cast("long").alias("l_orderkey"), F.lit(0).alias("l_linenumber")))
    ok, _conflicts = ED.resolve_overlaps(bodies.unionByName(comments))
    return ED.splice(files, ok)


@register("edit_hcl_rename", sql([], _hcl_sql([
    h.pre + 'resource "supplier" "s<k>-n<v>" {' + h.body + h.rest for h in SH.HCL])))
def edit_hcl_rename(spark, d):
    """Rename every supplier resource to ``s<k>-n<nation>`` (second label)."""
    files = C.hcl_files(spark, d)
    blocks, _ = BK.hcl_index(files)
    s = read_table(spark, d, "supplier", "s_suppkey", "s_nationkey")
    k = F.col("s_suppkey").cast("string")
    ren = s.select(F.concat(F.lit("s"), k, F.lit(".tf")).alias("path"), F.lit("resource").alias("block_type"),
                   F.concat(F.lit("supplier,s"), k).alias("block_name"),
                   F.concat(F.lit("s"), k, F.lit("-n"), F.col("s_nationkey").cast("string")).alias("new_name"),
                   F.lit(1).alias("seq"))
    return ED.splice(files, ED.hcl_rename_splices(blocks, ren))


@register("edit_hcl_append", sql([], _hcl_sql([h.text + 'output "o<k>" {\n  value = <v>\n }\n' for h in SH.HCL])))
def edit_hcl_append(spark, d):
    """Append an output block to every supplier file."""
    s = read_table(spark, d, "supplier", "s_suppkey", "s_nationkey")
    k = F.col("s_suppkey").cast("string")
    text = ED.block_text(F.lit("output"), F.array(F.concat(F.lit("o"), k)),
                         F.concat(F.lit("  value = "), F.col("s_nationkey").cast("string"), F.lit("\n")))
    add = s.select(F.concat(F.lit("s"), k, F.lit(".tf")).alias("path"), text.alias("text"), F.lit(1).alias("seq"))
    return ED.append_blocks(C.hcl_files(spark, d), add)
