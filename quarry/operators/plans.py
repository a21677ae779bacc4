"""Plans, reviews, repairs and investigations.

Model output arrives as JSON text; it is parsed with explicit StructTypes
(``from_json`` is case-sensitive, so the schemas carry the exact keys; ``parse_json_any_case``
takes them in any case) and flattened with ``posexplode``.  Per-plan texts are built from the plan's own
arrays with higher-order functions: no shuffle, no grouping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry import schemas as S
from quarry.functions.variant import parse_any_case

# Fixed text layouts of the reports.
CHANGE_BLOCK = "---- change %d -----\nPath: %s, Type: %s, Name: %s,\nNewContent: %s\n----- change %d end ----\n"
INVESTIGATION_BLOCK = ("\n--- %d ---\nInvestigation: %s\nTarget files:\n%s\nReference files:\n%s\nResult:\n%s\n"
                       "--- %d end ---\n")


def parse_json(df: DataFrame, schema, *, json_col: str = "json", out: str = "j") -> DataFrame:
    return df.withColumn(out, F.from_json(F.col(json_col), schema))


def parse_json_any_case(df: DataFrame, schema, *, json_col: str = "json", out: str = "j", bad: str | None = None) -> DataFrame:
    """Like ``parse_json`` with keys in any case (A8); ``bad`` names a column that is true where the text
    is not a JSON object."""
    df = df.withColumn(out, parse_any_case(F.col(json_col), schema))
    return df.withColumn(bad, F.col(out).isNull()) if bad else df


def flatten_plan(plans: DataFrame, *, plan: str = "plan") -> DataFrame:
    """One row per change with its 0-based index."""
    p = F.col(plan)
    return plans.select(p["id"].alias("plan_id"), p["query"].alias("query"),
                        F.posexplode(p["changes"]).alias("change_index", "c")).select(
        "plan_id", "query", "change_index", F.col("c.block.path").alias("path"),
        F.col("c.block.target_type").alias("target_type"), F.col("c.block.target_name").alias("target_name"),
        F.col("c.block.content").alias("block_content"), F.col("c.new_content").alias("new_content"),
        F.col("c.new_comment").alias("new_comment"))


def pair_reviews(plans: DataFrame, reviews: DataFrame) -> DataFrame:
    """Pair plans with reviews by id (I2): ``status`` is matched, plan_only or review_only."""
    p = plans.select(F.col("id"), "query", F.lit(True).alias("__p"))
    r = reviews.select(F.col("plan_id").alias("id"), "result", "comment", F.lit(True).alias("__r"))
    j = p.join(r, "id", "full_outer")
    status = F.when(F.col("__p").isNull(), "review_only").when(F.col("__r").isNull(), "plan_only").otherwise("matched")
    return j.select("id", "query", "result", "comment", status.alias("status"))


def approved(plans: DataFrame, reviews: DataFrame) -> DataFrame:
    """Plans whose review approves them."""
    return plans.join(reviews.filter(F.col("result")).select(F.col("plan_id").alias("id")), "id", "left_semi")


def change_report(plans: DataFrame, *, changes: str = "changes") -> DataFrame:
    """The review's change listing per plan (I4), 0-based change numbers."""
    txt = F.array_join(F.transform(F.col(changes), lambda c, i: F.format_string(
        CHANGE_BLOCK, i, c["block"]["path"], c["block"]["target_type"], c["block"]["target_name"], c["new_content"], i)),
        "")
    return plans.select("id", txt.alias("report"))


def carry_ids(plans: DataFrame, *, id_col: str = "id", name: Column | None = None) -> DataFrame:
    """Keep a non-empty plan id, otherwise a new id (I5).  The new id is a name-based
    UUID (version 3 layout) of ``name``, by default of all other columns as JSON, so
    that a lost and repeated task cannot change it."""
    if name is None:
        name = F.to_json(F.struct(*[c for c in plans.columns if c != id_col]))
    h = F.md5(name)
    part = lambda at, n: F.substring(h, at, n)
    fresh = F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-3"), part(14, 3), F.lit("-a"), part(18, 3), F.lit("-"), part(21, 12))
    return plans.withColumn(id_col, F.coalesce(F.nullif(F.col(id_col), F.lit("")), fresh))


def repair_rows(repairs: DataFrame, *, json_col: str = "json") -> DataFrame:
    """``query, file, block_type, name, sample, diff`` from repairer JSON."""
    j = repairs.select(F.from_json(json_col, S.REPAIR_OUTPUT).alias("j"))
    f = j.select(F.col("j.Query").alias("query"), F.explode("j.FileRepairs").alias("f"))
    b = f.select("query", F.col("f.File").alias("file"), F.explode("f.BlockRepairs").alias("b"))
    r = b.select("query", "file", F.col("b.Block.block_type").alias("block_type"), F.col("b.Block.name").alias("name"),
                 F.explode("b.Repairs").alias("r"))
    return r.select("query", "file", "block_type", "name", F.col("r.Sample").alias("sample"),
                    F.col("r.Repair.diff").alias("diff"))


def go_list(arr: Column) -> Column:
    """Go's ``%v`` of a string slice: ``[a b c]``."""
    return F.concat(F.lit("["), F.array_join(arr, " "), F.lit("]"))


def investigation_digest(steps: DataFrame, *, steps_col: str = "steps") -> DataFrame:
    """Per plan, the investigation steps with their results, in step order.
    ``steps``: ``array<struct<step, result: InvestigationResult>>``."""
    txt = F.array_join(F.transform(F.col(steps_col), lambda s, i: F.format_string(
        INVESTIGATION_BLOCK, i, s["step"], go_list(s["result"]["target_files"]),
        go_list(s["result"]["reference_files"]), s["result"]["result"], i)), "")
    return steps.select("id", txt.alias("digest"))


def investigation_examples_text(examples: Column) -> Column:
    """Numbered listing of past investigations (I8) for ``array<struct<goal, files: array<struct<path,
    content>>, result>>``."""
    def one(e, i):
        files = F.array_join(F.transform(e["files"], lambda f: F.concat(F.lit("\n---\nfile: "), f["path"], F.lit("\n```\n"), f["content"], F.lit("\n```"))), "")
        return F.concat(F.format_string("\n--- Example %d ---\n", i + 1), F.lit("Goal: "), e["goal"], F.lit("\nFiles:"), files, F.lit("\nResult: "), e["result"],
                        F.format_string("\n--- Example end %d ---", i + 1))

    return F.array_join(F.transform(examples, one), "")


def action_plan_text(examples: Column) -> Column:
    """Numbered example listing (I8) for ``array<struct<goal, plan: ActionPlan>>``."""
    def one(e, i):
        inv = F.array_join(F.transform(e["plan"]["investigate_steps"], lambda s: F.concat(F.lit("\t- "), s, F.lit("\n"))),
                           "")
        chg = F.array_join(F.transform(e["plan"]["change_steps"], lambda s: F.concat(F.lit("\t- "), s, F.lit("\n"))), "")
        return F.concat(F.format_string("--- Example %d ---\n", i + 1), F.lit("Goal: "), e["goal"],
                        F.lit("\nSteps:\n- Investigation:\n"), inv, F.lit("- Changes Plan:\n"), chg,
                        F.format_string("--- Example end %d ---\n", i + 1))

    return F.array_join(F.transform(examples, one), "")


def investigation_record(result: Column) -> Column:
    """``InvestigationResult`` as text."""
    return F.format_string("Target Files: %s\nReference Files: %s\nResult: %s", go_list(result["target_files"]),
                           go_list(result["reference_files"]), result["result"])
