"""Plan, review, repair and investigation queries (A8, A9, I1-I9): one change
plan per order whose changes are its line items (see ``sources.corpus.plans``)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry import schemas as S
from quarry.operators import plans as PL
from quarry.plans.cases.blocks import located_json
from quarry.plans.catalog import register
from quarry.plans.guards import spread
from quarry.plans.oracle import sql
import quarry.plans.cases.digest  # noqa: F401  (defines the dirsummaries view)
from quarry.session import scratch_path
from quarry.sources import corpus as C
from quarry.sources.tables import read_table

def _plans(spark, d):
    return C.plans(spark, d).select(F.struct("id", "query", "changes").alias("plan"))


@register("plan_changes", sql(["planchanges"], "SELECT * FROM planchanges"))
def plan_changes(spark, d):
    return PL.flatten_plan(_plans(spark, d))


@register("json_plan", sql(["planchanges"], "SELECT * FROM planchanges"))
def json_plan(spark, d):
    """Plans written as the model's JSON text, then read back with the plan schema."""
    js = C.plans(spark, d).select(F.to_json(F.struct("id", "query", "changes")).alias("json"))
    return PL.flatten_plan(PL.parse_json(js, S.CHANGES_PLAN, out="plan"))


def _renamed(kind: T.DataType, name: Callable[[str], str]) -> T.DataType:
    """``kind`` with its fields renamed by ``name`` at every level."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(name(f.name), _renamed(f.dataType, name), f.nullable) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_renamed(kind.elementType, name), kind.containsNull)
    return kind


@register("json_plan_any_case", sql(["planchanges"], "SELECT * FROM planchanges"))
def json_plan_any_case(spark, d):
    """The plans' JSON with keys in upper, title and lower case by turns, and one unknown key in each plan and each change."""
    new = F.array(F.lit(1))
    changes = F.transform("changes", lambda c: F.when(c.isNotNull(), F.struct(
        c["block"].alias("block"), new.alias("unknown new_content"), c["new_content"].alias("new_content"), c["new_comment"].alias("new_comment"))))
    p = C.plans(spark, d).select("id", F.struct(new.alias("unknown id"), "id", "query", changes.alias("changes")).alias("plan"))
    kind = p.schema["plan"].dataType
    upper, title, lower = (F.to_json(F.col("plan").cast(_renamed(kind, case))) for case in (str.upper, str.title, str.lower))
    k = F.col("id").cast("long") % 3
    text = F.when(k == 0, upper).when(k == 1, title).otherwise(lower)
    return PL.flatten_plan(PL.parse_json_any_case(p.select(text.alias("json")), S.CHANGES_PLAN, out="plan"))


@register("json_yes_no", sql([], """
    SELECT doc_id, CASE WHEN toxic IS NULL THEN NULL ELSE toxic = 1 END AS answer, toxic IS NULL AS bad FROM labels"""))
def json_yes_no(spark, d):
    """A judge's yes or no for each label, the key in several cases; a missing verdict is no JSON at all."""
    lab = read_table(spark, d, "labels", "doc_id", "toxic")
    key = F.element_at(F.array(*map(F.lit, ("answer", "Answer", "ANSWER", "aNSWER"))), (F.col("doc_id") % 4 + 1).cast("int"))
    text = F.concat(F.lit('{"'), key, F.lit('": '), F.when(F.col("toxic") == 1, "true").otherwise("false"), F.lit(', "why": "-"}'))
    js = lab.select("doc_id", F.when(F.col("toxic").isNull(), F.lit("no verdict")).otherwise(text).alias("json"))
    return PL.parse_json_any_case(js, S.YES_OR_NO, bad="bad").select("doc_id", F.col("j.answer").alias("answer"), "bad")


@register("json_review", sql(["reviews"], "SELECT plan_id, result, comment FROM reviews"))
def json_review(spark, d):
    """Reviews written as JSON files with Go field names in place of some tags, and read back."""
    out = scratch_path(spark, f"reviews-{uuid.uuid4().hex}")
    r = C.reviews(spark, d)
    named = F.when(F.col("result"), F.to_json(F.struct(F.col("plan_id").alias("PLAN_ID"), F.col("result").alias("Result"), F.col("comment").alias("Comment")))).otherwise(
        F.to_json(F.struct("plan_id", "result", "comment")))
    r.select(named.alias("json")).write.text(out)
    return PL.parse_json_any_case(spark.read.text(out), S.REVIEW, json_col="value").select("j.*")


@register("json_locations", sql([], """
    SELECT o_orderpriority AS query, 'f' || l_partkey::VARCHAR || '.go' AS path, count(*) AS n_blocks
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2"""))
def json_locations(spark, d):
    j = PL.parse_json(located_json(spark, d), S.LOCATION_OUTPUT)
    files = j.select(F.col("j.Query").alias("query"), F.explode("j.BlockList.files").alias("f"))
    return files.groupBy("query", F.col("f.path").alias("path")).agg(
        F.sum(F.size("f.blocks")).cast("long").alias("n_blocks"))


@register("json_repo_summary", sql(["dirsummaries"], """
    SELECT repository, directory, summary AS purpose FROM dirsummaries"""))
def json_repo_summary(spark, d):
    """Repository summaries written as JSON (F3 shape) and read back with that shape
    (the reference reads them with another shape, which loses every field)."""
    from quarry.plans.cases.digest import repo_summary_merge
    out = scratch_path(spark, f"repo-summary-{uuid.uuid4().hex}")
    repo_summary_merge(spark, d).select("json").write.mode("overwrite").text(out)
    j = spark.read.text(out).select(F.from_json("value", S.REPO_SUMMARY).alias("j"))
    return j.select(F.col("j.summary.project_name").alias("repository"),
                    F.explode("j.directory_summaries").alias("directory", "s")).select(
        "repository", "directory", F.col("s.purpose").alias("purpose"))


@register("plan_review_match", sql(["reviews"], """
    SELECT coalesce(p.id, r.plan_id) AS id, p.query, r.result, r.comment,
           CASE WHEN p.id IS NULL THEN 'review_only' WHEN r.plan_id IS NULL THEN 'plan_only' ELSE 'matched' END
             AS status
    FROM (SELECT DISTINCT l_orderkey::VARCHAR AS id, o_orderpriority AS query
          FROM lineitem JOIN orders ON o_orderkey = l_orderkey) p
    FULL OUTER JOIN reviews r ON r.plan_id = p.id"""))
def plan_review_match(spark, d):
    return PL.pair_reviews(C.plans(spark, d), C.reviews(spark, d))


@register("plans_approved", sql(["reviews"], """
    SELECT DISTINCT l_orderkey::VARCHAR AS id, o_orderpriority AS query
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey
    WHERE l_orderkey::VARCHAR IN (SELECT plan_id FROM reviews WHERE result)"""))
def plans_approved(spark, d):
    return PL.approved(C.plans(spark, d), C.reviews(spark, d)).select("id", "query")


def _sql_text(fmt: str) -> str:
    """A Python text constant as a DuckDB string expression (newlines as chr(10))."""
    return "('" + fmt.replace("\n", "' || chr(10) || '") + "')"


@register("change_report", sql(["planchanges"], f"""
    SELECT plan_id AS id,
           string_agg(printf({_sql_text(PL.CHANGE_BLOCK)}, change_index, path, target_type, target_name, new_content,
                             change_index), '' ORDER BY change_index) AS report
    FROM planchanges GROUP BY plan_id"""))
def change_report(spark, d):
    return PL.change_report(C.plans(spark, d))


@register("plan_ids", sql([], """
    SELECT CASE WHEN starts_with(o_orderpriority, '1')
                THEN substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-3' || substr(h, 14, 3) || '-a' || substr(h, 18, 3) || '-' || substr(h, 21, 12)
                ELSE k END AS id, o_orderpriority AS query, k
    FROM (SELECT o_orderpriority, o_orderkey::VARCHAR AS k, md5('plan ' || o_orderkey::VARCHAR) AS h FROM orders
          WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))"""))
def plan_ids(spark, d):
    p = C.plans(spark, d).select(F.when(F.col("query").startswith("1"), F.lit("")).otherwise(F.col("id")).alias("id"),
                                 "query", F.col("id").alias("k"))
    return PL.carry_ids(p, name=F.concat(F.lit("plan "), F.col("k")))


def repair_json(spark, d):
    """The repairer's output per order: one file per line item, one block, two samples."""
    o = read_table(spark, d, "orders", "o_orderkey", "o_orderpriority")
    li = spread(read_table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_linenumber"), "l_orderkey")
    diff = lambda x, s: F.concat(F.lit("<<<<<<< SEARCH\nreturn 0\n=======\nreturn "),
                                 (x["l_linenumber"] + s).cast("string"), F.lit("\n>>>>>>> REPLACE"))
    fr = lambda x, k: F.struct(
        F.concat(F.lit("f"), k, F.lit(".go")).alias("File"),
        F.array(F.struct(
            F.struct(F.lit("function").alias("block_type"), F.concat(F.lit("F"), k).alias("name")).alias("Block"),
            F.lit("").alias("BlockContent"),
            F.array(*[F.struct(F.lit(s).alias("Sample"), F.struct(diff(x, s).alias("diff")).alias("Repair"))
                      for s in (0, 1)]).alias("Repairs"))).alias("BlockRepairs"))
    # the keys alone are grouped; the texts are made of an order's finished list
    per = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: fr(x, x["l_partkey"].cast("string"))).alias("FileRepairs"))
    return o.join(per, "o_orderkey").select(
        F.to_json(F.struct(F.col("o_orderpriority").alias("Query"), "FileRepairs")).alias("json"))


@register("repair_samples", sql([], """
    SELECT o_orderpriority AS query, 'f' || l_partkey::VARCHAR || '.go' AS file, 'function' AS block_type,
           'F' || l_partkey::VARCHAR AS name, s AS sample,
           '<<<<<<< SEARCH' || chr(10) || 'return 0' || chr(10) || '=======' || chr(10) || 'return '
             || (l_linenumber + s)::VARCHAR || chr(10) || '>>>>>>> REPLACE' AS diff
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey, (SELECT unnest([0, 1])::INTEGER AS s)"""))
def repair_samples(spark, d):
    return PL.repair_rows(repair_json(spark, d))


def _steps(spark, d):
    """Investigation steps per plan: inspect each changed file, with a result."""
    p = C.plans(spark, d)
    steps = F.transform("changes", lambda c: F.struct(
        F.concat(F.lit("inspect "), c["block"]["path"]).alias("step"),
        F.struct(F.array(c["block"]["path"]).alias("target_files"),
                 F.array(c["block"]["target_name"], F.lit("go.mod")).alias("reference_files"),
                 F.concat(F.lit("needs "), c["new_content"]).alias("result")).alias("result")))
    return p.select("id", steps.alias("steps"))


@register("investigation_digest", sql(["planchanges"], r"""
    SELECT plan_id AS id, string_agg(
        chr(10) || '--- ' || change_index::VARCHAR || ' ---' || chr(10) || 'Investigation: inspect ' || path || chr(10)
        || 'Target files:' || chr(10) || '[' || path || ']' || chr(10) || 'Reference files:' || chr(10)
        || '[' || target_name || ' go.mod]' || chr(10) || 'Result:' || chr(10) || 'needs ' || new_content || chr(10)
        || '--- ' || change_index::VARCHAR || ' end ---' || chr(10), '' ORDER BY change_index) AS digest
    FROM planchanges GROUP BY plan_id"""))
def investigation_digest(spark, d):
    return PL.investigation_digest(_steps(spark, d))


@register("action_plan_text", sql(["planchanges"], r"""
    , ex AS (
      SELECT plan_id, min(query) AS goal,
             string_agg(chr(9) || '- check ' || path || chr(10), '' ORDER BY change_index) AS inv,
             string_agg(chr(9) || '- update ' || target_name || chr(10), '' ORDER BY change_index) AS chg
      FROM planchanges GROUP BY plan_id),
    num AS (
      SELECT o.o_custkey, ex.*, row_number() OVER (PARTITION BY o.o_custkey ORDER BY o.o_orderkey) AS i
      FROM ex JOIN orders o ON o.o_orderkey::VARCHAR = ex.plan_id)
    SELECT o_custkey, string_agg('--- Example ' || i::VARCHAR || ' ---' || chr(10) || 'Goal: ' || goal || chr(10)
                                 || 'Steps:' || chr(10) || '- Investigation:' || chr(10) || inv || '- Changes Plan:'
                                 || chr(10) || chr || '--- Example end ' || i::VARCHAR || ' ---' || chr(10), ''
                                 ORDER BY i) AS text
    FROM (SELECT *, chg AS chr FROM num) GROUP BY o_custkey"""))
def action_plan_text(spark, d):
    """Past plans of each customer listed as numbered examples (1-based)."""
    p = C.plans(spark, d)
    o = read_table(spark, d, "orders", "o_orderkey", "o_custkey")
    ex = p.select("id", F.struct(
        F.col("query").alias("goal"),
        F.struct(F.transform("changes", lambda c: F.concat(F.lit("check "), c["block"]["path"])).alias(
            "investigate_steps"),
            F.transform("changes", lambda c: F.concat(F.lit("update "), c["block"]["target_name"])).alias(
                "change_steps")).alias("plan")).alias("ex"))
    j = ex.join(o.select(F.col("o_orderkey").cast("string").alias("id"), "o_custkey", "o_orderkey"), "id")
    per = j.groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "ex"))),
                                                 lambda x: x["ex"]).alias("examples"))
    return per.select("o_custkey", PL.action_plan_text(F.col("examples")).alias("text"))


@register("investigation_examples", sql(["planchanges"], r"""
    , ex AS (
      SELECT plan_id, min(query) AS goal, count(*)::VARCHAR || ' changes' AS result,
             string_agg(chr(10) || '---' || chr(10) || 'file: ' || path || chr(10) || '```' || chr(10) || new_content || chr(10) || '```', '' ORDER BY change_index) AS files
      FROM planchanges GROUP BY plan_id),
    num AS (
      SELECT o.o_custkey, ex.*, row_number() OVER (PARTITION BY o.o_custkey ORDER BY o.o_orderkey) AS i
      FROM ex JOIN orders o ON o.o_orderkey::VARCHAR = ex.plan_id)
    SELECT o_custkey, string_agg(chr(10) || '--- Example ' || i::VARCHAR || ' ---' || chr(10) || 'Goal: ' || goal || chr(10) || 'Files:' || files
                                 || chr(10) || 'Result: ' || result || chr(10) || '--- Example end ' || i::VARCHAR || ' ---', '' ORDER BY i) AS text
    FROM num GROUP BY o_custkey"""))
def investigation_examples(spark, d):
    """Past investigations of each customer listed as numbered examples: the plan's files and what came of it."""
    o = read_table(spark, d, "orders", "o_orderkey", "o_custkey")
    ex = C.plans(spark, d).select("id", F.struct(
        F.col("query").alias("goal"),
        F.transform("changes", lambda c: F.struct(c["block"]["path"].alias("path"), c["new_content"].alias("content"))).alias("files"),
        F.concat(F.size("changes").cast("string"), F.lit(" changes")).alias("result")).alias("ex"))
    j = ex.join(o.select(F.col("o_orderkey").cast("string").alias("id"), "o_custkey", "o_orderkey"), "id")
    per = j.groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "ex"))), lambda x: x["ex"]).alias("examples"))
    return per.select("o_custkey", PL.investigation_examples_text(F.col("examples")).alias("text"))


@register("record_text", sql(["planchanges"], """
    SELECT plan_id AS id,
           to_json({'id': plan_id, 'query': min(query),
                    'changes': list({'block': {'path': path, 'target_type': target_type, 'target_name': target_name,
                                               'content': block_content},
                                     'new_content': new_content, 'new_comment': new_comment} ORDER BY change_index)})
             ::VARCHAR AS plan_json,
           'Target Files: [' || string_agg(path, ' ' ORDER BY change_index) || ']' || chr(10)
             || 'Reference Files: []' || chr(10) || 'Result: ' || count(*)::VARCHAR || ' changes' AS investigation
    FROM planchanges GROUP BY plan_id"""))
def record_text(spark, d):
    p = C.plans(spark, d)
    res = F.struct(F.transform("changes", lambda c: c["block"]["path"]).alias("target_files"),
                   F.array().cast("array<string>").alias("reference_files"),
                   F.concat(F.size("changes").cast("string"), F.lit(" changes")).alias("result"))
    return p.select("id", F.to_json(F.struct("id", "query", "changes")).alias("plan_json"),
                    PL.investigation_record(res).alias("investigation"))
