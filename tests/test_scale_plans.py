"""Plans and layouts for large tables: pruned scopes, bucketed state, salted heavy keys, tree rounds, dumps."""

import datetime as dt
import json
import random
import re
import uuid

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from quarry.operators import load as LD
from quarry.operators import skew as SK
from quarry.operators import sync as SY
from quarry.operators import tree as TR
from quarry.plans.inspect import plan_text
from quarry.sources import ci as CI
from quarry.sources import corpus as C
from quarry.sources import files as FL

D = "/root/testdata/sf0.01"


def test_scope_table_prunes_folders(spark, tmp_path):
    docs = C.doc_table(spark, D).withColumn("embedding", F.array().cast("array<float>"))
    path = str(tmp_path / "s")
    FL.write_snapshot(docs, path)
    scopes = spark.read.schema("repository string, context string, active boolean").json(_json(tmp_path, [
        {"repository": "repo1", "context": "en", "active": True}, {"repository": "repo0", "context": "de", "active": True}, {"repository": "repo0", "context": "en", "active": False}]))
    got = FL.read_scopes(spark, path, scopes.filter("active"), columns=["id", "repository", "context"])
    txt = plan_text(got)
    assert "dynamicpruning" in txt.lower() and "embedding" not in re.search(r"ReadSchema: .*", txt).group()
    rows = got.collect()
    assert {(r["repository"], r["context"]) for r in rows} == {("repo1", "en"), ("repo0", "de")}
    assert len(rows) == docs.filter("(repository = 'repo1' AND context = 'en') OR (repository = 'repo0' AND context = 'de')").count()


def _json(tmp_path, rows, name="scopes.json"):
    path = tmp_path / name
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")
    return str(path)


@pytest.fixture(scope="module")
def bucketed(spark, tmp_path_factory):
    state = C.doc_state(spark, D)
    table = f"documents_{uuid.uuid4().hex[:8]}"
    path = str(tmp_path_factory.mktemp("b") / "t")
    yield state, FL.write_bucketed(state, path, table, n_buckets=16), path
    spark.sql(f"DROP TABLE IF EXISTS {table}")


def _exchanges_over_state(df):
    """Shuffles whose input is the scan of the bucketed table: walks each scan's parents in the plan tree."""
    tree = plan_text(df, "simple").splitlines()
    found = []
    for i, line in enumerate(tree):
        if "FileScan parquet" in line and "documents_" in line:
            depth = len(line) - len(line.lstrip(" :+-*()0123456789"))
            for up in reversed(tree[:i]):
                d = len(up) - len(up.lstrip(" :+-*()0123456789"))
                if d < depth:
                    depth = d
                    if "SortMergeJoin" in up or "ShuffledHashJoin" in up or "BroadcastHashJoin" in up or "HashAggregate" in up:
                        break
                    if "Exchange" in up:
                        found.append(up.strip())
    return found


def test_sync_exchanges_only_the_changes(spark, bucketed):
    state, table, _ = bucketed
    inc = C.doc_incoming(spark, D)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        classes = SY.classify(table, inc, keep_content=False)
        pruned = SY.prune(table, inc)
        changes = inc.select(*SY.KEY, F.col("content").alias("description"), F.col("modified_at").alias("updated_at"))
        merged = SY.upsert(table, changes)
        for df in (classes, pruned, merged):
            assert "Bucketed: true" in plan_text(df) and not _exchanges_over_state(df), plan_text(df, "simple")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 << 20))
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert same(classes, SY.classify(state, inc, keep_content=False)) and same(pruned, SY.prune(state, inc)) and same(merged, SY.upsert(state, changes))


def test_bucketed_table_in_another_catalog(spark, bucketed):
    state, table, path = bucketed
    again = FL.read_bucketed(spark, path, f"documents_{uuid.uuid4().hex[:8]}", table.schema, n_buckets=16)
    assert again.count() == state.count() and "Bucketed: true" in plan_text(again.groupBy(*SY.KEY).count())


def test_salted_join_levels_a_branch_with_half_of_all_runs(spark):
    runs = spark.range(40_000).select("id", F.when(F.col("id") % 2 == 0, "main").when(F.col("id") % 11 == 0, None).otherwise(F.concat(F.lit("b"), (F.col("id") % 997).cast("string"))).alias("head_ref"))
    prs = spark.createDataFrame([(1, "main"), (2, "main"), (3, "nowhere")] + [(10 + i, f"b{i}") for i in range(997)], "number long, head_ref string")
    assert SK.heavy_keys(runs, "head_ref", share=0.1) == ["main"] and SK.heavy_keys(runs.limit(0), "head_ref") == []
    for how in ("inner", "right", "left_semi"):
        got = SK.salted_join(prs, runs, "head_ref", heavy=["main"], salts=32, how=how)
        plain = runs.join(prs, "head_ref", "left_semi") if how == "left_semi" else prs.join(runs, "head_ref", how)
        assert sorted(map(str, got.select(*sorted(got.columns)).collect())) == sorted(map(str, plain.select(*sorted(plain.columns)).collect()))
    for k, v in (("spark.sql.adaptive.enabled", "false"), ("spark.sql.autoBroadcastJoinThreshold", "-1")):
        spark.conf.set(k, v)
    try:
        joined = SK.salted_join(prs, runs, "head_ref", heavy=["main"], salts=64)
        sizes = sorted(r["count"] for r in joined.filter("number <> 2").groupBy(F.spark_partition_id()).count().collect())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 << 20))
    assert sizes[-1] <= 3 * sizes[len(sizes) // 2], sizes


def _rendered(paths):
    """The lines of a tree drawn by plain recursion."""
    tree = {}
    for p in paths:
        at = tree
        for part in p.split("/"):
            at = at.setdefault(part, {})
    out = {}

    def draw(node, prefix, path):
        names = sorted(node, key=lambda s: s.encode())
        for i, n in enumerate(names):
            last = i == len(names) - 1
            full = f"{path}/{n}" if path else n
            out[full] = prefix + ("└── " if last else "├── ") + n
            draw(node[n], prefix + ("    " if last else "│   "), full)

    draw(tree, "", "")
    return out


def test_tree_lines_of_deep_trees(spark):
    r = random.Random(3)
    paths = {"/".join(r.choice("abc") + str(k) for k in range(r.randint(1, 19))) + "/f.txt" for _ in range(60)} | {"top.txt", "a/b/c"}
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    lines = TR.tree_lines(TR.manifest(files))
    assert {x["path"]: x["line"] for x in lines.collect()} == _rendered(paths)
    assert "Generate" not in plan_text(lines).split("Scan ExistingRDD")[0]  # no node explodes its ancestors; directories are derived before
    flat = spark.createDataFrame([("x.txt",), ("y.txt",)], "path string")
    assert {x["line"] for x in TR.tree_lines(TR.manifest(flat)).collect()} == {"├── x.txt", "└── y.txt"}


def test_missing_target_is_an_error_when_asked(spark):
    files = spark.createDataFrame([("a/b.txt",)], "path string")
    assert TR.subtree_scope(files, "a", missing_ok=False).count() == 1 and TR.subtree_scope(files, "zz").count() == 0
    with pytest.raises(FileNotFoundError):
        TR.subtree_scope(files, "zz", missing_ok=False)


def test_dump_with_bad_lines(spark, tmp_path):
    good = {"id": 1, "name": "ci", "head_branch": "main", "status": "completed", "conclusion": "failure", "html_url": "u", "extra": {"x": [1]}}
    path = _json(tmp_path, [good, "{broken", '{"id": "not a number"}', good | {"id": 2}, ""], "runs.json")
    rows, bad = CI.read_dump(spark, path, CI.RUN_SCHEMA)
    assert sorted(r["id"] for r in CI.workflow_runs(rows).collect()) == [1, 2] == sorted(r["id"] for r in CI.read_runs(spark, path).collect())
    assert sorted((r["file"], r["line"]) for r in bad.collect()) == [("runs.json", '{"id": "not a number"}'), ("runs.json", "{broken")]
    prs = CI.read_prs(spark, _json(tmp_path, [{"number": 3, "title": "t", "state": "open", "head": {"ref": "main", "sha": "0"}}], "prs.json")).collect()
    assert [tuple(r) for r in prs] == [(3, "t", "open", "main")]


def test_load_reports_counts_from_the_pass_that_writes(spark):
    def summarize(text):
        if "boom" in text:
            raise ValueError("no")
        return "" if "blank" in text else text

    t = dt.datetime(2024, 1, 1)
    files = spark.createDataFrame([("r", "c", "a", "fine", t), ("r", "c", "b", "boom", t), ("r", "c", "d", "blank", t), ("r", "c", "e", "", t), ("r", "c", "f", "ok", t)],
                                  "repository string, context string, filepath string, content string, modified_at timestamp_ntz")
    state = spark.createDataFrame([], "id long, repository string, context string, filepath string, description string, updated_at timestamp_ntz, embedding array<float>")
    seen = Observation("load")
    nxt, errors = LD.load_documents(state, files, summarize=summarize, loaded_at=t, observation=seen)
    assert seen.get == {"n_changed": 4, "n_failed": 1, "n_skipped": 1, "n_ok": 2}
    assert nxt.count() == 2 and errors.count() == 1
