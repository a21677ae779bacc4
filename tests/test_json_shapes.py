"""JSON in any case, nested manifests, ordered chunks of digests."""

import json
import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry import schemas as S
from quarry.functions.running import running_sums
from quarry.operators import digest as DG
from quarry.operators import nested as NE
from quarry.operators import plans as PL


def _parsed(spark, texts, schema):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, json string")
    return [(r["j"].asDict(recursive=True) if r["j"] is not None else None, r["bad"]) for r in PL.parse_json_any_case(df, schema, bad="bad").orderBy("i").collect()]


def test_keys_in_any_case(spark):
    texts = ['{"answer": true}', '{"Answer": true}', '{"ANSWER": false, "other": 1}', '{"answer": true, "Answer": false}', "{}", "no json", "[true]", None, '{"answer": "x"}', '{"answer": null}']
    assert _parsed(spark, texts, S.YES_OR_NO) == [
        ({"answer": True}, False), ({"answer": True}, False), ({"answer": False}, False), ({"answer": True}, False), ({"answer": None}, False),
        (None, True), (None, True), (None, True), ({"answer": None}, False), ({"answer": None}, False)]
    review = _parsed(spark, ['{"Plan_ID": "p", "RESULT": true, "Comment": "é\\n"}'], S.REVIEW)
    assert review == [({"plan_id": "p", "result": True, "comment": "é\n"}, False)]


def test_nested_shapes_in_any_case(spark):
    plan = {"ID": "7", "Query": "q", "Changes": [{"BLOCK": {"Path": "a.go", "target_type": "function", "X": 1}, "new_content": "c"}, {"block": None}], "extra": {}}
    got, bad = _parsed(spark, [json.dumps(plan)], S.CHANGES_PLAN)[0]
    assert not bad and got["id"] == "7" and got["changes"][0]["block"]["path"] == "a.go" and got["changes"][0]["new_content"] == "c"
    assert got["changes"][1] == {"block": None, "new_content": None, "new_comment": None}
    summary = {"Summary": {"Project_Name": "p", "ENV_VARS": [{"Name": "A", "description": "d"}]}, "directory_summaries": {"Dir/One": {"Purpose": "x", "components": ["c"]}}}
    got = _parsed(spark, [json.dumps(summary)], S.REPO_SUMMARY)[0][0]
    assert got["summary"]["project_name"] == "p" and got["summary"]["env_vars"] == [{"name": "A", "description": "d"}]
    assert got["directory_summaries"] == {"Dir/One": {"purpose": "x", "components": ["c"], "description": None}}
    deep = {"Query": "q", "filerepairs": [{"FILE": "f", "BlockRepairs": [{"block": {"Name": "n"}, "repairs": [{"sample": 1, "REPAIR": {"Diff": "d"}}]}]}]}
    got = _parsed(spark, [json.dumps(deep)], S.REPAIR_OUTPUT)[0][0]
    assert got["FileRepairs"][0]["BlockRepairs"][0]["Repairs"] == [{"Sample": 1, "Repair": {"diff": "d"}}]


def _random_tree(r, depth, prefix=""):
    out = []
    for k in range(r.randint(1, 4)):
        name = f"n{k}" + r.choice(["", ' "q"', "é", "."])
        path = f"{prefix}/{name}" if prefix else name
        is_dir = depth > 1 and r.random() < 0.6
        kids = _random_tree(r, depth - 1, path) if is_dir else []
        node = {"name": name, "path": path, "is_dir": is_dir}
        if kids:
            node["children"] = kids
        if not is_dir:
            node |= {"blob_hash": f"{r.random():.9f}", "size": r.randint(0, 5)}
        out.append(node)
    return out


def _flat(nodes):
    for n in nodes:
        yield (n["path"], n["name"], n["path"].rpartition("/")[0], n["is_dir"], n.get("blob_hash"), n.get("size"))
        yield from _flat(n.get("children") or [])


def test_nested_manifest_at_any_depth(spark):
    r = random.Random(2)
    trees = {f"t{i}": _random_tree(r, d) for i, d in enumerate((1, 2, 5, 9))}
    docs = [(t, json.dumps({"generated_at": "x", "root": {"name": "", "path": "", "is_dir": True, "children": nodes}})) for t, nodes in trees.items()]
    docs += [("empty", '{"root":{"name":"","children":null}}'), ("bad", "{"), ("none", None), ("cased", '{"Root":{"Children":[{"NAME":"a","Is_Dir":true,"children":[{"name":"b","future":[1]}]}]}}')]
    frame = spark.createDataFrame(docs, "tree string, json string")
    flat = NE.from_nested(frame, keep=("tree",))
    got = {}
    for x in flat.collect():
        got.setdefault(x["tree"], set()).add((x["path"], x["name"], x["parent"], x["is_dir"], x["blob_hash"], x["size"]))
    assert got.pop("cased") == {("a", "a", "", True, None, None), ("a/b", "b", "a", False, None, None)}
    assert got == {t: set(_flat(nodes)) for t, nodes in trees.items()}
    # and back: the same documents but for the order of children and what is empty
    again = {x["tree"]: json.loads(x["json"]) for x in NE.to_nested(flat.filter("tree <> 'cased'"), generated_at="x").collect()}
    for t, nodes in trees.items():
        assert again[t]["generated_at"] == "x" and sorted(map(str, _flat(again[t]["root"]["children"]))) == sorted(
            str((p, n, up, d, h, s or None)) for p, n, up, d, h, s in _flat(nodes))
        names = [n["name"] for n in again[t]["root"]["children"]]
        assert names == sorted(names, key=lambda s: s.encode())
    assert NE.from_nested(frame.filter("tree = 'bad'")).count() == 0 and NE.to_nested(flat.limit(0), generated_at="x").count() == 0


def test_chunks_joined_are_the_text(spark):
    r = random.Random(4)
    docs = [(f"d{0 if r.random() < 0.6 else r.randrange(5)}/f{i:04}.txt", "s" * r.randint(0, 300)) for i in range(900)] + [("top.txt", None)]
    frame = spark.createDataFrame(docs, "filepath string, description string").repartition(6)
    chunks = DG.directory_text(frame, max_bytes=1_000).collect()
    want = {}
    for path, text in sorted(docs):
        d = path.rpartition("/")[0] or "."
        want[d] = want.get(d, f"Directory: {d}\n") + f"File: {path}\nSummary: {text or ''}\n"
    for d, text in want.items():
        mine = sorted((c["chunk"], c["digest"]) for c in chunks if c["directory"] == d)
        assert "".join(t for _, t in mine) == text
        assert max(len(t) for _, t in mine) <= 1_000 + 400 and len({c for c, _ in mine}) == len(mine)
    assert sum(c["n_files"] for c in chunks) == len(docs)
    dirs = spark.createDataFrame([("r1", f"d{i:03}", f"text {i}") for i in range(200)] + [("r2", "x", "only")], "repository string, directory string, summary string")
    parts = DG.repository_text(dirs, max_bytes=300).collect()
    assert "".join(t for _, t in sorted((c["chunk"], c["digest"]) for c in parts if c["repository"] == "r1")) == "\n\n".join(f"text {i}" for i in range(200))
    assert [c["digest"] for c in parts if c["repository"] == "r2"] == ["only"]


def test_summary_parts_are_the_json(spark):
    dirs = spark.createDataFrame([("r1", f'd"{i:03}é', f"p{i}", ["c"], None if i % 3 else "d\n") for i in range(120)], "repository string, directory string, purpose string, components array<string>, description string")
    overall = spark.createDataFrame([("r1", ("n", "p")), ("r0", ("n0", "p0"))], T.StructType([T.StructField("repository", T.StringType()), T.StructField("summary", T.StructType([T.StructField("project_name", T.StringType()), T.StructField("purpose", T.StringType())]))]))
    parts = DG.summary_parts(overall, dirs, max_bytes=500).collect()
    whole = {r["repository"]: r["json"] for r in DG.merge_summaries(overall, dirs).collect()}
    joined = {k: "".join(j for _, j in sorted((r["part"], r["json"]) for r in parts if r["repository"] == k)) for k in whole}
    assert joined["r1"] == whole["r1"] and len(parts) > 10
    assert json.loads(joined["r0"]) == {"summary": {"project_name": "n0", "purpose": "p0"}}


def test_running_sums_of_a_group_over_many_stretches(spark):
    rows = [("hot" if i % 4 else f"g{i % 40}", i, i % 9) for i in range(6_000)]
    df = spark.createDataFrame(rows, "g string, at long, n long").repartition(9)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = running_sums(df, ["g"], ["at"], {"before": "n"})
        got = {r["at"]: r["before"] for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    past, want = {}, {}
    for g, at, n in rows:
        want[at] = past.get(g, 0)
        past[g] = want[at] + n
    assert got == want
    assert out.columns == ["g", "at", "n", "before"] and df.columns == ["g", "at", "n"]
    assert running_sums(df.limit(0), ["g"], ["at"], {"before": "n"}).count() == 0


def test_any_case_stays_in_the_jvm(spark):
    from quarry.plans.inspect import plan_text
    df = spark.createDataFrame([('{"answer": true}',)], "json string")
    assert "EvalPython" not in plan_text(PL.parse_json_any_case(df, S.CHANGES_PLAN).select(F.col("j.id")))


def test_each_object_is_read_once_at_every_level(spark):
    """A type nested deeper makes the expression longer by a level, not a number of times as long."""
    def size(depth):
        kind = T.StringType()
        for i in range(depth):
            kind = T.StructType([T.StructField(f"f{i}", kind), T.StructField("x", T.LongType())])
        df = PL.parse_json_any_case(spark.createDataFrame([("{}",)], "json string").filter("json <> ''"), kind)
        return df._jdf.queryExecution().optimizedPlan().toString().lower().count("map<string,variant>") + df._jdf.queryExecution().optimizedPlan().toString().count("MapType")
    assert size(6) - size(5) <= size(3) - size(2)


def test_keys_of_mixed_case_among_null_and_odd_values(spark):
    texts = ['{"PLAN_ID": 1.50, "result": null, "RESULT": true, "comment": null}', '{"plan_id": {"a": 1}, "Result": true, "rESULT": false, "Comment": [1]}',
             '{"plan_id": "p", "Plan_id": "q", "result": true}', '{"plan_id": "p", "plan_id": "q"}']
    assert _parsed(spark, texts, S.REVIEW) == [
        ({"plan_id": "1.5", "result": None, "comment": None}, False), ({"plan_id": '{"a":1}', "result": False, "comment": "[1]"}, False),
        ({"plan_id": "p", "result": True, "comment": None}, False), (None, True)]
    both = _parsed(spark, ['{"block": {"NAME": 3, "Block_Type": null, "block_type": "t"}}', '{"block": "x"}'], T.StructType([T.StructField("Block", S.LOCATED_BLOCK)]))
    assert both == [({"Block": {"block_type": "t", "name": "3"}}, False), ({"Block": None}, False)]
