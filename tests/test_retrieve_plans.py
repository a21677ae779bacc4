"""Retrieval, digests, plans: the reference's retriever, reviewer and planner cases."""

from pyspark.sql import functions as F

from quarry import schemas as S
from quarry.operators import plans as PL
from quarry.operators import retrieve as R


def test_ensemble_first_wins(spark):
    a = spark.createDataFrame([(1, "1", 1), (1, "2", 2)], "qid int, filepath string, rank int")
    b = spark.createDataFrame([(1, "1", 1), (1, "4", 2)], "qid int, filepath string, rank int")
    got = [r.filepath for r in R.ensemble([a, b]).orderBy("position").collect()]
    assert got == ["1", "2", "4"]
    one = [r.filepath for r in R.ensemble([a]).orderBy("position").collect()]
    assert one == ["1", "2"]


def test_path_list_keeps_order_and_skips_missing(spark):
    lists = spark.createDataFrame([('{"paths":["mock/file1.go","nope.go","mock/file3.go"]}',)], "json string")
    lists = lists.select(F.lit(1).alias("qid"), F.from_json("json", S.FILE_LIST)["paths"].alias("paths"))
    files = spark.createDataFrame([("mock/file1.go", "a"), ("mock/file3.go", "c")], "path string, content string")
    got = [r.path for r in R.paths_from_lists(lists, files).orderBy("pos").collect()]
    assert got == ["mock/file1.go", "mock/file3.go"]


def test_review_json_and_change_report(spark):
    df = spark.createDataFrame([('{"plan_id":"123","result":true,"comment":"ok"}',)], "json string")
    r = df.select(F.from_json("json", S.REVIEW).alias("r")).first().r
    assert (r.plan_id, r.result) == ("123", True)
    plan = spark.createDataFrame(
        [("1", "q", [(("a.go", "function", "F", ""), "body", "c")])],
        "id string, query string, changes array<struct<block:struct<path:string,target_type:string,"
        "target_name:string,content:string>,new_content:string,new_comment:string>>")
    rep = PL.change_report(plan).first().report
    assert rep == ("---- change 0 -----\nPath: a.go, Type: function, Name: F,\nNewContent: body\n"
                   "----- change 0 end ----\n")


def test_investigation_record_text(spark):
    df = spark.createDataFrame([(["a.go", "b.go"], [], "done")],
                               "target_files array<string>, reference_files array<string>, result string")
    got = df.select(PL.investigation_record(F.struct("target_files", "reference_files", "result")).alias("t")).first().t
    assert got == "Target Files: [a.go b.go]\nReference Files: []\nResult: done"


def test_action_plan_listing(spark):
    df = spark.createDataFrame([([("goal", (["i1", "i2"], ["c1"]))],)],
                               "examples array<struct<goal:string,plan:struct<investigate_steps:array<string>,"
                               "change_steps:array<string>>>>")
    got = df.select(PL.action_plan_text(F.col("examples")).alias("t")).first().t
    assert got == ("--- Example 1 ---\nGoal: goal\nSteps:\n- Investigation:\n\t- i1\n\t- i2\n- Changes Plan:\n"
                   "\t- c1\n--- Example end 1 ---\n")


def test_messages_unknown_role_is_system(spark):
    df = spark.createDataFrame([(1, 0, "tool", "x"), (1, 1, "user", "y")], "c int, turn int, role string, text string")
    m = R.messages(df, group="c", order="turn").first().messages
    assert [(x.type, x.content) for x in m] == [("system", "x"), ("user", "y")]


def test_owner_repo(spark):
    from quarry.operators.ci import owner_repo
    df = spark.createDataFrame([("https://github.com/o/r.git",), ("x",)], "url string")
    got = [(r.owner, r.repo, r.error) for r in owner_repo(df).collect()]
    assert got == [("o", "r", None), (None, None, "invalid remote URL")]


def test_judge_filter(spark):
    import pytest
    df = spark.createDataFrame([("a.go", "keep me"), ("b.go", "drop")], "path string, content string")
    got = [r.path for r in R.judge_filter(df, lambda t: "keep" in t).collect()]
    assert got == ["a.go"]

    def bad(t):
        raise RuntimeError("judge down")
    with pytest.raises(Exception):
        R.judge_filter(df, bad).collect()


def test_get_and_first(spark):
    import pytest
    from quarry.operators.query import NotFoundError, first, get
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    assert get(df, 2).first().v == "b"
    with pytest.raises(NotFoundError):
        get(df, 3)
    assert first(df, ["v"]).first().id == 1


def test_ci_json_readers(spark):
    import json
    import os
    import tempfile

    from quarry.operators.ci import runs_for_prs
    from quarry.sources.ci import read_prs, read_runs
    d = tempfile.mkdtemp(prefix="quarry-ci-")
    with open(os.path.join(d, "prs.json"), "w") as f:
        f.write(json.dumps({"number": 7, "title": "t", "state": "open", "head": {"ref": "feat", "sha": "x"}}) + "\n")
    with open(os.path.join(d, "runs.json"), "w") as f:
        for i, b in enumerate(["feat", "main"]):
            f.write(json.dumps({"id": i, "name": "ci", "head_branch": b, "status": "completed",
                                "conclusion": "failure", "html_url": "u"}) + "\n")
    got = runs_for_prs(read_prs(spark, d + "/prs.json"), read_runs(spark, d + "/runs.json")).collect()
    assert [(r.number, r.id) for r in got] == [(7, 0)]


def test_directory_digest_chunks_cover_every_file_once(spark):
    from quarry.operators.digest import directory_digest
    rows = [(f"d/f{i:02d}.go", f"s{i}") for i in range(10)] + [("top.go", "t")]
    df = spark.createDataFrame(rows, "filepath string, description string")
    out = directory_digest(df, max_files=3).collect()
    d = [r for r in out if r.directory == "d"]
    assert len(d) <= 4 and sum(r.n_files for r in d) == 10
    seen = []
    for r in d:
        files = [ln[len("File: "):] for ln in r.digest.splitlines() if ln.startswith("File: ")]
        assert files == sorted(files) and r.digest.startswith("Directory: d\n")
        seen += files
    assert sorted(seen) == [p for p, _ in rows[:10]]
    assert [r.chunk for r in out if r.directory == "."] == [0]


def test_pack_chunks_consecutive_turns(spark):
    df = spark.createDataFrame([(1, t, "user", f"m{t}") for t in range(5)], "c int, turn int, role string, text string")
    out = sorted(R.pack(df, ["c"], "turn", F.col("text"), max_items=2).collect(), key=lambda r: r.chunk)
    assert [(r.chunk, r.text) for r in out] == [(0, "m0\nm1"), (1, "m2\nm3"), (2, "m4")]


def test_context_layouts_of_odd_files(spark):
    from pyspark.sql import functions as F

    from quarry.operators import retrieve as R
    df = spark.createDataFrame([("a", None, None), ("b", "x\ny", [("function", "f"), ("function", "g")])], "path string, content string, blocks array<struct<target_type:string,target_name:string>>")
    p, c = F.col("path"), F.col("content")
    got = df.orderBy("path").select(R.located_file(p, c), R.planned_file(p, c, F.col("blocks")), R.investigated_file(p, c)).collect()
    assert tuple(got[0]) == ("\n### File: a ###\n```\n\n```", "\n--------------------\nfilepath:a\n--\n--- content end---\n--- blocks ---\nNo blocks found", "--- a start ---\n\n--- a end ---\n")
    assert got[1][1].endswith("--x\ny\n--- content end---\n--- blocks ---\n\n- function: f\n- function: g")


def test_update_one_and_scalar_forms(spark):
    import pytest
    from pyspark.sql import functions as F

    from quarry.operators import query as Q
    df = spark.createDataFrame([(1, "7", True), (2, "x", False)], "id long, a string, b boolean")
    assert [tuple(r) for r in Q.update_one(df, 2, {"a": F.concat("a", F.lit("!"))}).orderBy("id").collect()] == [(1, "7", True), (2, "x!", False)]
    with pytest.raises(Q.NotFoundError):
        Q.update_one(df, 3, {"a": F.lit("z")})
    assert Q.scalar_as(df.filter("id = 1"), "a", "ints").first()[0] == 7
    with pytest.raises(Q.NotSingularError):
        Q.scalar_as(df, "b", "bools")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        Q.scan_as(df, "a", "ints").collect()
