"""The ordered diff against brute force: replay, longest common subsequences, GNU-style hunks."""

import difflib
import random

from quarry.operators import diff as DF

SCHEMA = "path string, content string"


def _frames(spark, pairs):
    before = spark.createDataFrame([(f"f{i}", a) for i, (a, _) in enumerate(pairs) if a is not None], SCHEMA)
    after = spark.createDataFrame([(f"f{i}", b) for i, (_, b) in enumerate(pairs) if b is not None], SCHEMA)
    return before, after


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def _pairs(seed, n):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        words = [r.choice("abcdefg") * r.randint(1, 2) for _ in range(r.randint(0, 14))]
        other = list(words)
        for _ in range(r.randint(0, 5)):
            k = r.randrange(len(other) + 1)
            other[k : k + r.randint(0, 2)] = [r.choice("abcxyz")] * r.randint(0, 2)
        out.append(("\n".join(words) + r.choice(["", "\n"]), "\n".join(other) + r.choice(["", "\n"])))
    return out + [(None, "new\nfile\n"), ("gone\n", None), ("", "x"), ("x", ""), ("same\n", "same\n"), ("a\n\n\nb\n", "a\n\nb\n\n"), ("a\r\nb", "a\nb")]


def test_script_replays_and_is_ordered(spark):
    pairs = _pairs(3, 40)
    before, after = _frames(spark, pairs)
    changes = DF.script(before, after)
    rows = changes.orderBy("path", "place", "kind", "a_line", "b_line").collect()
    got = {r["path"]: r["content"] for r in DF.replay(before, changes).collect()}
    for i, (a, b) in enumerate(pairs):
        assert got[f"f{i}"] == (b or ""), (a, b)
    assert not [r for r in rows if pairs[int(r["path"][1:])][0] == pairs[int(r["path"][1:])][1]]
    for r in rows:
        assert (r["op"] == "-") == (r["a_line"] is not None) and (r["op"] == "+") == (r["b_line"] is not None)


def test_distinct_lines_keep_a_longest_common_subsequence(spark):
    r = random.Random(5)
    pairs = []
    for _ in range(30):
        a = [f"line {k}" for k in r.sample(range(30), r.randint(1, 16))]
        b = r.sample(a, len(a)) if r.random() < 0.5 else [x for x in a if r.random() < 0.8] + ["new"]
        pairs.append(("\n".join(a) + "\n", "\n".join(b) + "\n"))
    before, after = _frames(spark, pairs)
    kept = {}
    for row in DF.script(before, after, keep=True).collect():
        kept[row["path"]] = kept.get(row["path"], 0) + (row["op"] == " ")
    for i, (a, b) in enumerate(pairs):
        if a != b:
            assert kept[f"f{i}"] == _lcs(a.splitlines(), b.splitlines())


def test_two_swapped_lines_show(spark):
    before, after = _frames(spark, [("1\n2\n3\n", "2\n1\n3\n")])
    rows = {(r["op"], r["text"]) for r in DF.script(before, after).collect()}
    assert rows in ({("-", "1"), ("+", "1")}, {("-", "2"), ("+", "2")})


def test_repeated_lines_between_anchors(spark):
    """Braces and blank lines repeat; recursion between anchors still keeps them."""
    a = "func a() {\n}\n\nfunc b() {\n\tx\n}\n\nfunc c() {\n}\n"
    b = "func a() {\n}\n\nfunc b() {\n\ty\n}\n\nfunc c() {\n}\n"
    before, after = _frames(spark, [(a, b)])
    assert sorted((r["op"], r["text"], r["a_line"] or r["b_line"]) for r in DF.script(before, after).collect()) == [("+", "\ty", 5), ("-", "\tx", 5)]


def _by_difflib(a, b):
    def lines(t):
        parts = t.split("\n")
        return parts[:-1] if parts[-1] == "" else parts[:-1] + [parts[-1] + DF.NO_NEWLINE]

    out, hunks = list(difflib.unified_diff(lines(a), lines(b), lineterm=""))[2:], []
    for x in out:
        if x.startswith("@@"):
            hunks.append([x, []])
        else:
            hunks[-1][1].append(x)
    return [(h, "\n".join(t)) for h, t in hunks]


def test_unified_hunks(spark):
    """Edits apart from each other in files of distinct lines have one diff, that of any tool."""
    r = random.Random(9)
    pairs = [("", "a\nb\n"), ("a\nb\n", ""), ("a\n", "a"), ("x\ny\nz", "x\ny\nz\n")]
    for _ in range(25):
        a = [f"line {i}" for i in range(r.randint(1, 60))]
        b = []
        for i, x in enumerate(a):
            k = r.random()
            b += [] if k < 0.06 else [f"changed {i}"] if k < 0.12 else [x, f"more {i}"] if k < 0.16 else [x]
        pairs.append(("\n".join(a) + "\n", "\n".join(b) + r.choice(["", "\n"]) if b else ""))
    before, after = _frames(spark, pairs)
    got = {}
    for row in DF.unified(before, after).orderBy("path", "hunk").collect():
        got.setdefault(row["path"], []).append((row["header"], row["text"]))
    for i, (a, b) in enumerate(pairs):
        assert got.get(f"f{i}", []) == (_by_difflib(a, b) if a != b else [])


def test_texts_meet_once_and_lines_stay_by_path(spark):
    """Texts of both sides meet in one shuffle, the script's lines need another one; no round writes a checkpoint."""
    before, after = _frames(spark, [("a\nb\n", "a\nc\n"), ("x\n", "x\n")])
    before, after = before.repartition(3), after.repartition(3)
    hint = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df, n in ((DF.unified(before, after), 2), (DF.replay(before, DF.script(before, after)), 3)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning(path") == n and plan.count("ArrowEvalPython") == 1, plan
            assert "ExistingRDD" not in plan.replace("Scan ExistingRDD[path", "")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", hint)


def test_long_files_with_far_changes(spark):
    a = [f"line {i}" for i in range(4_000)]
    b = a[:10] + ["new"] + a[10:3_990] + a[3_991:]
    before, after = _frames(spark, [("\n".join(a) + "\n", "\n".join(b) + "\n")])
    got = [r["header"] for r in DF.unified(before, after).orderBy("hunk").collect()]
    assert got == ["@@ -8,6 +8,7 @@", "@@ -3988,7 +3989,6 @@"]
