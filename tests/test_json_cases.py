"""The plans' JSON that is read back with keys in any case: what the texts hold, and that no row changes."""

import json

from pyspark.sql import types as T

from quarry.plans.cases import plans

KEYS = ("id", "query", "changes", "block", "path", "target_type", "target_name", "content", "new_content", "new_comment")


def _keys(value):
    if isinstance(value, dict):
        return {k for k in value} | {k for v in value.values() for k in _keys(v)}
    return {k for v in value for k in _keys(v)} if isinstance(value, list) else set()


def _unknown(value):
    return [k for k in value if k.lower().startswith("unknown")]


def test_keys_are_in_upper_title_and_lower_case_by_turns(spark, tmp_path, monkeypatch):
    keys = [(o, o + 5, n) for o in range(3, 9) for n in (1, 2)] + [(3, None, 4), (4, None, 4), (5, 1, None), (7, 9, 2)]
    schema = T.StructType([T.StructField("l_orderkey", T.LongType()), T.StructField("l_partkey", T.LongType()), T.StructField("l_linenumber", T.IntegerType())])
    spark.createDataFrame(keys, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    said = '"id":1, "new_content": {"ID":[2]}, "Path":"x"\n'
    spark.createDataFrame([(o, None if o == 8 else f"{said}{o}") for o in range(3, 10)], "o_orderkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    read, texts = plans.PL.parse_json_any_case, []
    monkeypatch.setattr(plans.PL, "parse_json_any_case", lambda df, *a, **k: texts.append(df) or read(df, *a, **k))

    got = plans.json_plan_any_case(spark, str(tmp_path))
    seen = {}
    for row in texts[0].collect():
        plan = json.loads(row["json"])
        low = {k.lower(): k for k in plan}
        turn = int(plan[low["id"]]) % 3
        seen[turn] = seen.get(turn, 0) + 1
        case = (str.upper, str.title, str.lower)[turn]
        assert {k for k in _keys(plan) if k.lower() in KEYS} == {case(k) for k in KEYS} - ({case("query")} if plan[low["id"]] == "8" else set())
        assert len(_unknown(plan)) == 1 and all(len(_unknown(c)) == 1 for c in plan[low["changes"]])
    assert seen == {0: 2, 1: 2, 2: 2}

    rows = sorted(map(str, got.collect()))
    assert len(rows) == len(keys) and rows == sorted(map(str, plans.json_plan(spark, str(tmp_path)).collect()))
    assert {r["query"] for r in got.collect() if r["plan_id"] == "4"} == {f"{said}4"}
