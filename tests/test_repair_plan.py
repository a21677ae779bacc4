"""What travels when repairer output is built: keys, not the texts made of them."""

import re

from pyspark.sql import types as T

from quarry.plans.cases import plans


def test_repairs_are_grouped_by_their_keys_alone(spark, tmp_path):
    keys = [(1, 7, 1), (1, 8, 2), (1, 7, 1), (2, None, 1), (3, 5, None)]
    schema = T.StructType([T.StructField("l_orderkey", T.LongType()), T.StructField("l_partkey", T.LongType()), T.StructField("l_linenumber", T.IntegerType())])
    spark.createDataFrame(keys, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "a"), (2, "b")], "o_orderkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    df = plans.repair_samples(spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    grouped = re.findall(r"partial_collect_list\(struct\(([^()]*)\)", plan)
    assert grouped and all("l_partkey" in g for g in grouped)
    rows = sorted((r["query"], str(r["file"]), r["sample"], r["diff"][-19:-16]) for r in df.collect())
    assert [r[:3] for r in rows] == [("a", "f7.go", 0)] * 2 + [("a", "f7.go", 1)] * 2 + [("a", "f8.go", 0), ("a", "f8.go", 1), ("b", "None", 0), ("b", "None", 1)]
