"""Vector operators: reference literal cases, kNN join vs brute force, plans."""

import math

import numpy as np
from pyspark.sql import functions as F

from quarry.functions.vectors import cosine_distance, l2_distance
from quarry.operators import vectors as V
from quarry.plans.inspect import plan_text


def test_l2_literal_distances(spark):
    # distances 0, 1, sqrt 2, sqrt 3 from [1,2,3]
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [1.0, 2.0, 3.0]), ([1.0, 2.0, 3.0], [1.0, 2.0, 2.0]),
                                ([1.0, 2.0, 3.0], [1.0, 1.0, 2.0]), ([1.0, 2.0, 3.0], [0.0, 1.0, 2.0])],
                               "a array<float>, b array<float>")
    got = [r.d for r in df.select(l2_distance("a", "b").alias("d")).collect()]
    assert got == [0.0, 1.0, math.sqrt(2), math.sqrt(3)]


def test_dimension_mismatch_is_null_or_error(spark):
    df = spark.createDataFrame([([1.0, 2.0], [1.0, 2.0, 3.0])], "a array<float>, b array<float>")
    assert df.select(l2_distance("a", "b", strict=False).alias("d")).first().d is None
    import pytest
    with pytest.raises(Exception):
        df.select(l2_distance("a", "b").alias("d")).collect()


def test_cosine_zero_vector_is_null(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0])], "a array<float>, b array<float>")
    assert df.select(cosine_distance("a", "b").alias("d")).first().d is None


def test_add_then_search_returns_one(spark):
    docs = spark.createDataFrame([(1, "a.go", [0.1] * 8)], "id long, filepath string, embedding array<float>")
    hits = V.knn_search(docs, F.lit([0.1] * 8).cast("array<float>"), 10).collect()
    assert [h.filepath for h in hits] == ["a.go"]


def _brute(q, c, k, metric, exclude_self):
    out = {}
    for qi, qv in q:
        sc = []
        for ci, cv in c:
            if exclude_self and ci == qi:
                continue
            a, b = np.asarray(cv, np.float32), np.asarray(qv, np.float32)
            if metric == "l2":
                s = math.sqrt(sum(float(x) ** 2 for x in (a - b).astype(np.float64)))
            else:
                den = math.sqrt(sum(float(x) ** 2 for x in a)) * math.sqrt(sum(float(x) ** 2 for x in b))
                s = 1 - sum(float(x) * float(y) for x, y in zip(a, b)) / den
            sc.append((s, ci))
        out[qi] = [ci for _, ci in sorted(sc)[:k]]
    return out


def test_knn_join_matches_brute_force_with_many_blocks(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "s" + str(i % 2), rng.normal(size=6).round(1).astype(float).tolist()) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, scope string, embedding array<float>")
    # block_rows=16 forces several query and corpus blocks per scope; rounding creates ties
    for metric, excl, strategy in (("l2", False, "blocks"), ("cosine", True, "blocks"),
                                   ("l2", False, "broadcast"), ("cosine", True, "broadcast")):
        got = V.knn_join(df.withColumnRenamed("id", "qid"), df, 4, scope=["scope"], metric=metric,
                         exclude_self=excl, block_rows=16, strategy=strategy).collect()
        res = {}
        for r in sorted(got, key=lambda r: (r.qid, r.rank)):
            res.setdefault(r.qid, []).append(r.id)
        for s in ("s0", "s1"):
            part = [(i, e) for i, sc, e in rows if sc == s]
            exp = _brute(part, part, 4, metric, excl)
            for qi in exp:
                assert res[qi] == exp[qi], (metric, strategy, qi)


def test_batch_with_one_query_equals_single_search(spark):
    from quarry.sources import corpus as C
    v = C.vectors(spark, "/root/testdata/sf0.001")
    q = v.filter("id = 0").select(F.col("id").alias("qid"), "repository", "context", "embedding")
    batch = V.knn_join(q, v, 10, scope=["repository", "context"]).orderBy("rank").collect()
    from quarry.plans.cases.vectors import flagship
    single = flagship(spark, "/root/testdata/sf0.001").collect()
    assert [r.id for r in batch] == [r.id for r in single]
    assert [r.score for r in batch] == [r.score for r in single]


def test_flagship_plan_is_scan_plus_top_k(spark):
    from quarry.plans.cases.vectors import flagship
    txt = plan_text(flagship(spark, "/root/testdata/sf0.001"))
    assert "TakeOrderedAndProject" in txt
    assert "CartesianProduct" not in txt and "NestedLoopJoin" not in txt
    assert "PushedFilters: [IsNotNull(vec_id), EqualTo(vec_id,0)]" in txt  # the query-row subquery


def test_batch_plans_use_window_group_limit_and_no_cartesian(spark):
    from quarry.sources import corpus as C
    v = C.vectors(spark, "/root/testdata/sf0.001")
    q = v.select(F.col("id").alias("qid"), "repository", "context", "embedding")
    for strategy, op in (("blocks", "FlatMapCoGroupsInPandas"), ("broadcast", "MapInPandas")):
        txt = plan_text(V.knn_join(q, v, 10, scope=["repository", "context"], strategy=strategy))
        assert "WindowGroupLimit" in txt and op in txt
        assert "CartesianProduct" not in txt and "NestedLoopJoin" not in txt


def test_ann_recall(spark):
    from quarry.sources import corpus as C
    v = C.vectors(spark, "/root/testdata/sf0.01")
    query = v.filter("id = 0").select("embedding")
    exact = V.knn_search(v, query.scalar(), 10).collect()
    approx = V.knn_ann(v.select("id", "embedding"), query.first()[0], 10).collect()
    recall = len({r.id for r in exact} & {r.id for r in approx}) / 10
    assert recall >= 0.9, recall


def test_query_set_byte_bound(spark):
    from quarry.operators.vectors import _query_set_fits
    q = spark.createDataFrame([(i, [0.5] * 100) for i in range(10)], "qid long, qvec array<float>")
    assert _query_set_fits(q, 10, 10 * 100 * 4)
    assert not _query_set_fits(q, 9, 1 << 30)          # too many rows
    assert not _query_set_fits(q, 10, 10 * 100 * 4 - 1)  # too many bytes
