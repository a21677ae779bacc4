"""The inverted-file index: recall against brute force, reuse, additions and pruned reads."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import vector_index as VI
from quarry.operators import vectors as V
from quarry.plans.inspect import plan_text
from quarry.sources import corpus as C


@pytest.fixture(scope="module")
def vectors(spark):
    return C.vectors(spark, "/root/testdata/sf0.1").select("id", "embedding", "filepath")


@pytest.fixture(scope="module")
def index(spark, vectors, tmp_path_factory):
    return VI.build(vectors, str(tmp_path_factory.mktemp("index") / "ix"), dim=64, keep=["filepath"])


def _asked(vectors, every=100):
    return vectors.filter(F.col("id") % every == 0).select(F.col("id").alias("qid"), "embedding")


def _pairs(hits):
    return {(r["qid"], r["id"]) for r in hits.collect()}


def test_recall_over_the_stated_query_set(index, vectors):
    queries = _asked(vectors)
    exact = _pairs(V.knn_join(queries, vectors, 10))
    found = _pairs(VI.search(index, queries, 10))
    assert len(found) == len(exact) and len(exact & found) / len(exact) >= 0.9


def test_a_second_query_reuses_the_files(spark, index, vectors):
    again = VI.open_index(spark, index.path)
    assert (again.nprobe, again.dim) == (index.nprobe, 64) and (again.centroids == index.centroids).all() and again.sizes.sum() == vectors.count()
    queries = _asked(vectors, 250)
    hits = VI.search(again, queries, 5, exclude_self=True)
    exact = V.knn_join(queries, vectors, 5, exclude_self=True)
    assert len(_pairs(hits) & _pairs(exact)) / len(_pairs(exact)) >= 0.9
    assert not hits.filter("qid = id").count()


def test_all_cells_are_exact(index, vectors):
    queries = _asked(vectors, 500)
    full = {(r["qid"], r["rank"]): (r["id"], r["score"]) for r in VI.search(index, queries, 7, nprobe=len(index.cells)).collect()}
    assert full == {(r["qid"], r["rank"]): (r["id"], r["score"]) for r in V.knn_join(queries, vectors, 7).collect()}


def test_blocks_of_a_hot_cell(spark, tmp_path):
    """Copies of one vector fill a cell that is searched in many blocks; fewer rows than k are all found."""
    rows = [(i, [1.0, 0.0] if i < 500 else [float(i), 1.0]) for i in range(600)]
    data = spark.createDataFrame(rows, "id long, embedding array<float>")
    ix = VI.build(data, str(tmp_path / "ix"), dim=2, n_cells=4)
    hits = VI.search(ix, spark.createDataFrame([(1, [1.0, 0.0])], "qid long, embedding array<float>"), 20, block_rows=16)
    assert [r["id"] for r in hits.orderBy("rank").collect()] == list(range(20))
    assert VI.search(ix, spark.createDataFrame([(1, [700.0, 0.0])], "qid long, embedding array<float>"), 1_000, nprobe=1).count() == 600


def test_only_probed_cells_are_read(index, vectors):
    txt = plan_text(VI.search(index, _asked(vectors, 1_000), 3, nprobe=1))
    assert "dynamicpruning" in txt.lower() and "CartesianProduct" not in txt and "NestedLoopJoin" not in txt


def test_unusable_rows_and_empty_tables(spark, tmp_path):
    schema = "id long, embedding array<float>"
    rows = [(1, [0.0, 1.0]), (2, None), (3, [1.0]), (4, [1.0, None]), (None, [1.0, 1.0]), (5, [3.0, 1.0])]
    ix = VI.build(spark.createDataFrame(rows, schema), str(tmp_path / "a"), dim=2)
    asked = spark.createDataFrame([(9, [0.0, 0.0]), (8, None), (7, [1.0])], "qid long, embedding array<float>")
    assert [(r["qid"], r["id"]) for r in VI.search(ix, asked, 5, nprobe=2).orderBy("rank").collect()] == [(9, 1), (9, 5)]
    empty = VI.build(spark.createDataFrame([], schema), str(tmp_path / "b"), dim=2)
    assert VI.search(empty, asked, 5).count() == 0
    later = VI.add(empty, spark.createDataFrame(rows, schema))
    assert VI.search(later, asked, 5).count() == 2
