"""Sync and mutation invariants."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quarry.operators import sync as SY
from quarry.sources import corpus as C

SF = "/root/testdata/sf0.001"
T = dt.datetime(2024, 1, 1, 12, 0)


def _state(spark, rows):
    return spark.createDataFrame(rows, "id long, repository string, context string, filepath string, "
                                       "description string, updated_at timestamp_ntz")


def _inc(spark, rows):
    return spark.createDataFrame(rows, "repository string, context string, filepath string, content string, "
                                       "modified_at timestamp_ntz")


def test_classes(spark):
    st = _state(spark, [(1, "r", "c", "fresh.go", "d", T), (2, "r", "c", "eq.go", "d", T),
                        (3, "r", "c", "gone.go", "d", T), (4, "r", "other", "x.go", "d", T),
                        (5, "r", "c", "empty.go", "d", T - dt.timedelta(hours=1))])
    inc = _inc(spark, [("r", "c", "fresh.go", "x", T - dt.timedelta(minutes=1)), ("r", "c", "eq.go", "x", T),
                       ("r", "c", "new.go", "x", T), ("r", "c", "blank.go", "", T), ("r", "c", "empty.go", "", T)])
    got = {r.filepath: r["class"] for r in SY.classify(st, inc).collect()}
    assert got == {"fresh.go": "fresh", "eq.go": "update", "gone.go": "prune", "x.go": "keep",
                   "new.go": "insert", "blank.go": "skip", "empty.go": "skip"}


def test_prune_only_loaded_scopes(spark):
    st = _state(spark, [(1, "r", "c", "a", "d", T), (2, "r", "c", "b", "d", T), (3, "r", "z", "a", "d", T)])
    inc = _inc(spark, [("r", "c", "a", "x", T)])
    assert sorted(r.id for r in SY.prune(st, inc).collect()) == [1, 3]


def test_upsert_latest_wins_and_dense_ids(spark):
    st = _state(spark, [(7, "r", "c", "a", "old", T)])
    ch = spark.createDataFrame([("r", "c", "a", "v1", T), ("r", "c", "a", "v2", T + dt.timedelta(minutes=1)),
                                ("r", "c", "b", "nb", T), ("r", "c", "c", "nc", T)],
                               "repository string, context string, filepath string, description string, "
                               "updated_at timestamp_ntz")
    got = {r.filepath: (r.id, r.description) for r in SY.upsert(st, ch).collect()}
    assert got["a"] == (7, "v2")
    assert sorted(v[0] for k, v in got.items() if k != "a") == [8, 9]
    ign = {r.filepath: r.description for r in SY.upsert(st, ch, on_conflict="ignore").collect()}
    assert ign["a"] == "old" and set(ign) == {"a", "b", "c"}


def test_sync_twice_changes_nothing(spark):
    st, inc = C.doc_state(spark, SF), C.doc_incoming(spark, SF)
    from quarry.plans.cases.sync import _changes
    once = SY.upsert(st, _changes(spark, SF))
    again = SY.upsert(once, SY.classify(once, inc).filter(F.col("class").isin("insert", "update")).select(
        *SY.KEY, F.lit("x").alias("description"), F.col("modified_at").alias("updated_at")))
    # after one sync every row is fresh or equal-time: nothing left to insert
    assert once.join(inc, SY.KEY, "left_anti").count() + inc.count() >= once.count() - st.count()
    assert SY.classify(once, inc).filter(F.col("class") == "insert").count() == 0
    assert again.count() == once.count()


def test_classes_partition_the_keys(spark):
    st, inc = C.doc_state(spark, SF), C.doc_incoming(spark, SF)
    cls = SY.classify(st, inc)
    keys = st.select(*SY.KEY).union(inc.select(*SY.KEY)).distinct().count()
    assert cls.count() == keys == cls.select(*SY.KEY).distinct().count()


def test_insert_checked_rejects_conflicts(spark):
    st = _state(spark, [(1, "r", "c", "a", "d", T)])
    ch = spark.createDataFrame([("r", "c", "a", "dup", T), ("r", "c", "b", "", T), ("r", "c", "c", "ok", T)],
                               "repository string, context string, filepath string, description string, "
                               "updated_at timestamp_ntz")
    nxt, rej = SY.insert_checked(st, ch, required=["description"])
    assert {r.filepath: r.reason for r in rej.collect()} == {"a": "unique key violation", "b": "missing required field"}
    assert {r.filepath: r.id for r in nxt.collect()} == {"a": 1, "c": 2}


def test_insert_checked_null_beside_valid(spark):
    ch = spark.createDataFrame([("r", "c", "k", None, T), ("r", "c", "k", "ok", T)],
                               "repository string, context string, filepath string, description string, "
                               "updated_at timestamp_ntz")
    nxt, rej = SY.insert_checked(_state(spark, [(1, "r", "c", "a", "d", T)]), ch, required=["description"])
    assert {r.filepath: r.description for r in nxt.collect()} == {"a": "d", "k": "ok"}
    assert [r.reason for r in rej.collect()] == ["missing required field"]


def test_update_where_sees_the_original_row(spark):
    st = _state(spark, [(1, "r", "c", "a", "d", T), (2, "r", "c", "b", "e", T)])
    later = T + dt.timedelta(days=1)
    out = SY.update_where(st, F.col("description") == "d", {"description": F.lit("x"), "updated_at": F.lit(later)})
    assert {r.id: (r.description, r.updated_at) for r in out.collect()} == {1: ("x", later), 2: ("e", T)}


def test_upsert_exchanges(spark):
    """One full outer join: the payload of either side is shuffled once."""
    from quarry.plans.cases.sync import upsert_new_values
    from quarry.plans.inspect import plan_text
    plan = plan_text(upsert_new_values(spark, SF))
    assert plan.count("FullOuter") >= 1 and "Union" not in plan


def test_only_contract(spark):
    from quarry.operators.query import NotFoundError, NotSingularError, only
    st = C.doc_state(spark, SF)
    with pytest.raises(NotFoundError):
        only(st.filter("filepath = 'nope'"))
    with pytest.raises(NotSingularError):
        only(st)


def test_stream_equals_batch(spark):
    from quarry.plans.cases.sync import stream_sync
    from quarry.sources.tables import read_table
    got = {r.source: r.doc_id for r in stream_sync(spark, SF).collect()}
    docs = read_table(spark, SF, "documents", "source", "doc_id")
    exp = {r.source: r.m for r in docs.groupBy("source").agg(F.max("doc_id").alias("m")).collect()}
    assert got == exp


def test_stream_files_share_a_hot_language(spark, tmp_path, monkeypatch):
    from quarry.streaming import sync
    spark.range(1000).selectExpr("concat('s', id % 5) AS source", "id AS doc_id", "'en' AS lang", "id AS n_chars") \
        .write.parquet(str(tmp_path / "documents.parquet"))
    seen, real = [], sync.continuous_upsert
    monkeypatch.setattr(sync, "continuous_upsert", lambda *a, **k: (seen.append(a[1]), real(*a, **k))[1])
    got = sorted((r.source, r.doc_id) for r in sync.stream_latest_per_key_from_table(spark, str(tmp_path)).collect())
    assert got == [(f"s{i}", 995 + i) for i in range(5)]
    sizes = [r["count"] for r in spark.read.parquet(seen[0]).groupBy("_metadata.file_path").count().collect()]
    assert sum(sizes) == 1000 and max(sizes) <= 500


def test_enrich_reports_errors_per_row(spark):
    from quarry.operators.enrich import enrich_batch, split_errors
    from quarry.plans.cases.sync import word_summary
    df = spark.createDataFrame([("a b c",), ("",)], "content string")
    ok, bad = split_errors(enrich_batch(df, word_summary, input_col="content", output_col="summary"))
    assert [r.summary for r in ok.collect()] == ["3 words, 1 lines"]
    assert bad.first().error.startswith("ValueError")


def test_enrich_query_covers_every_document(spark):
    from quarry.plans.cases.sync import enrich_batch, word_summary
    from quarry.sources.tables import read_table

    def told(text):
        try:
            return word_summary(text), None
        except ValueError as e:
            return None, f"ValueError: {e}"

    docs = read_table(spark, SF, "documents", "doc_id", "text", "lang", "source").collect()
    exp = [(f"repo{r.doc_id % 2}", r.lang, f"{r.source}/{r.doc_id}.txt", *told(r.text)) for r in docs]
    assert sorted(map(repr, map(tuple, enrich_batch(spark, SF).collect()))) == sorted(map(repr, exp))


def test_stream_restart_is_idempotent(spark):
    import uuid

    from quarry.session import scratch_path
    from quarry.sources.tables import read_table
    from quarry.streaming.sync import STREAM_SCHEMA, continuous_upsert
    run = scratch_path(spark, f"stream-test-{uuid.uuid4().hex}")
    read_table(spark, SF, "documents", "source", "doc_id", "lang", "n_chars").repartition(3, "lang") \
        .write.parquet(f"{run}/incoming")
    args = dict(key=["source"], order_cols=["doc_id"], state_root=f"{run}/state", checkpoint=f"{run}/ckpt")
    first = continuous_upsert(spark, f"{run}/incoming", STREAM_SCHEMA, **args)
    again = continuous_upsert(spark, f"{run}/incoming", STREAM_SCHEMA, **args)  # restart: nothing new
    assert first == again
    got = {r.source: r.doc_id for r in spark.read.schema(STREAM_SCHEMA).parquet(again).collect()}
    exp = {r.source: r.m for r in read_table(spark, SF, "documents", "source", "doc_id")
           .groupBy("source").agg(F.max("doc_id").alias("m")).collect()}
    assert got == exp
