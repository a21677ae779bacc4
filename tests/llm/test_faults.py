"""Odd rows, clashing names, repeatable samples and long texts of the corpus operators."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import common, decontaminate, exact_dedup, jaccard_join, labelled, line_dedup, mixing, quality, toxicity
from tests.llm.conftest import prose

CLEAN = "the river ran past the old mill and on into town"
FOUL = "you utter wretchword go away"


def test_exact_dedup_keeps_texts_that_share_an_id(spark):
    rows = [(1, "alpha", "x"), (1, "beta", "y"), (2, "alpha", "z"), (3, "be ta", "w"), (1, "beta", "v"), (None, None, "n"), (None, "", "m")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    left = exact_dedup.dedup(docs)
    assert left.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in left.collect() if r["text"]) == [(1, "alpha"), (3, "be ta")]
    assert left.filter("doc_id IS NULL").count() == 1
    twice = spark.createDataFrame([(1, "a b", "x"), (1, "ab", "y"), (1, "a b", "z")], docs.schema)
    assert [r["text"] for r in exact_dedup.dedup(twice).collect()] == ["a b"]


def test_line_dedup_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc", 99, "k"), (2, "a\nb\nc\nd", 98, "l")], "doc_id long, text string, n_lines int, n_removed string")
    got = line_dedup.clean(docs)
    assert got.columns == [*docs.columns, "n_lines_before", "n_lines_removed"]
    assert [tuple(r) for r in got.orderBy("doc_id").collect()] == [(1, "a\nb\nc", 99, "k", 3, 0), (2, "d", 98, "l", 4, 3)]
    assert line_dedup.clean(got).columns[-2:] == ["n_lines_before_", "n_lines_removed_"]


def test_line_dedup_of_very_long_texts(spark):
    block = "\n".join(f"line {i}" for i in range(20_000))
    docs = spark.createDataFrame([(1, block), (2, "first\n" + block)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"]) for r in line_dedup.report(docs).collect()}
    assert got == {1: (20_000, 0), 2: (20_001, 20_000)}


def test_sample_is_the_same_for_any_order(spark):
    rows = [(i % 40, f"text {i} " * (i % 7 + 1)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    take = lambda d: labelled.sample(d, labels, "quality", held_out_mod=(3, 1))
    assert take(docs) == take(docs.repartition(7).orderBy(F.rand(3))) and len(take(docs)) <= 40
    short = labelled.sample(docs, labels, "quality", held_out_mod=(3, 1), total_chars=100)
    assert short and all(sum(len(t) for t, y in short if y == k) <= 100 for k in (0, 1))


@pytest.fixture(scope="module")
def foul_model():
    rows = [(". ".join([f"{CLEAN} {prose(i, 4)}"] * (i % 9 + 1)), 0) for i in range(300)]
    rows += [(f"{CLEAN}. {FOUL} {prose(i, 3)}. {CLEAN}", 1) for i in range(300, 400)]
    return toxicity.train(rows)


@pytest.mark.parametrize("n", [1, 10, 1_000, 20_000])
def test_long_clean_texts_are_not_toxic(foul_model, n):
    text = ". ".join([CLEAN] * n)
    assert toxicity.noisy_or(foul_model, toxicity.sentence_scores(foul_model, text)) < 0.3
    bad = text + ". " + FOUL
    p = toxicity.sentence_scores(foul_model, bad)
    assert toxicity.noisy_or(foul_model, p) >= 0.5 and p.argmax() == len(p) - 1


def plain_toxicity(model, text) -> float:
    """Word by word, without any table of words."""
    if model.known is not None:
        return model.known
    logistic = lambda z: 1 / (1 + np.exp(-z))
    left = 1 - toxicity.LEAK
    for sentence in toxicity.bag(text or ""):
        z = model.bias + sum(model.weights.get(f, 0.0) for f in {f for w in sentence for f in toxicity.features(w)})
        left *= min(1.0, (1 - logistic(z)) / (1 - logistic(model.bias)))
    return 1 - left


def test_toxicity_scores_equal_plain_ones(spark, foul_model):
    texts = [None, "", " \n", CLEAN, FOUL, f"{CLEAN}. {FOUL}! {FOUL}?", "É ß 日本. WRETCHWORD", "." * 50, f"{CLEAN}. " * 3_000 + FOUL]
    docs = spark.createDataFrame([(i, t, 5, "z") for i, t in enumerate(texts)] * 2 + [(None, FOUL, 5, "z")], "doc_id long, text string, score int, held_out string")
    rows = toxicity.score(docs, foul_model).collect()
    assert len(rows) == 2 * len(texts) + 1
    for r in rows:
        want = plain_toxicity(foul_model, FOUL if r["doc_id"] is None else texts[r["doc_id"]])
        assert abs(r["score"] - want) < 1e-9 and 0 <= r["score"] <= 1


def test_quality_scores_equal_plain_ones(spark):
    good = [prose(i, 60) for i in range(60)]
    bad = [" ".join(w.upper() + "!!" for w in prose(i, 60).split()) for i in range(60, 120)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)] + [(500, None), (501, ""), (None, good[0]), (502, prose(9, 60_000))], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(120)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    scorer = quality.Scorer(model.good, model.bad)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in quality.report(docs, labels).collect():
        z = float(np.dot(scorer.features(text[r["doc_id"]]), model.weights[:2]) + model.weights[2])
        assert abs(r["score"] - 1 / (1 + np.exp(-np.clip(z, -35, 35)))) < 1e-12 and r["predicted"] == int(r["score"] >= 0.5)


def test_remove_with_several_automata(spark, odd):
    items = [(None, prose(1, 200)), (5, prose(9, 120)), (6, "x")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    many = decontaminate.remove(odd, bench, max_item_chars=1)
    assert sorted(map(repr, many.collect())) == sorted(map(repr, decontaminate.remove(odd, bench).collect())) and many.columns == odd.columns
    assert sorted(r["text"] or "" for r in many.collect()) == ["", ""]
    plan = many._jdf.queryExecution().toString()
    assert plan.count("ArrowEvalPython") <= 2 * 3  # one pass in each form of the plan, not one for each automaton


def test_stages_on_empty_and_odd_tables(spark, odd, nothing, tmp_path):
    """Filtering stages keep the columns, null and repeated rows have a defined result."""
    bench = spark.createDataFrame([(1, "no such words anywhere in these texts at all I think")], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for stage in (lambda d: quality.keep_good(d, labels), jaccard_join.keep_one, lambda d: decontaminate.remove(d, bench), mixing.take):
        assert stage(nothing).count() == 0 and stage(nothing).columns == nothing.columns
        assert stage(odd).columns == odd.columns
    assert quality.keep_good(odd, labels).count() == decontaminate.remove(odd, bench).count() == odd.count()


def test_only_forgets_what_others_remember():
    kept, gone = [1], [2]
    common.remembers("test kept", kept.clear)
    common.remembers("test gone", gone.clear)
    try:
        common.only("test kept")
        assert kept == [1] and gone == []
    finally:
        for k in ("test kept", "test gone"):
            common._REMEMBERED.pop(k)
