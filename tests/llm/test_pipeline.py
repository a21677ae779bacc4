"""The pipeline against plain Python on a small corpus, and the registered queries."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from quarry.llm import decontaminate, mixing, quality
from tests.llm.conftest import SCHEMA, corpus, prose
from tests.llm.test_operators import brute_components


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("corpus")
    rows = corpus()
    for i in range(100, 220):
        text = prose(i, 80)
        rows.append((i, " ".join(w.upper() + "!!" for w in text.split()) if i % 5 == 0 else text, "en", f"src{i % 4}", len(text)))
    spark.createDataFrame(rows, SCHEMA).repartition(2).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(100, 220)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    item = " ".join(prose(101, 80).split()[10:30])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), rows, [("1", item)]


def test_pipeline(spark, folder):
    d, rows, items = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    good = {r["doc_id"] for r in quality.report(docs, spark.read.parquet(f"{d}/labels.parquet")).collect() if r["predicted"] == 1}
    assert not {i for i in range(100, 220, 5)} & good and len([i for i in good if i >= 100]) >= 94
    left = {i: t for i, t, *_ in rows if i in good}
    label = brute_components(left.items())
    left = {i: t for i, t in left.items() if label[i][1] == i}
    find = decontaminate.automaton(items)
    left = {i: t for i, t in left.items() if not decontaminate.scan(t, find)[2]}
    assert 101 not in left
    kept = spark.createDataFrame([r for r in rows if r[0] in left], SCHEMA)
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(kept).collect()}
    plain, start, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for i in sorted(left):
        ids = np.array(plain.encode(left[i] or "", add_special_tokens=False).ids + [1], dtype="<u4")
        for _ in range(copies[i]):
            want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
    assert sorted(map(tuple, corpus_pipeline.run(spark, d).collect())) == want


def test_stages_keep_the_columns(spark, folder):
    d = folder[0]
    docs = spark.read.parquet(f"{d}/documents.parquet").cache()
    assert [n for n, _ in corpus_pipeline.STAGES][-1] == "token output" and len(corpus_pipeline.STAGES) == 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, d).columns == docs.columns


def test_every_operator_is_registered():
    import __spark_entry__ as entry

    names = Counter(n.split("_")[0] for n in entry.queries() if n.startswith("op"))
    assert names == Counter(f"op{i}" for i in range(1, 14)) and "pipeline" in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())
