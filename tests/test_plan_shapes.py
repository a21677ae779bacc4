"""Physical-plan properties the design relies on (plans only, nothing executed)."""

import re

from pyspark.sql import functions as F

from quarry.plans.inspect import plan_text
from quarry.sources import corpus as C

SF = "/root/testdata/sf0.001"


def _exchange_inputs(txt: str) -> list[str]:
    """The Input line of every Exchange node of a formatted plan."""
    out = []
    for block in re.split(r"\n\n", txt):
        if re.match(r"\(\d+\) Exchange", block.strip()):
            m = re.search(r"Input \[\d+\]: \[(.*)\]", block)
            out.append(m.group(1) if m else "")
    return out


def test_classify_shuffles_no_file_text(spark):
    from quarry.operators import sync as SY
    cls = SY.classify(C.doc_state(spark, SF), C.doc_incoming(spark, SF), keep_content=False)
    ins = _exchange_inputs(plan_text(cls))
    assert ins and not any(re.search(r"\b(text|content|description)#", x) for x in ins), ins


def test_hash_embed_single_shuffle_when_spread(spark):
    from quarry.operators.enrich import hash_embed
    from quarry.sources.tables import read_table
    docs = read_table(spark, SF, "documents", "doc_id", "text")  # one row group -> one partition
    txt = plan_text(hash_embed(docs, id_col="doc_id"))
    assert len(_exchange_inputs(txt)) == 1, txt


def test_rule_table_and_unscoped_knn_have_no_nested_loops(spark):
    from quarry.operators import tree as T
    from quarry.operators import vectors as V
    rules = spark.createDataFrame([("exclude", "a"), ("include", "ab")], "kind string, prefix string")
    assert "NestedLoopJoin" not in plan_text(T.apply_rule_table(C.site_files(spark, SF), rules))
    v = C.vectors(spark, SF)
    q = v.select(F.col("id").alias("qid"), "embedding")
    for strategy in ("blocks", "broadcast"):
        txt = plan_text(V.knn_join(q, v, 5, metric="cosine", exclude_self=True, strategy=strategy))
        assert "NestedLoopJoin" not in txt and "CartesianProduct" not in txt


def test_scoped_search_is_scan_plus_top_k(spark):
    from quarry.plans.cases.vectors import flagship
    txt = plan_text(flagship(spark, SF))
    assert len(_exchange_inputs(txt)) == 0  # no shuffle at all: per-task top-k, merged on the driver
