"""End-to-end load and search compositions."""

import datetime as dt

from pyspark.sql import functions as F

from quarry.operators import sync as SY
from quarry.operators.load import load_documents, search_context

T = dt.datetime(2024, 1, 1, 12, 0)
STATE = ("id long, repository string, context string, filepath string, description string, "
         "updated_at timestamp_ntz, embedding array<float>")
FILES = "repository string, context string, filepath string, content string, modified_at timestamp_ntz"


def test_load_then_search(spark):
    state = spark.createDataFrame([(1, "r", "c", "old.go", "d", T, [0.0] * 64),
                                   (2, "r", "c", "same.go", "d", T, [0.0] * 64)], STATE)
    files = spark.createDataFrame([("r", "c", "same.go", "func same() {}", T - dt.timedelta(hours=1)),
                                   ("r", "c", "new.go", "alpha beta gamma\nsecond line", T),
                                   ("r", "c", "other.go", "zeta eta", T),
                                   ("r", "c", "silent.go", "zeta eta theta", T),
                                   ("r", "c", "bad.go", "boom", T)], FILES)

    def summarize(text):
        if text == "zeta eta theta":
            return ""
        if text == "boom":
            raise ValueError("model error")
        return f"{len(text.split())} words"

    nxt, errors = load_documents(state, files, summarize=summarize)
    got = {r.filepath: r for r in nxt.collect()}
    # old.go pruned, bad.go failed, silent.go has no summary
    assert set(got) == {"same.go", "new.go", "other.go"}
    assert got["same.go"].id == 2 and got["same.go"].description == "d"  # fresh: untouched
    assert got["new.go"].description == "5 words" and got["new.go"].id in (3, 4)
    assert len(got["new.go"].embedding) == 64
    assert [r.filepath for r in errors.collect()] == ["bad.go"]
    # the next load finds the stored files fresh
    again = {r.filepath: r["class"] for r in SY.classify(nxt, files).collect()}
    assert again == {"same.go": "fresh", "new.go": "fresh", "other.go": "fresh", "bad.go": "insert", "silent.go": "insert"}

    ctx = search_context(spark, nxt.filter(F.col("description") != "d"), files, "5 words",
                         repository="r", context="c", k=2).first()
    assert ctx.n_hits == 2
    assert ctx.text.startswith("File: new.go\nalpha beta gamma")
