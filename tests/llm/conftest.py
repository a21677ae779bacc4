from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int, syllables=("ka", "to", "mi", "re", "sun", "el", "dor", "an")) -> str:
    r = random.Random(seed)
    words = ["".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(n)]
    return " ".join(w + ("." if i % 9 == 8 else "") + ("\n" if i % 27 == 26 else "") for i, w in enumerate(words))


def corpus() -> list[tuple]:
    """Copies, near copies, shared passages, nulls, empty, very short and long texts."""
    base, passage = prose(1, 400), prose(2, 90)
    edited = base.split(" ")
    edited[200] = "changed"
    texts = [base, base, " ".join(edited), base.upper(), prose(3, 300) + " " + passage, passage + " " + prose(4, 30), prose(5, 50) + passage + prose(6, 50),
             None, "", " \n\t", "one", "one two three", "one  two\nthree", "a b c d e", prose(7, 20_000), "Orre " * 900, "É ß 日本 " * 60, base + "\n", prose(8, 19), prose(8, 20)]
    return [(i, t, "en", f"src{i % 3}" if i % 7 else None, None if t is None else len(t)) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Null and repeated ids, repeated rows, and columns whose names the operators use themselves."""
    base = prose(1, 200)
    rows = [(1, base, "a"), (1, base, "a"), (1, prose(9, 120), "b"), (None, base, "c"), (None, None, "d"), (2, base + " x", "e"), (3, "", None)]
    cols = ["doc_id", "text", "source"]
    frame = spark.createDataFrame([(*r, i, "z", 7, True) for i, r in enumerate(rows)], "doc_id long, text string, source string, rid int, key string, n int, kept boolean")
    assert frame.columns[:3] == cols
    return frame
