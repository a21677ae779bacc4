"""The token writer holds few texts of an Arrow batch as Python strings at a time."""

import tracemalloc

import pyarrow as pa

from quarry.llm import token_store


def test_texts_of_a_batch_come_in_slices():
    column = pa.array([f"{i} ☃" + "x" * 2_000 for i in range(5_000)] + [None])
    tracemalloc.start()
    n = sum(len(t) for t in token_store._texts(column))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == sum(len(t or "") for t in column.to_pylist())
    assert peak < 4 * token_store.ROWS * 2 * 2_100
