"""The bucketed documents table fed by micro-batches."""

import datetime as dt
import glob
import os
import random

from pyspark.sql import functions as F

from quarry.streaming import documents as SD

T0 = dt.datetime(2024, 1, 1)


def _rows(seed: int, n: int):
    r = random.Random(seed)
    return [("repo", f"c{r.randrange(3)}", f"src/{r.randrange(40)}.txt", r.choice(["", "a\nb", f"text {i}\n" * r.randint(1, 4)]), T0 + dt.timedelta(minutes=r.randrange(50)))
            for i in range(n)]


def _expected(rows):
    import hashlib
    best = {}
    for repo, ctx, path, text, at in rows:
        if text:
            key, rank = (repo, ctx, path), (at, hashlib.md5(text.encode()).hexdigest())
            if key not in best or rank > best[key][0]:
                best[key] = (rank, f"summary of {path}: {text.count(chr(10)) + 1} lines")
    return {k: (rank[0], description) for k, (rank, description) in best.items()}


def _got(state):
    rows = state.collect()
    assert len({r["id"] for r in rows}) == len(rows) == len({(r["repository"], r["context"], r["filepath"]) for r in rows})
    return {(r["repository"], r["context"], r["filepath"]): (r["updated_at"], r["description"]) for r in rows}


def _files(root, bucket=None):
    return {(p, os.stat(p).st_mtime_ns) for p in glob.glob(f"{root}/data/batch=*/bucket={'*' if bucket is None else bucket}/*.parquet")}


def test_batches_in_any_order_and_replayed(spark, tmp_path):
    rows = _rows(1, 300)
    parts = [rows[i::3] for i in range(3)]
    want = _expected(rows)
    ids = {}
    for name, order in (("a", [0, 1, 2]), ("b", [2, 0, 1])):
        root = str(tmp_path / name)
        for batch_id, p in enumerate(order):
            SD.apply_batch(spark, root, spark.createDataFrame(parts[p], SD.FILE), batch_id, n_buckets=8)
            if batch_id == 1:  # the driver fails after the batch and repeats it
                before = _got(SD.read_state(spark, root))
                SD.apply_batch(spark, root, spark.createDataFrame(parts[p], SD.FILE), batch_id, n_buckets=8)
                assert _got(SD.read_state(spark, root)) == before
        assert _got(SD.read_state(spark, root)) == want
        ids[name] = {r["id"] for r in SD.read_state(spark, root).select("id").collect()}
    assert ids["a"] == ids["b"] == set(range(1, len(want) + 1))


def test_other_buckets_are_not_written(spark, tmp_path):
    root = str(tmp_path)
    SD.apply_batch(spark, root, spark.createDataFrame(_rows(2, 300), SD.FILE), 0, n_buckets=8)
    files = _files(root)
    later = spark.createDataFrame([("repo", "c0", "src/1.txt", "new\ntext", T0 + dt.timedelta(days=9)), ("repo", "c1", "src/2.txt", "older", T0 - dt.timedelta(days=9))], SD.FILE)
    touched = SD.apply_batch(spark, root, later, 1, n_buckets=8)
    # the older version changes nothing; the new one rewrites its own bucket
    mine = later.filter(F.col("context") == "c0").select(SD.bucket_of(8)).first()[0]
    assert touched == [mine]
    assert files <= _files(root) and {p.split("bucket=")[1].split("/")[0] for p, _ in _files(root) - files} == {str(mine)}
    assert _got(SD.read_state(spark, root))["repo", "c0", "src/1.txt"] == (T0 + dt.timedelta(days=9), "summary of src/1.txt: 2 lines")
    assert SD.apply_batch(spark, root, spark.createDataFrame([], SD.FILE), 2, n_buckets=8) == []
    assert len(SD.manifest(spark, root)) == len(SD.manifest(spark, root, before=2)) == 8


def test_a_batch_reads_the_touched_buckets_only(spark, tmp_path):
    root = str(tmp_path)
    SD.apply_batch(spark, root, spark.createDataFrame(_rows(3, 300), SD.FILE), 0, n_buckets=8)
    listed = SD.manifest(spark, root)
    some = SD._buckets(spark, root, listed[:2])
    assert {f.split("bucket=")[1].split("/")[0] for f in some.inputFiles()} == {str(r["bucket"]) for r in listed[:2]}


def test_summaries_and_failures(spark, tmp_path):
    def summarize(text):
        if "bad" in text:
            raise ValueError("no")
        return text.upper()

    files = [("r", "c", "a", "one", T0), ("r", "c", "b", "bad", T0), ("r", "c", "d", None, T0)]
    SD.apply_batch(spark, str(tmp_path), spark.createDataFrame(files, SD.FILE), 0, n_buckets=4, summarize=summarize)
    assert _got(SD.read_state(spark, str(tmp_path))) == {("r", "c", "a"): (T0, "ONE")}


def test_stream_restarts_where_it_stopped(spark, tmp_path):
    rows = _rows(4, 200)
    src, root, ck = (str(tmp_path / x) for x in ("in", "state", "ck"))
    spark.createDataFrame(rows[:100], SD.FILE).repartition(3).write.parquet(src)
    SD.continuous_load(spark, src, root=root, checkpoint=ck, n_buckets=8)
    spark.createDataFrame(rows[100:], SD.FILE).repartition(2).write.mode("append").parquet(src)
    state = SD.continuous_load(spark, src, root=root, checkpoint=ck, n_buckets=8, max_files_per_trigger=2)
    assert _got(state) == _expected(rows)
