"""An inverted-file index over vectors (D5): built once, kept in a folder, searched many times.

* ``build``: k-means cells (fitted on a bounded sample), every row assigned to its nearest
  cell and written as a table partitioned by cell.  How many cells a search must probe is
  measured at build time: the true neighbours of a bounded set of calibration rows are found by
  one exact scan, and ``nprobe`` is the least number of nearest cells that holds
  ``target_recall`` of them.
* ``open_index`` / ``search``: each query goes to its ``nprobe`` nearest cells (more while those
  hold fewer than k rows), only the folders of probed cells are read (dynamic partition pruning), and
  the rows of a cell are scored exactly, block against block, so that a cell holding a third of all
  rows is many groups.  The scores are those of ``knn_join``; with ``nprobe`` = all cells the result
  is the exact one.
* ``add``: further rows go to the same cells as new files; nothing is rewritten.

Files of an index folder: ``vectors/cell=N/*.parquet`` (id, vec and the ``keep`` columns),
``centroids`` (cell, centroid), ``sizes`` (cell, n: one file for each build or add) and
``facts`` (dim, nprobe, calibrated_recall, schema of the vectors).
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.vectors import dimension_ok
from quarry.operators.vectors import _block_kernel, knn_join

#: Most cells; together with MAX_CENTROID_BYTES this bounds what is broadcast.
MAX_CELLS, MAX_CENTROID_BYTES = 16_384, 64 << 20
#: Rows that the cells are fitted on, and rows whose true neighbours calibrate ``nprobe``.
SAMPLE_ROWS, CALIBRATION_ROWS = 50_000, 200
#: Rows of one file of a cell.
FILE_ROWS = 500_000


@dataclass(frozen=True)
class Index:
    """An opened index: its folder and the small tables of it that were read."""

    spark: SparkSession
    path: str
    dim: int
    nprobe: int
    cells: np.ndarray  # numbers of the cells, ascending
    centroids: np.ndarray  # one row a cell
    sizes: np.ndarray  # rows of each cell
    schema: T.StructType

    @property
    def vectors(self) -> DataFrame:
        if not self.sizes.sum():
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/vectors")


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows of x to rows of c."""
    x, c = x.astype(np.float64), c.astype(np.float64)
    return (x * x).sum(1)[:, None] - 2.0 * (x @ c.T) + (c * c).sum(1)[None, :]


def _assigned(rows: DataFrame, centroids: np.ndarray, cells: np.ndarray) -> DataFrame:
    """``rows`` with the number of the cell nearest to ``vec``."""
    sent = rows.sparkSession.sparkContext.broadcast((centroids, cells))

    @F.pandas_udf("int")
    def nearest(vec: pd.Series) -> pd.Series:
        c, numbers = sent.value
        out = np.empty(len(vec), np.int32)
        for lo in range(0, len(vec), 1024):
            out[lo : lo + 1024] = numbers[_distances(np.stack(vec.iloc[lo : lo + 1024].to_numpy()), c).argmin(1)]
        return pd.Series(out)

    return rows.withColumn("cell", nearest("vec"))


def _fitted(sample: DataFrame, n_cells: int, seed: int) -> np.ndarray:
    """Centres of MLlib k-means over the sample."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = sample.select(array_to_vector(F.col("vec").cast("array<double>")).alias("features")).cache()
    try:
        model = KMeans(k=n_cells, maxIter=10, seed=seed, initMode="k-means||", initSteps=2).fit(data)
        return np.array(model.clusterCenters(), dtype=np.float32)
    finally:
        data.unpersist()


def _write_vectors(rows: DataFrame, path: str) -> None:
    """Cells as folders; a cell of many rows is dealt over several files by id."""
    sizes = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(FILE_ROWS)).cast("int").alias("_q_files"))
    dealt = rows.join(F.broadcast(sizes), "cell")  # at most MAX_CELLS rows
    dealt = dealt.withColumn("_q_file", F.pmod(F.xxhash64("id"), F.col("_q_files")).cast("int")).drop("_q_files")
    dealt.repartition("cell", "_q_file").drop("_q_file").write.mode("append").partitionBy("cell").parquet(f"{path}/vectors")


def _usable(rows: DataFrame, dim: int, id_col: str, vector_col: str, keep: Sequence[str]) -> DataFrame:
    ok = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & dimension_ok(F.col(vector_col), dim)
    return rows.filter(ok).select(F.col(id_col).cast("long").alias("id"), *keep, F.col(vector_col).cast("array<float>").alias("vec"))


def build(
    rows: DataFrame,
    path: str,
    *,
    dim: int,
    id_col: str = "id",
    vector_col: str = "embedding",
    keep: Sequence[str] = (),
    n_cells: int | None = None,
    target_recall: float = 0.95,
    k: int = 10,
    sample_rows: int = SAMPLE_ROWS,
    calibration_rows: int = CALIBRATION_ROWS,
    seed: int = 17,
) -> Index:
    """Index every usable row of ``rows`` (id and a vector of ``dim`` non-null elements) in the new
    folder ``path``.  ``n_cells`` is by default the square root of the row count, within the bounds above."""
    spark = rows.sparkSession
    data = _usable(rows, dim, id_col, vector_col, keep)
    n = data.count()
    most = max(1, min(MAX_CELLS, MAX_CENTROID_BYTES // (4 * dim)))
    n_cells = min(most, n_cells or max(1, int(np.ceil(np.sqrt(n)))))
    h = F.xxhash64("id", F.lit(seed))
    sample = data.select("vec", "id", h.alias("_q_h")).orderBy("_q_h", "id").limit(max(sample_rows, n_cells)).select("vec")
    centroids = _fitted(sample, n_cells, seed) if n > 1 else np.zeros((1, dim), np.float32)
    cells = np.arange(len(centroids), dtype=np.int32)
    assigned = _assigned(data, centroids, cells)
    _write_vectors(assigned, path)
    _sizes(spark, path, spark.read.parquet(f"{path}/vectors") if n else None)
    spark.createDataFrame([(int(c), v.tolist()) for c, v in zip(cells, centroids)], "cell int, centroid array<float>").coalesce(1).write.parquet(f"{path}/centroids")
    nprobe, recall = _calibrated(spark, path, centroids, cells, k, target_recall, calibration_rows, seed) if n else (1, 1.0)
    facts = [(dim, nprobe, recall, T.StructType([f for f in assigned.schema.fields if f.name != "cell"] + [T.StructField("cell", T.IntegerType())]).json())]
    spark.createDataFrame(facts, "dim int, nprobe int, calibrated_recall double, schema string").coalesce(1).write.parquet(f"{path}/facts")
    return open_index(spark, path)


def _sizes(spark: SparkSession, path: str, written: DataFrame | None) -> None:
    counted = spark.createDataFrame([], "cell int, n long") if written is None else written.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    counted.coalesce(1).write.mode("append").parquet(f"{path}/sizes")


def _calibrated(spark, path, centroids, cells, k, target, calibration_rows, seed) -> tuple[int, float]:
    """(nprobe, the recall it had): the place of each true neighbour's cell in its query's order of cells."""
    vectors = spark.read.parquet(f"{path}/vectors").select("id", "vec", "cell")
    asked = vectors.orderBy(F.xxhash64("id", F.lit(seed + 1)), "id").limit(calibration_rows).select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    # calibration_rows queries of at most 64 MB: the corpus is scanned in place
    hits = knn_join(asked, vectors, k, strategy="broadcast", query_vec_col="qvec", vector_col="vec")
    rows = hits.join(vectors.select("id", "cell"), "id").join(F.broadcast(asked), "qid").groupBy("qid").agg(F.first("qvec").alias("qvec"), F.collect_list("cell").alias("cells")).collect()
    if not rows:
        return 1, 1.0
    order = _distances(np.array([r["qvec"] for r in rows], np.float32), centroids).argsort(1, kind="stable")
    place = np.sort([int(np.flatnonzero(cells[o] == c)[0]) + 1 for r, o in zip(rows, order) for c in r["cells"]])
    nprobe = int(place[min(len(place) - 1, int(np.ceil(target * len(place))) - 1)])
    return nprobe, float((place <= nprobe).mean())


def open_index(spark: SparkSession, path: str) -> Index:
    """An index that ``build`` has written.  At most MAX_CELLS rows of small tables are read."""
    facts = spark.read.parquet(f"{path}/facts").first()
    found = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()
    sizes = dict(map(tuple, spark.read.parquet(f"{path}/sizes").groupBy("cell").agg(F.sum("n")).collect()))
    cells = np.array([r["cell"] for r in found], np.int32)
    return Index(spark, path, facts["dim"], facts["nprobe"], cells, np.array([r["centroid"] for r in found], np.float32),
                 np.array([sizes.get(int(c), 0) for c in cells], np.int64), T.StructType.fromJson(json.loads(facts["schema"])))


def add(index: Index, rows: DataFrame, *, id_col: str = "id", vector_col: str = "embedding", keep: Sequence[str] = ()) -> Index:
    """Index further rows in the cells that exist, as new files; the index opened anew."""
    data = _assigned(_usable(rows, index.dim, id_col, vector_col, keep), index.centroids, index.cells)
    _write_vectors(data, index.path)
    _sizes(index.spark, index.path, data)
    return open_index(index.spark, index.path)


def _probes(queries: DataFrame, index: Index, k: int, nprobe: int) -> DataFrame:
    """(qid, qvec, cell): the nearest cells of each query that hold any row, ``nprobe`` of them and
    more until they hold k rows."""
    held = index.sizes > 0
    sent = index.spark.sparkContext.broadcast((index.centroids[held], index.cells[held], index.sizes[held]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centroids, cells, sizes = sent.value
        for batch in batches:
            for lo in range(0, len(batch) if len(cells) else 0, 512):
                part = batch.iloc[lo : lo + 512]
                order = _distances(np.stack(part["qvec"].to_numpy()), centroids).argsort(1, kind="stable")
                enough = (np.cumsum(sizes[order], axis=1) < k).sum(1) + 1
                taken = [cells[o[: max(nprobe, least)]] for o, least in zip(order, enough)]
                times = [len(t) for t in taken]
                yield pd.DataFrame({
                    "qid": np.repeat(part["qid"].to_numpy(), times),
                    "qvec": [v for v, n in zip(part["qvec"], times) for _ in range(n)],
                    "cell": np.concatenate(taken),
                })

    return queries.mapInPandas(run, "qid long, qvec array<float>, cell int")


def search(
    index: Index,
    queries: DataFrame,
    k: int,
    *,
    nprobe: int | None = None,
    qid_col: str = "qid",
    query_vec_col: str = "embedding",
    exclude_self: bool = False,
    block_rows: int = 2048,
) -> DataFrame:
    """(qid, id, score, rank): the k nearest indexed rows by L2 in the probed cells, ties by id.
    Queries without id or with a vector of another dimension have no result."""
    q = _usable(queries, index.dim, qid_col, query_vec_col, ()).select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    probes = _probes(q, index, k + int(exclude_self), nprobe or index.nprobe)
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / F.lit(block_rows))).cast("int")
    asked = probes.groupBy("cell").agg(blocks(F.count(F.lit(1))).alias("nqb"))
    known = [(int(c), int(-(-n // block_rows))) for c, n in zip(index.cells, index.sizes) if n]
    held = index.spark.createDataFrame(known, "cell int, ncb int")
    stats = F.broadcast(asked.join(F.broadcast(held), "cell"))  # one row a probed cell: MAX_CELLS at most, and what prunes the folders
    left = probes.join(stats, "cell").select(
        "cell", F.pmod(F.xxhash64("qid"), F.col("nqb")).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.col("ncb") - 1)).alias("cb"), "qid", "qvec")
    right = index.vectors.join(stats, "cell").select(
        "cell", F.explode(F.sequence(F.lit(0), F.col("nqb") - 1)).alias("qb"), F.pmod(F.xxhash64("id"), F.col("ncb")).cast("int").alias("cb"), "id", "vec")
    keys = ["cell", "qb", "cb"]
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_block_kernel("l2", k, exclude_self), "qid long, id long, score double")
    best = Window.partitionBy("qid").orderBy(F.col("score").asc_nulls_last(), F.col("id"))
    return near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
