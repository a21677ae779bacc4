"""Nearest-neighbour search over embedding tables.

* ``knn_search``: one query vector (a literal or a one-row scalar subquery), scope
  filter, score, ``orderBy(score, id).limit(k)``.  Catalyst plans this as a
  single scan + ``TakeOrderedAndProject``: every task keeps its own top k, the
  driver merges ``k x tasks`` rows.  No join, no Python.
* ``knn_join``: many queries at once (exact).  A query set proven small by a
  bounded count is broadcast and the corpus is scanned in place, each task
  keeping a running top-k per query (no corpus shuffle).  Otherwise queries and
  corpus rows are hashed
  into blocks of at most ``block_rows`` rows inside their scope; each
  (scope, query block, corpus block) group is scored by a NumPy kernel that keeps
  only the k best per query, then a ``row_number() <= k`` window (planned as
  ``WindowGroupLimit``) merges the per-block candidates.  Pairs are never
  materialised as rows, every group is bounded by ``block_rows`` on both sides,
  and a scope holding a third of the corpus is simply split into more blocks
  (block nested-loop kNN join, as in Zhang, Li & Jestes, EDBT 2012).
* ``knn_ann``: approximate search with MLlib ``BucketedRandomProjectionLSH``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.vectors import cosine_distance, dimension_ok, l2_distance
from quarry.plans.guards import spread

METRICS = ("l2", "cosine")


def score_expr(metric: str, vec, query) -> Column:
    if metric == "l2":
        return l2_distance(vec, query)
    if metric == "cosine":
        return cosine_distance(vec, query)
    raise ValueError(f"unknown metric {metric!r}; expected one of {METRICS}")


def knn_search(
    corpus: DataFrame,
    query: Column,
    k: int,
    *,
    vector_col: str = "embedding",
    id_col: str = "id",
    where: Column | None = None,
    metric: str = "l2",
    score_col: str = "score",
) -> DataFrame:
    """Top-k rows of ``corpus`` nearest to ``query``.

    ``query`` is any Column holding one vector: ``F.lit(...)`` of a Python list,
    or ``other_df.select(vec).scalar()`` (a scalar subquery, evaluated once and
    shipped to the tasks; Spark fails it when it returns more than one row, which
    is the size bound).  Ties are broken by ``id_col`` so the result is total.
    """
    df = corpus if where is None else corpus.filter(where)
    # A subquery cannot sit inside a higher-order function, so stage it as a column.
    df = df.withColumn("__q", query)
    scored = df.withColumn(score_col, score_expr(metric, F.col(vector_col), F.col("__q"))).drop("__q")
    return scored.orderBy(F.col(score_col).asc_nulls_last(), F.col(id_col)).limit(k)


# --------------------------------------------------------------------------- block kNN join


_PAD_ID = np.iinfo(np.int64).max


def _score_matrix(metric: str, Q: np.ndarray, C: np.ndarray) -> np.ndarray:
    """Scores of every query row against every corpus row, with the same order of
    operations as functions.vectors: float32 difference, float64 square or
    product, left-to-right sum over dimensions (bit-identical to the SQL form)."""
    nq, nc = Q.shape[0], C.shape[0]
    acc = np.zeros((nq, nc), dtype=np.float64)
    if metric == "l2":
        for j in range(Q.shape[1]):
            d = (C[None, :, j] - Q[:, None, j]).astype(np.float64)
            acc += d * d
        return np.sqrt(acc)
    q64, c64 = Q.astype(np.float64), C.astype(np.float64)
    nq_, nc_ = np.zeros(nq), np.zeros(nc)
    for j in range(Q.shape[1]):
        acc += q64[:, None, j] * c64[None, :, j]
        nq_ += q64[:, j] * q64[:, j]
        nc_ += c64[:, j] * c64[:, j]
    den = np.sqrt(nc_)[None, :] * np.sqrt(nq_)[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        out = 1.0 - acc / den
    out[den == 0] = np.nan
    return out


def _row_topk(S: np.ndarray, ids: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row, the ``m`` smallest scores ordered by (score, id), exactly (ties
    included before cutting).  Null (NaN) scores sort last.  Rows are padded with
    NaN / ``_PAD_ID`` when they hold fewer than ``m`` entries."""
    nq, n = S.shape
    key = np.where(np.isnan(S), np.inf, S)
    kk = min(m, n)
    out_s = np.full((nq, m), np.nan)
    out_i = np.full((nq, m), _PAD_ID, dtype=np.int64)
    if kk == 0 or nq == 0:
        return out_s, out_i
    thr = np.partition(key, kk - 1, axis=1)[:, kk - 1]
    rows, cols = np.nonzero(key <= thr[:, None])
    order = np.lexsort((ids[rows, cols], key[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    rank = np.arange(len(rows)) - np.searchsorted(rows, np.arange(nq))[rows]
    keep = rank < kk
    rows, cols, rank = rows[keep], cols[keep], rank[keep]
    out_s[rows, rank] = S[rows, cols]
    out_i[rows, rank] = ids[rows, cols]
    return out_s, out_i


def _emit(qid: np.ndarray, best_s: np.ndarray, best_i: np.ndarray, k: int, exclude_self: bool) -> pd.DataFrame:
    q = np.repeat(qid, best_s.shape[1])
    out = pd.DataFrame({"qid": q, "id": best_i.ravel(), "score": best_s.ravel()})
    out = out[out["id"] != _PAD_ID]
    if exclude_self:
        out = out[out["qid"] != out["id"]]
    return out


def _block_kernel(metric: str, k: int, exclude_self: bool):
    """Per (scope, query block, corpus block) group: the k best corpus rows per query."""
    take = k + 1 if exclude_self else k

    def kernel(qpdf: pd.DataFrame, cpdf: pd.DataFrame) -> pd.DataFrame:
        if len(qpdf) == 0 or len(cpdf) == 0:
            return pd.DataFrame({"qid": pd.Series([], dtype="int64"), "id": pd.Series([], dtype="int64"),
                                 "score": pd.Series([], dtype="float64")})
        cid = cpdf["id"].to_numpy(np.int64)
        qid = qpdf["qid"].to_numpy(np.int64)
        C = np.stack(cpdf["vec"].to_numpy()).astype(np.float32)
        Q = np.stack(qpdf["qvec"].to_numpy()).astype(np.float32)
        S = _score_matrix(metric, Q, C)
        best_s, best_i = _row_topk(S, np.broadcast_to(cid, S.shape), take)
        return _emit(qid, best_s, best_i, k, exclude_self)

    return kernel


def _broadcast_kernel(bq, metric: str, k: int, exclude_self: bool, block_rows: int, nscope: int):
    """Per corpus partition: a running top-k per broadcast query (kept across the
    partition's Arrow batches), emitted once at the end of the partition."""
    take = k + 1 if exclude_self else k

    def run(batches):
        queries = bq.value  # scope tuple -> (qid array, query matrix)
        best: dict = {}
        for pdf in batches:
            if len(pdf) == 0:
                continue
            groups = pdf.groupby(list(pdf.columns[2:2 + nscope]), sort=False) if nscope else [((), pdf)]
            for sk, part in groups:
                sk = sk if isinstance(sk, tuple) else (sk,)
                if sk not in queries:
                    continue
                qid, Q = queries[sk]
                for lo in range(0, len(part), block_rows):
                    blk = part.iloc[lo:lo + block_rows]
                    cid = blk["id"].to_numpy(np.int64)
                    C = np.stack(blk["vec"].to_numpy()).astype(np.float32)
                    for at in range(0, len(qid), block_rows):  # tiles of queries: the score matrix is bounded
                        S = _score_matrix(metric, Q[at:at + block_rows], C)
                        ids = np.broadcast_to(cid, S.shape)
                        if (sk, at) in best:
                            S = np.concatenate([best[sk, at][0], S], axis=1)
                            ids = np.concatenate([best[sk, at][1], ids], axis=1)
                        best[sk, at] = _row_topk(S, ids, take)
        for (sk, at), (bs, bi) in best.items():
            yield _emit(queries[sk][0][at:at + block_rows], bs, bi, k, exclude_self)

    return run


def knn_join(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    *,
    scope: Sequence[str] = (),
    metric: str = "l2",
    exclude_self: bool = False,
    block_rows: int = 2048,
    strategy: str = "blocks",
    max_broadcast_queries: int = 20_000,
    max_broadcast_bytes: int = 64 << 20,
    qid_col: str = "qid",
    query_vec_col: str = "embedding",
    id_col: str = "id",
    vector_col: str = "embedding",
) -> DataFrame:
    """Exact k nearest corpus rows for every query row, within equal ``scope``.

    Returns ``qid, id, score, rank`` (rank 1..k, ties broken by id).

    ``strategy="blocks"`` (default) is the block nested-loop join, for query sets of any
    size.  ``strategy="broadcast"`` is for callers who know their query set to be small:
    it ships the queries to every task and scans the corpus in place (no shuffle of the
    corpus; each task emits at most k candidates per query), and raises when the set
    has more than ``max_broadcast_queries`` rows or ``max_broadcast_bytes`` of vectors.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    scope = list(scope)
    # Fresh aliases: queries and corpus are often the same table (self kNN join).
    q = queries.select(F.col(qid_col).cast("long").alias("qid"), *[F.col(s).alias(s) for s in scope],
                       F.col(query_vec_col).alias("qvec"))
    c = corpus.select(F.col(id_col).cast("long").alias("id"), *[F.col(s).alias(s) for s in scope],
                      F.col(vector_col).alias("vec"))
    if strategy not in ("blocks", "broadcast"):
        raise ValueError(f"unknown strategy {strategy!r}")
    if strategy == "broadcast":
        if not _query_set_fits(q, max_broadcast_queries, max_broadcast_bytes):
            raise ValueError("query set too large to broadcast; use strategy='blocks'")
        return _knn_broadcast(q, c, k, scope, metric, exclude_self, block_rows)
    # Blocks per scope from the row counts.  Scoped: one small row per scope,
    # joined on the scope key.  Unscoped: two scalar subqueries (no join at all).
    nblocks = lambda n: F.greatest(F.lit(1), F.ceil(n / F.lit(block_rows))).cast("int")
    if scope:
        stats = (
            c.groupBy(*scope).agg(nblocks(F.count("*")).alias("ncb"))
            .join(q.groupBy(*scope).agg(nblocks(F.count("*")).alias("nqb")), scope)
        )
        qs, cs = q.join(stats, scope), c.join(stats, scope)
    else:
        ncb = c.agg(nblocks(F.count("*"))).scalar()
        nqb = q.agg(nblocks(F.count("*"))).scalar()
        qs = q.withColumn("ncb", ncb).withColumn("nqb", nqb)
        cs = c.withColumn("ncb", ncb).withColumn("nqb", nqb)
    qb = (
        qs.withColumn("qb", F.pmod(F.xxhash64("qid"), F.col("nqb")).cast("int"))
        .withColumn("cb", F.explode(F.sequence(F.lit(0), F.col("ncb") - 1)))
        .select(*scope, "qb", "cb", "qid", "qvec")
    )
    cb = (
        cs.withColumn("cb", F.pmod(F.xxhash64("id"), F.col("ncb")).cast("int"))
        .withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("nqb") - 1)))
        .select(*scope, "qb", "cb", "id", "vec")
    )
    keys = [*scope, "qb", "cb"]
    cand = (
        qb.groupBy(*keys)
        .cogroup(cb.groupBy(*keys))
        .applyInPandas(_block_kernel(metric, k, exclude_self), "qid long, id long, score double")
    )
    w = Window.partitionBy("qid").orderBy(F.col("score").asc_nulls_last(), F.col("id"))
    return cand.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _query_set_fits(q: DataFrame, max_rows: int, max_bytes: int) -> bool:
    """Bounded check over at most ``max_rows`` + 1 rows: their number and the bytes of
    all their float32 vectors."""
    n, size = q.limit(max_rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("qvec")), F.lit(0))).first()
    return n <= max_rows and size * 4 <= max_bytes


def _knn_broadcast(q: DataFrame, c: DataFrame, k: int, scope: list[str], metric: str, exclude_self: bool,
                   block_rows: int) -> DataFrame:
    """Broadcast-query strategy of ``knn_join`` (the caller proved the query set small)."""
    spark = q.sparkSession
    rows = q.toPandas()  # bounded in rows and bytes by the caller's check
    rows = rows[rows["qvec"].notna()]
    groups = rows.groupby(scope, sort=False) if scope else [((), rows)]
    payload = {sk if isinstance(sk, tuple) else (sk,): (g["qid"].to_numpy(np.int64), np.stack(g["qvec"].to_numpy()).astype(np.float32))
               for sk, g in groups if len(g)}
    bq = spark.sparkContext.broadcast(payload)
    corpus = spread(c.select("id", "vec", *scope), "id")
    cand = corpus.mapInPandas(_broadcast_kernel(bq, metric, k, exclude_self, block_rows, len(scope)),
                              "qid long, id long, score double")
    w = Window.partitionBy("qid").orderBy(F.col("score").asc_nulls_last(), F.col("id"))
    return cand.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


# --------------------------------------------------------------------------- approximate


def knn_ann(
    corpus: DataFrame,
    query: Sequence[float],
    k: int,
    *,
    vector_col: str = "embedding",
    id_col: str = "id",
    bucket_length: float = 2.0,
    num_tables: int = 4,
    seed: int = 7,
) -> DataFrame:
    """Approximate k-NN (D5) with random-projection LSH.  Recall is checked by a
    test against ``knn_search``; never compared exactly."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    df = corpus.withColumn("__v", array_to_vector(F.col(vector_col)))
    model = BucketedRandomProjectionLSH(
        inputCol="__v", outputCol="__h", bucketLength=bucket_length, numHashTables=num_tables, seed=seed
    ).fit(df)
    res = model.approxNearestNeighbors(df, Vectors.dense([float(x) for x in query]), k, distCol="score")
    return res.drop("__v", "__h")


# --------------------------------------------------------------------------- reports


def search_report(hits: DataFrame, *, path_col: str = "filepath", score_col: str = "score",
                  rank_col: str = "rank") -> DataFrame:
    """``"%d. %s (Score: %.2f)"`` per hit (D6).  ``hits`` must carry a rank."""
    return hits.withColumn(
        "line", F.format_string("%d. %s (Score: %.2f)", F.col(rank_col), F.col(path_col), F.col(score_col))
    )


def dimension_report(df: DataFrame, dim: int, *, vector_col: str = "embedding") -> DataFrame:
    """Vectors grouped by dimension with an ``ok`` flag."""
    v = F.col(vector_col)
    return df.groupBy(F.size(v).alias("dim")).agg(
        F.count("*").alias("n_vectors"),
        F.sum(F.when(F.exists(v, lambda x: x.isNull()), 1).otherwise(0)).cast("long").alias("n_with_nulls"),
    ).withColumn("ok", (F.col("dim") == F.lit(dim)) & (F.col("n_with_nulls") == 0))


def bad_vectors(df: DataFrame, dim: int, *, vector_col: str = "embedding") -> DataFrame:
    """Rows whose vector does not have ``dim`` non-null elements."""
    return df.filter(~dimension_ok(F.col(vector_col), dim) | F.col(vector_col).isNull())
