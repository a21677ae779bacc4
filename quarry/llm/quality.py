"""Quality classifier by compression.

Two zstandard dictionaries are trained, one on good and one on bad labelled texts.  A
text is cut into pieces short enough that the dictionary matters in each, every piece
is compressed with both, and the sizes are added up over the whole text.  The
normalised difference of the two sizes, with the compression ratio beside it (text
that repeats itself compresses well with either dictionary), is calibrated to a
probability on labelled rows that the dictionaries have not seen.

Fitting uses a bounded sample (``labelled.sample``); the model (two dictionaries of
at most ``DICT_BYTES`` and three numbers) is what the executors receive.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import labelled
from quarry.llm.common import crc_mod, only, remembers

#: Bytes in a piece, bytes in a dictionary, compression level.
PIECE, DICT_BYTES, LEVEL = 1024, 65_536, 3

#: Ids with crc32 mod 3 equal to 1 are held out.
HELD_OUT = (3, 1)


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    #: of the size difference, of the compression ratio, and the constant
    weights: tuple[float, float, float]


def pieces(text: str) -> list[bytes]:
    raw = text.encode("utf-8", "surrogatepass")
    return [raw[i : i + PIECE] for i in range(0, max(1, len(raw)), PIECE)]


def _dictionary(texts: list[str]) -> bytes:
    samples = [p for t in texts for p in pieces(t) if len(p) >= 8]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few samples to train: their plain bytes serve as dictionary
        return b"".join(samples)[-DICT_BYTES:]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    options = {"level": LEVEL, "write_checksum": False, "write_content_size": False, "write_dict_id": False}
    if len(dictionary) < 8:
        return zstandard.ZstdCompressor(**options)
    held = zstandard.ZstdCompressionDict(dictionary)
    held.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=held, **options)


class Scorer:
    def __init__(self, good: bytes, bad: bytes):
        self.good, self.bad = _compressor(good), _compressor(bad)

    def features(self, text: str | None) -> tuple[float, float]:
        """((bad - good) / larger, smaller / plain) of the sizes of the whole text."""
        good = bad = plain = 0
        for piece in pieces(text or ""):
            good += len(self.good.compress(piece))
            bad += len(self.bad.compress(piece))
            plain += len(piece)
        return (bad - good) / max(good, bad, 1), min(good, bad) / max(plain, 1)


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted logistic regression by Newton steps with a small ridge."""
    x = np.c_[x, np.ones(len(x))]
    b = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -35, 35)))
        hessian = (x * (w * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(b))
        step = np.linalg.solve(hessian, x.T @ (w * (y - p)) - 1e-2 * b)
        b = b + step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return b


def fit(docs: DataFrame, labels: DataFrame, **bounds: int) -> Model | None:
    """The model of the labelled rows outside the held-out fold; None without rows of both classes."""
    rows = labelled.sample(docs, labels, "quality", held_out_mod=HELD_OUT, **bounds)
    by = {y: [t for t, label in rows if label == y] for y in (0, 1)}
    if not by[0] or not by[1]:
        return None
    split = {y: max(1, 2 * len(by[y]) // 3) for y in by}
    good, bad = (_dictionary(by[y][: split[y]]) for y in (1, 0))
    scorer = Scorer(good, bad)
    seen = [(t, y) for y in by for t in (by[y][split[y] :] or by[y])]
    x = np.array([scorer.features(t) for t, _ in seen])
    y = np.array([float(label) for _, label in seen])
    share = known_share(labels)
    w = np.where(y == 1, share / max(1e-9, y.mean()), (1 - share) / max(1e-9, 1 - y.mean()))
    return Model(good, bad, tuple(map(float, _logistic(x, y, w))))


def known_share(labels: DataFrame) -> float:
    """Share of label 1 among the labelled rows that may be used, kept off 0 and 1."""
    m, r = HELD_OUT
    share = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (crc_mod("doc_id", m) != r)).agg(F.avg("quality")).first()[0]
    return min(0.99, max(0.01, float(share or 0.5)))


_SCORERS: dict[object, Scorer] = {}
remembers("scorers", _SCORERS.clear)


def _scorer(good: bytes, bad: bytes) -> Scorer:
    """The worker's scorer of these dictionaries; a new one takes the place of what was remembered before it,
    other operators' too."""
    token = (hash(good), hash(bad))
    if token not in _SCORERS:
        only("scorers")
        _SCORERS.clear()
        _SCORERS[token] = Scorer(good, bad)
    return _SCORERS[token]


def score(model: Model | None, text: Column) -> Column:
    """Probability of label 1 for each whole text; null counts as empty; 0.5 without a model."""
    if model is None:
        return F.lit(0.5)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        scorer = _scorer(model.good, model.bad)
        x = np.array([scorer.features(t) for t in texts]).reshape(-1, 2)
        z = x @ np.array(model.weights[:2]) + model.weights[2]
        return pd.Series(1 / (1 + np.exp(-np.clip(z, -35, 35))))

    return scored(text.cast("string"))


def report(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Empty and null texts are scored as the empty text, repeated rows each get the
    same score, an empty table gives no rows.  Without labels of both classes every score is
    0.5.  Columns other than doc_id, text and quality are not read."""
    model = fit(docs, labels, **bounds)
    m, r = HELD_OUT
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod("doc_id", m) == r).alias("held_out"), score(model, F.col("text")).alias("score")).select(
        "doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """``docs`` without the documents scored below 0.5; same columns."""
    return docs.filter(score(fit(docs, labels, **bounds), F.col("text")) >= 0.5)
