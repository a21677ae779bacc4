"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  Each sentence has a logistic score of its distinct
words and word beginnings, and the document's score is their noisy-or.  Only documents carry
labels, so the sentence weights are trained through the noisy-or; afterwards the same
scores locate the offending sentences.

The score p of a sentence is what it says beyond one without any weighted word: 1 - (1 - l) / (1 - l0), l
being the logistic of BIAS and its weights and l0 that of BIAS alone.  So sentences without such words
leave the noisy-or 1 - (1 - LEAK) * prod(1 - p) where it is however many they are, and a long clean
text scores as a short one; LEAK is what a document has without any sentence.  BIAS is given, not
learnt: the further below zero, the less do weak words of many sentences add up to.

Fitting uses a bounded sample (``labelled.sample``); the model is a word -> weight
table of at most ``VOCABULARY`` entries.
"""

from __future__ import annotations

import re
from array import array
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import labelled
from quarry.llm.common import crc_mod

#: Ids with crc32 mod 5 equal to 0 are held out.
HELD_OUT = (5, 0)

#: Features kept, and documents of the sample that must hold one.
VOCABULARY, MIN_DOCS = 30_000, 3

#: Training steps, step size, and the pull of every weight towards zero.
STEPS, RATE, SPARSE = 120, 0.2, 2e-4

#: Score of a document without sentences; log-odds of a sentence without weighted words.
LEAK, BIAS = 0.01, -8.0

#: Words, and sentences.
WORD = re.compile(r"[^\W_]+")
SENTENCE = re.compile(r"[^.!?\n]+")


@dataclass(frozen=True)
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = BIAS
    known: float | None = 0.0  # the score of every text where the labels know one class only


def features(word: str) -> tuple[str, ...]:
    """The word and its beginnings of four and five letters (marked by ^)."""
    return (word, "^" + word[:4], "^" + word[:5]) if len(word) > 5 else (word, "^" + word[:4]) if len(word) > 4 else (word,)


def bag(text: str) -> list[set[str]]:
    """The distinct words of every sentence that has any."""
    return [set(found) for s in SENTENCE.findall(text.lower()) if (found := WORD.findall(s))]


def train(rows: list[tuple[str, int]]) -> Model:
    """Weights that fit the noisy-or of sentence scores to document labels (full-batch
    Adam; weights are never negative and pulled to 0, so that words of no use have none)."""
    y = np.array([label for _, label in rows], dtype=float)
    if not len(y) or y.min() == y.max():
        return Model(known=0.0 if not len(y) or y.max() == 0 else 1.0)
    # texts are taken apart twice rather than kept as sets of words: a driver holds numbers only
    held: dict[str, int] = {}
    for text, _ in rows:
        for name in {f for s in bag(text) for w in s for f in features(w)}:
            held[name] = held.get(name, 0) + 1
    chosen = sorted((f for f, n in held.items() if n >= MIN_DOCS), key=lambda f: (-held[f], f))[:VOCABULARY]
    del held
    number = {f: i for i, f in enumerate(chosen)}
    ids_, sentence_, doc_ = array("i"), array("i"), array("i")
    for d, (text, _) in enumerate(rows):
        for s in bag(text):
            found = sorted({number[f] for w in s for f in features(w) if f in number})
            ids_.extend(found)
            sentence_.extend([len(doc_)] * len(found))
            doc_.append(d)
    ids, sentence_of, doc_of = (np.array(x, dtype=np.int64) for x in (ids_, sentence_, doc_))
    n_s, n_d = len(doc_of), len(y)
    # balanced classes, so that the rarer label is learnt as well
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    w = np.zeros(len(chosen))
    for steps in (STEPS, 4 * STEPS):  # all features, then those that got a weight
        m, v = np.zeros(len(w)), np.zeros(len(w))
        for step in range(1, steps + 1):
            z = np.minimum(np.bincount(sentence_of, weights=w[ids], minlength=n_s) + BIAS, 30)
            p = 1 / (1 + np.exp(-z))
            clean = (1 - LEAK) * np.exp(np.bincount(doc_of, weights=np.logaddexp(0, BIAS) - np.logaddexp(0, z), minlength=n_d))
            # d loss / d z: p for a clean document; -(1 - P) / P * p for a toxic one
            pull = np.where(y == 1, -clean / np.maximum(1 - clean, 1e-9), 1.0) * weight
            grad = np.bincount(ids, weights=(pull[doc_of] * p / n_d)[sentence_of], minlength=len(w)) + SPARSE
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            w = np.maximum(w - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8), 0.0)
        used = np.flatnonzero(w > 0.05)
        new = np.full(len(w), -1)
        new[used] = np.arange(len(used))
        keep = new[ids] >= 0 if len(ids) else np.zeros(0, dtype=bool)
        ids, sentence_of, chosen, w = new[ids][keep], sentence_of[keep], [chosen[i] for i in used], w[used]
    return Model(dict(zip(chosen, map(float, w))), known=None)


class _Weights(dict):
    """word -> summed weight of its features, filled as words come; emptied when large."""

    def __init__(self, model: Model):
        self.get_weight = model.weights.get

    def __missing__(self, word: str) -> float:
        if len(self) > 500_000:
            self.clear()
        value = sum(self.get_weight(f, 0.0) for f in features(word))
        self[word] = value
        return value


def sentence_scores(model: Model, text: str | None, weights: _Weights | None = None) -> np.ndarray:
    """Score of each sentence that has words, in order."""
    weights = _Weights(model) if weights is None else weights
    low = (text or "").lower()
    parts = [s for s in SENTENCE.findall(low) if WORD.search(s)]
    z = np.full(len(parts), model.bias)
    if any(map(weights.__getitem__, WORD.findall(low))):
        for i, part in enumerate(parts):
            found = {f for w in WORD.findall(part) if weights[w] for f in features(w) if f in model.weights}
            if found:
                z[i] += sum(map(model.weights.__getitem__, sorted(found)))
    # 1 - (1 - logistic(z)) / (1 - logistic(bias)), by the difference of the logarithms
    return -np.expm1(np.minimum(np.logaddexp(0, model.bias) - np.logaddexp(0, z), 0.0))


def sentences(text: str) -> list[tuple[int, int]]:
    """Offsets of the sentences that have words: runs between ``. ! ?`` and line ends."""
    return [m.span() for m in SENTENCE.finditer(text) if WORD.search(m.group())]


def noisy_or(model: Model, p: np.ndarray) -> float:
    """Score of a document from those of its sentences."""
    if model.known is not None:
        return model.known
    return float(1 - (1 - LEAK) * np.exp(np.log1p(-np.minimum(p, 1 - 1e-12)).sum()))


def fit(docs: DataFrame, labels: DataFrame, **bounds: int) -> Model:
    return train(labelled.sample(docs, labels, "toxic", held_out_mod=HELD_OUT, **bounds))


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, score of each whole text, and the offending sentences (those whose own
    score reaches ``threshold``): sentence_from, sentence_to (character offsets, end
    exclusive) and sentence_score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = sent.value
        weights = _Weights(model)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"].array, batch["text"]):
                p = sentence_scores(model, text, weights)
                bad = np.flatnonzero(p >= threshold)
                spans = sentences(text) if len(bad) else []
                out.append((None if pd.isna(doc_id) else int(doc_id), noisy_or(model, p), [spans[i][0] for i in bad], [spans[i][1] for i in bad], [float(p[i]) for i in bad]))
            yield pd.DataFrame(out, columns=["doc_id", "score", "sentence_from", "sentence_to", "sentence_score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(
        run, "doc_id long, score double, sentence_from array<long>, sentence_to array<long>, sentence_score array<double>"
    )


def report(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted, and the offending sentences.

    Empty and null texts have no sentences and score LEAK; repeated rows each get the same
    score; an empty table gives no rows; without labels of both classes
    every text scores as the one class known (no labels: clean).  Columns other than
    doc_id, text and toxic are not read."""
    m, r = HELD_OUT
    return score(docs, fit(docs, labels, **bounds)).select(
        "doc_id", (crc_mod("doc_id", m) == r).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "sentence_from", "sentence_to", "sentence_score",
    )

