"""Substring deduplication on words: windows of twenty words that also start earlier go.

The method dealt for this operator is a compacted de Bruijn graph; this module does not build one (the
README says so).  It finds equal windows through minimiser fingerprints (``windows``): consecutive windows of
a document that share a minimiser travel as one stretch, a Spark group finds which stretches repeat and
where each occurs first, and stretches that share a minimiser but differ are compared window by
window.  There are no nodes, degrees or joins between neighbours: each repeated stretch is marked by
itself, and the marks of a document are united in its row.  The source coordinates decide: a
window that also occurs earlier (smaller doc_id, or same document and earlier word) removes its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import windows as win
from quarry.llm.common import cut, remembers, stored

#: Words in an edge, and words hashed for its minimiser.
EDGE, GRAM = 20, 5


class _Hashes(dict):
    """word -> 64-bit hash, emptied when large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = _Hashes()
remembers("hashes", _HASHES.clear)


def split(text: str) -> list[bytes]:
    """Words: runs of anything but space and U+0009..U+000D, as UTF-8."""
    return text.encode().split()


def _parse(text: str) -> bytes:
    found = split(text)
    return np.fromiter(map(_HASHES.__getitem__, found), np.uint64, len(found)).tobytes()


WORDS = win.Units(_parse, lambda raw: np.frombuffer(raw, dtype=np.uint64), 8)


def marks(docs: DataFrame, edge: int = EDGE, gram: int = GRAM, max_classes: int = win.MAX_CLASSES) -> DataFrame:
    """(rid, start, stop): words [start, stop) of keyed ``docs`` that an earlier equal edge removes."""
    runs = win.entries(docs, WORDS, edge, gram, earlier=True)
    repeated = cut(runs.filter("digest IS NOT NULL").groupBy("key").count().filter("count > 1").select("key"))
    every = stored(runs.join(repeated.withColumn("again", F.lit(True)), "key", "left").filter("again OR digest IS NULL").drop("again"))
    found = every.filter("digest IS NOT NULL")
    own = every.filter("digest IS NULL").select("rid", F.col("key").alias("start"), F.col("at").alias("stop"))
    place = F.struct("rid", "at")
    classes = stored(found.groupBy("key", "digest").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")))
    branching = classes.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    apart = classes.join(branching, "key").select("key", "digest", F.col("first.rid").alias("rid"), F.col("first.at").alias("at"), "m")
    inside = win.compared(stored(win.contents(docs, apart, WORDS, edge)), WORDS, edge, earlier=True, max_classes=max_classes)
    start, more = F.shiftright("at", win.SPAN), F.col("at").bitwiseAND((1 << win.SPAN) - 1)
    paths = (
        found.join(classes.filter("n > 1").select("key", "digest", "first"), ["key", "digest"])
        .filter(place > F.col("first"))
        .select("rid", start.alias("start"), (start + more + 1).alias("stop"))
    )
    return paths.unionAll(inside).unionAll(own).select("rid", "start", (F.col("stop") + (edge - 1)).alias("stop"))


_OUT = "doc_id long, n_words long, n_removed long, removed_from array<long>, removed_to array<long>, kept string"


def clean(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, removed_from / removed_to
    (removed word ranges, end exclusive) and ``kept`` (the other words joined by one space).

    Null and empty texts have no words and keep the empty text; documents of fewer
    than 20 words keep all.  Null ids come last in order; rows that share an id are
    ordered by a hash of the text, and rows equal in both count as one place, all
    cleaned alike.  An empty table gives no rows.  Columns other than doc_id and text are not read."""
    rows = win.keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    some, rest = win.with_marks(rows, win.stretches(marks(rows, **options)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text, starts, stops in zip(batch["doc_id"].array, batch["text"], batch["starts"], batch["stops"]):
                found = split(text or "")
                gone = np.zeros(len(found), dtype=bool)
                if starts is not None and len(starts):
                    gone = win.covered(np.array(starts), np.array(stops), len(found))
                edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                kept = b" ".join([w for w, g in zip(found, gone.tolist()) if not g]).decode()
                out.append((None if pd.isna(doc_id) else int(doc_id), len(found), int(gone.sum()), edges[::2].tolist(), edges[1::2].tolist(), kept))
            yield pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "removed_from", "removed_to", "kept"])

    cleaned = some.select("doc_id", "text", "starts", "stops").mapInPandas(run, _OUT)
    if rest is None:
        return cleaned
    blank = F.lit("[\\x20\\x09-\\x0D]+")
    # trimmed of the blank itself: a regular expression's $ also matches before a last U+0085, U+2028 or U+2029
    kept = F.btrim(F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), blank, F.lit(" ")), F.lit(" "))
    n = F.when(F.length(kept) == 0, 0).otherwise(F.length(kept) - F.length(F.replace(kept, F.lit(" "), F.lit(""))) + 1)
    none = F.array().cast("array<long>")
    return cleaned.unionAll(rest.select("doc_id", n.cast("long"), F.lit(0).cast("long"), none, none, kept))


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    return clean(docs, **options).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))

