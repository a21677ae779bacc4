"""Removal of long matches between byte texts: every byte of a 400-byte string that starts elsewhere too.

The method dealt for this operator is a logarithmic family of suffix arrays; this module does not order
suffixes (the README says so).  It works on fingerprints: of each batch of documents the sampled
suffixes are those at the minimisers of its 400-byte windows (``windows``), each by the hash of its first
bytes and the hash of the stretch around it in which every window holds it.  A long match always holds a
common sample at the same place, so equal hashes find all of them.  Within one call the batches are
matched against levels that merge like the digits of a binary counter; the levels hold hashes and counts,
no places, and are not kept for later calls.

Samples with equal stretches match in all their windows.  Those that share the first
bytes only are extended to both sides: their stretches are read from the documents
and compared window by window.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import windows as win
from quarry.llm.common import cut, stored

#: Bytes in a match, and first bytes by which sampled suffixes are ordered.
MATCH, PREFIX = 400, 64

#: Batches into which one call deals its documents.
BATCHES = 4


def _eights(raw: bytes) -> np.ndarray:
    """Hash of each eight consecutive bytes."""
    if len(raw) < 8:
        return np.zeros(0, np.uint64)
    eight = np.ndarray((len(raw) - 7,), dtype="<u8", buffer=raw, strides=(1,)).astype(np.uint64)
    return win.mix(eight, eight)


BYTES = win.Units(lambda text: text.encode(), _eights, 1, 8)


class IndexFamily:
    """Sorted arrays (key, digest, n) of sampled suffixes, at most one of each rank."""

    def __init__(self) -> None:
        self.levels: list[tuple[int, DataFrame]] = []

    def add(self, batch: DataFrame) -> DataFrame:
        """Take in a batch's entries (key, digest, ...); the keys (repeats possible) that it
        holds twice or shares with an earlier batch."""
        array = cut(batch.groupBy("key", "digest").agg(F.count(F.lit(1)).alias("n")).sortWithinPartitions("key", "digest"))
        matches = [array.groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1").select("key")]
        matches += [array.join(level.select("key"), "key", "left_semi").select("key") for _, level in self.levels]
        found = cut(reduce(DataFrame.unionAll, matches))
        rank = 0
        while self.levels and self.levels[-1][0] == rank:
            both = self.levels.pop()[1].unionAll(array)
            array = cut(both.groupBy("key", "digest").agg(F.sum("n").alias("n")).sortWithinPartitions("key", "digest"))
            rank += 1
        self.levels.append((rank, array))
        return found


def marks(docs: DataFrame, match: int = MATCH, prefix: int = PREFIX, batches: int = BATCHES, max_classes: int = win.MAX_CLASSES) -> DataFrame:
    """(rid, start, stop): bytes [start, stop) of keyed ``docs`` covered by a string of ``match`` bytes that also starts elsewhere."""
    runs = stored(win.entries(docs, BYTES, match, prefix, earlier=False))
    every = runs.filter("digest IS NOT NULL")
    own = runs.filter("digest IS NULL").select("rid", F.col("key").alias("start"), F.col("at").alias("stop"))
    family = IndexFamily()
    batch = F.pmod(F.xxhash64("rid"), F.lit(batches))
    keys = cut(reduce(DataFrame.unionAll, [family.add(every.filter(batch == b)) for b in range(batches)]).distinct())
    found = stored(every.join(keys, "key", "left_semi"))
    classes = stored(found.groupBy("key", "digest").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rid", "at")).alias("first")))
    several = classes.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    apart = classes.join(several, "key").select("key", "digest", F.col("first.rid").alias("rid"), F.col("first.at").alias("at"), "m")
    inside = win.compared(stored(win.contents(docs, apart, BYTES, match)), BYTES, match, earlier=False, max_classes=max_classes)
    start, more = F.shiftright("at", win.SPAN), F.col("at").bitwiseAND((1 << win.SPAN) - 1)
    whole = (
        found.join(classes.filter("n > 1").select("key", "digest"), ["key", "digest"])
        .select("rid", start.alias("start"), (start + more + 1).alias("stop"))
    )
    return whole.unionAll(inside).unionAll(own).select("rid", "start", (F.col("stop") + (match - 1)).alias("stop"))


_OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, removed_from array<long>, removed_to array<long>, kept binary"


def clean(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, removed_from /
    removed_to (removed byte ranges, end exclusive) and ``kept`` (the other bytes).

    Texts count as UTF-8; null counts as empty.  Documents of fewer than 400 bytes keep
    all.  Rows that repeat an id are documents of their own; rows equal in id and text
    occur elsewhere by definition and lose every window.  An empty table gives no rows.
    Columns other than doc_id and text are not read."""
    rows = win.keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    some, rest = win.with_marks(rows, win.stretches(marks(rows, **options)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text, starts, stops in zip(batch["doc_id"].array, batch["text"], batch["starts"], batch["stops"]):
                raw = (text or "").encode()
                gone = np.zeros(len(raw), dtype=bool)
                if starts is not None and len(starts):
                    gone = win.covered(np.array(starts), np.array(stops), len(raw))
                edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                kept = np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes()
                out.append((
                    None if pd.isna(doc_id) else int(doc_id), len(raw), int(gone.sum()), len(edges) // 2, edges[::2].tolist(), edges[1::2].tolist(), kept,
                ))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "removed_from", "removed_to", "kept"])

    cleaned = some.select("doc_id", "text", "starts", "stops").mapInPandas(run, _OUT)
    if rest is None:
        return cleaned
    raw, none = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8"), F.array().cast("array<long>")
    zero = F.lit(0).cast("long")
    return cleaned.unionAll(rest.select("doc_id", F.octet_length(raw).cast("long"), zero, zero, none, none, raw))


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return clean(docs, **options).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

