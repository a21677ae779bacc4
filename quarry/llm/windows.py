"""Equal windows of a corpus, found through sampled positions.

A document is a sequence of units (bytes, or words by their 64-bit hash) and a window
is ``length`` consecutive units.  Every window has a *minimiser*: the position in it of
the smallest hash of ``gram`` consecutive units (the leftmost of equal ones).  It
depends on the window's content only, so equal windows have the same minimiser gram
at the same place.  Neighbouring windows mostly share their minimiser; such a run of
windows, as one stretch of units, is what travels: a row (key, digest, rid, at) with
the gram's hash as key, the hash of the whole stretch as digest, the document and the
place.  Rows whose key comes once hold no repeated window.  Rows equal in key and
digest (a *class*) repeat in every window.  Only classes that share a key and differ
in digest are compared window by window, from their content.

All hashes have 64 bits and equality of windows takes key and digest, or the hashes of
both halves of a window: 128 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import MAX_BROADCAST_IDS, cut, id_order, small_side

#: Classes of one key up to which they are compared in one task.
MAX_CLASSES = 5_000

#: Places are packed as first window << SPAN | windows in the run - 1.
SPAN = 20

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SHIFT = np.uint64(32)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hashes of pairs."""
    x = (a ^ (b * _A + (b >> _SHIFT))) * _B
    return x ^ (x >> _SHIFT)


def grams(hashes: np.ndarray, size: int, have: int = 1) -> np.ndarray:
    """Hash of each ``size`` consecutive units, by doubling (the last two parts may
    overlap); ``hashes`` covers ``have`` units each."""
    out = hashes
    while have * 2 <= size:
        out, have = mix(out[:-have], out[have:]), have * 2
    if have < size:
        out = mix(out[: len(out) - (size - have)], out[size - have :])
    return out


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values: running minima of blocks from both sides."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, dtype=values.dtype)
    padded[:n] = values
    square = padded.reshape(blocks, width)
    left = np.minimum.accumulate(square, axis=1).ravel()
    right = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def runs(hashes: np.ndarray, length: int, gram: int, have: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, first window, last window) of each run of windows with one minimiser."""
    if len(hashes) + have - 1 < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    each = grams(hashes, gram, have)
    tagged = (each & ~np.uint64(0xFFFFFFFF)) | np.arange(len(each), dtype=np.uint64)
    at = (sliding_min(tagged, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
    last = np.concatenate([first[1:] - 1, [len(at) - 1]])
    return each[at[first]], first, last


@dataclass(frozen=True)
class Units:
    """How a text becomes units: ``parse`` gives their bytes, ``size`` bytes each, and
    ``hashes`` the hash of every ``have`` consecutive units of such bytes."""

    parse: Callable[[str], bytes]
    hashes: Callable[[bytes], np.ndarray]
    size: int
    have: int = 1

    def runs(self, raw: bytes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return runs(self.hashes(raw), length, gram, self.have)

    def windows(self, raw: bytes, length: int) -> np.ndarray:
        """Hash of each window of a stretch."""
        return grams(self.hashes(raw), length, self.have)


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_q_rid``, a long that orders rows by doc_id (null last), then by a
    hash of the text, and tells rows apart that differ in either.  It is the doc_id itself where ids
    are unique."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    if ids.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").limit(1).count() == 0:
        return docs.withColumn("_q_rid", F.col("doc_id").cast("long"))
    own = F.struct(id_order().alias("o"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("x"))
    order = cut(
        docs.select(own.alias("_q_own")).distinct().repartitionByRange("_q_own").sortWithinPartitions("_q_own").withColumn("_q_rid", F.monotonically_increasing_id())
    )
    return docs.withColumn("_q_own", own).join(order, "_q_own").drop("_q_own")


def _signed(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.int64)


def _within(key: np.ndarray, digest: np.ndarray, first: np.ndarray, last: np.ndarray, earlier: bool) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Which runs of one document to report, and merged windows [start, stop) settled by
    the document itself: where a class repeats inside it, all its runs (but the first,
    if ``earlier``) are settled, and one or two of them stand for it."""
    _, index, inverse, counts = np.unique(mix(key, digest), return_index=True, return_inverse=True, return_counts=True)
    if len(index) == len(key):
        return np.arange(len(key)), []
    order = np.argsort(inverse, kind="stable")
    rank = np.empty(len(key), dtype=np.int64)
    rank[order] = np.arange(len(key)) - (np.cumsum(counts) - counts)[inverse[order]]
    done = np.flatnonzero((rank > 0) if earlier else (counts[inverse] > 1))
    spans: list[tuple[int, int]] = []
    for a, b in zip(first[done].tolist(), last[done].tolist()):
        if spans and spans[-1][1] >= a:
            spans[-1] = (spans[-1][0], b + 1)
        else:
            spans.append((a, b + 1))
    return np.flatnonzero(rank < (1 if earlier else 2)), spans


def entries(docs: DataFrame, units: Units, length: int, gram: int, earlier: bool) -> DataFrame:
    """(key, digest, rid, at) of the runs of every document of keyed ``docs``; and, with a
    null digest, the windows [key, at) of rid that the document alone settles, so a
    text that repeats itself a thousand times is a few rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, digests, rids, ats, settled = [], [], [], [], []
            for rid, text in zip(batch["_q_rid"].to_numpy(), batch["text"]):
                raw, size = units.parse(text), units.size
                key, first, last = units.runs(raw, length, gram)
                if not len(key):
                    continue
                view = memoryview(raw)
                ends = (last + length) * size
                digest = np.fromiter(map(xxhash.xxh3_64_intdigest, [view[a:b] for a, b in zip((first * size).tolist(), ends.tolist())]), np.uint64, len(key))
                told, spans = _within(key, digest, first, last, earlier)
                digests.append(digest[told])
                keys.append(key[told])
                rids.append(np.full(len(told), rid, dtype=np.int64))
                ats.append((first << SPAN | (last - first))[told])
                settled += [(a, None, rid, b) for a, b in spans]
            if keys:
                yield pd.DataFrame({"key": _signed(np.concatenate(keys)), "digest": _signed(np.concatenate(digests)), "rid": np.concatenate(rids), "at": np.concatenate(ats)})
            if settled:
                yield pd.DataFrame(settled, columns=["key", "digest", "rid", "at"]).astype({"digest": "Int64"})

    return docs.filter("text IS NOT NULL").select("_q_rid", F.col("text").cast("string").alias("text")).mapInPandas(run, "key long, digest long, rid long, at long")


def contents(docs: DataFrame, classes: DataFrame, units: Units, length: int) -> DataFrame:
    """``classes`` (key, digest, rid, at, more...) with the ``content`` of their stretch, read from the documents."""
    columns = classes.columns
    wanted = cut(classes.groupBy(F.col("rid").alias("_q_rid")).agg(F.collect_list(F.struct(*columns)).alias("_q_wanted")))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, wanted_ in zip(batch["text"], batch["_q_wanted"]):
                raw, size = units.parse(text), units.size
                for row in wanted_:
                    a, b = row["at"] >> SPAN, (row["at"] >> SPAN) + (row["at"] & ((1 << SPAN) - 1))
                    rows.append((*(row[c] for c in columns), bytes(raw[a * size : (b + length) * size])))
            if rows:
                yield pd.DataFrame(rows, columns=[*columns, "content"])

    few = docs.select("_q_rid", F.col("text").cast("string").alias("text")).join(small_side(wanted.select("_q_rid")), "_q_rid", "left_semi")
    return few.dropDuplicates(["_q_rid"]).join(wanted, "_q_rid").select("text", "_q_wanted").mapInPandas(run, f"{kinds}, content binary")


def compared(classes: DataFrame, units: Units, length: int, earlier: bool, max_classes: int = MAX_CLASSES) -> DataFrame:
    """(rid, start, stop): windows [start, stop) of each class' own place that another
    class holds too -- at an earlier place only, if ``earlier``.

    ``classes``: (key, digest, rid, at, m, content), the place being the class' first
    and ``m`` the classes of its key.  Keys of at most ``max_classes`` classes are
    compared where the key's rows lie together; the windows of larger ones are spread
    over the cluster one by one."""
    return _compared_together(classes.filter(F.col("m") <= max_classes), units, length, earlier).unionAll(
        _compared_apart(classes.filter(F.col("m") > max_classes), units, length, earlier)
    )


def _ranges(rid: int, first: int, hit: np.ndarray) -> Iterator[tuple[int, int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    for a, b in zip(edge[::2], edge[1::2]):
        yield rid, first + int(a), first + int(b)


def _compared_together(classes: DataFrame, units: Units, length: int, earlier: bool) -> DataFrame:
    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        each = [units.windows(c, length) for c in rows["content"]]
        counts = np.array([len(e) for e in each])
        flat, owner = np.concatenate(each), np.repeat(np.arange(len(each)), counts)
        if earlier:  # the place's rank among these rows decides
            rank = np.empty(len(rows), dtype=np.int64)
            rank[np.lexsort((rows["at"].to_numpy(), rows["rid"].to_numpy()))] = np.arange(len(rows))
            order = np.lexsort((rank[owner], flat))
            ordered = flat[order]
            hit = np.zeros(len(flat), dtype=bool)
            hit[order[1:]] = ordered[1:] == ordered[:-1]
        else:
            _, inverse, n = np.unique(flat, return_inverse=True, return_counts=True)
            hit = n[inverse] > 1
        ends = np.cumsum(counts)
        out = [
            span
            for rid, at, a, b in zip(rows["rid"].tolist(), rows["at"].tolist(), ends - counts, ends)
            if hit[a:b].any()
            for span in _ranges(rid, at >> SPAN, hit[a:b])
        ]
        return pd.DataFrame(out, columns=["rid", "start", "stop"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None  # the last key's rows may go on in the next batch
        for batch in batches:
            rows = batch if rest is None or not len(rest) else pd.concat([rest, batch], ignore_index=True)
            keys = rows["key"].to_numpy()
            first = int(np.searchsorted(keys, keys[-1]))
            rest = rows.iloc[first:].reset_index(drop=True)
            if first:
                yield settle(rows.iloc[:first])
        if rest is not None and len(rest):
            yield settle(rest)

    return classes.repartition("key").sortWithinPartitions("key").mapInPandas(run, "rid long, start long, stop long")


def _compared_apart(classes: DataFrame, units: Units, length: int, earlier: bool) -> DataFrame:
    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rid, at, content in zip(batch["rid"], batch["at"], batch["content"]):
                each = units.windows(content, length)
                yield pd.DataFrame({"w": _signed(each), "rid": rid, "start": (at >> SPAN) + np.arange(len(each))})

    rows = cut(classes.select("rid", "at", "content").mapInPandas(spread, "w long, rid long, start long"))
    place = F.struct("rid", "start")
    repeated = cut(rows.groupBy("w").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).filter("n > 1").select("w", "first"))
    hits = rows.join(repeated, "w")
    if earlier:
        hits = hits.filter(place > F.col("first"))
    return hits.select("rid", "start", (F.col("start") + 1).alias("stop"))


def stretches(marks: DataFrame) -> DataFrame:
    """(_q_rid, starts, stops) of marks (rid, start, stop), one row per document."""
    return cut(
        marks.groupBy(F.col("rid").alias("_q_rid")).agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("_q_s"))
        .select("_q_rid", F.col("_q_s.start").alias("starts"), F.col("_q_s.stop").alias("stops"))
    )


def covered(starts: np.ndarray, stops: np.ndarray, n: int) -> np.ndarray:
    """Which of n units lie in any [start, stop)."""
    edges = np.zeros(n + 1, dtype=np.int32)
    np.add.at(edges, starts, 1)
    np.add.at(edges, stops, -1)
    return np.cumsum(edges[:-1]) > 0


def with_marks(docs: DataFrame, marks: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Keyed ``docs`` joined with ``stretches``, and the documents without any: those need
    no shuffle where the marked ids are few enough to broadcast (else one left join)."""
    if marks.limit(MAX_BROADCAST_IDS + 1).count() > MAX_BROADCAST_IDS:
        return docs.join(marks, "_q_rid", "left"), None
    ids = F.broadcast(marks.select("_q_rid"))
    return docs.join(ids, "_q_rid", "left_semi").join(marks, "_q_rid"), docs.join(ids, "_q_rid", "left_anti")
