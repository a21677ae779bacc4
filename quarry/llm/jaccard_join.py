"""Near-duplicate join on word shingles by grouped prefixes.

Two documents link when the Jaccard similarity of their sets of five-word shingles is
at least 80 %.  The join is exact:

1. Documents with the same set are one *class* (a map-side combined group by the
   set's 128-bit hash); its smallest row stands for it.
2. Shingles get one total order, the rarer first: by the load of their hash bucket
   (counts over all documents, a table of fixed size), then by hash.  Similar sets must
   share a shingle among the first fifth of the larger and the first ninth of the
   smaller in this order.
3. Classes with identical prefixes and size collapse into one *group*; only groups have
   postings.
4. First round: within a posting list and a size band every group is paired with the
   one that has the shingle earliest, every member with its group's first; the pairs
   that pass the size and position filters are verified on the whole sets, and
   components formed.
5. Second round: what is left are pairs across components.  Lists are reduced to one
   row per component and size, pairs of rows are filtered by size and position,
   expanded to members, filtered again, and verified.  Pairs inside a component need no
   proof, so a large group of near copies is not expanded into all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import windows as win
from quarry.llm.common import cut, small_side, stored
from quarry.llm.components import components
from quarry.llm.substring_dedup import _HASHES

#: Words in a shingle.
SHINGLE = 5

#: Buckets of the load table, and pieces in which tasks report it.
BUCKETS, PIECES = 1 << 20, 64


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles: A-Z lower-cased words, runs of
    anything but space and U+0009..U+000D; fewer than five words are one shingle."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    if len(words) < SHINGLE:
        return win.mix(win.grams(hashes, len(words)), np.array([len(words)], np.uint64))
    return np.unique(win.grams(hashes, SHINGLE))


def least_overlap(n: int, m: int) -> int:
    """Shared shingles from which sets of n and m are linked: 100 * I >= 80 * (n + m - I)."""
    return -(-4 * (n + m) // 9)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    if not len(a) or not len(b):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= 80 * (len(a) + len(b) - both)


def _signatures(docs: DataFrame) -> DataFrame:
    """(rid, n, s, t) of each document: set size and 128-bit hash of the set; and, with
    ``piece`` set, each task's counts of shingle buckets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loads = np.zeros(BUCKETS, np.uint32)
        for batch in batches:
            out = []
            for rid, text in zip(batch["_q_rid"].tolist(), batch["text"]):
                have = shingles(text)
                np.add.at(loads, (have >> np.uint64(44)).astype(np.int64), 1)
                digest = xxhash.xxh3_128_digest(have.tobytes())
                out.append((rid, len(have), *np.frombuffer(digest, "<i8").tolist(), None, None))
            yield pd.DataFrame(out, columns=["rid", "n", "s", "t", "piece", "loads"]).astype({"piece": "Int32"})
        if loads.any():
            size = BUCKETS // PIECES
            parts = [(0, 0, 0, 0, k, loads[k * size : (k + 1) * size].astype("<u4").tobytes()) for k in range(PIECES)]
            yield pd.DataFrame(parts, columns=["rid", "n", "s", "t", "piece", "loads"]).astype({"piece": "Int32"})

    return docs.select("_q_rid", F.col("text").cast("string").alias("text")).mapInPandas(run, "rid long, n long, s long, t long, piece int, loads binary")


def _loads(pieces: DataFrame) -> np.ndarray:
    """The sum of all tasks' bucket counts, BUCKETS numbers whatever the corpus."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, raw in zip(batch["piece"].tolist(), batch["loads"]):
                counts = np.frombuffer(raw, "<u4").astype(np.uint64)
                sums[piece] = sums[piece] + counts if piece in sums else counts
        for piece, counts in sums.items():
            yield pd.DataFrame({"piece": [piece], "loads": [np.minimum(counts, 0xFFFFFFFF).astype("<u4").tobytes()]})

    out = np.zeros(BUCKETS, np.uint32)
    size = BUCKETS // PIECES
    for row in pieces.select("piece", "loads").repartition("piece").mapInPandas(run, "piece int, loads binary").collect():
        out[row["piece"] * size : (row["piece"] + 1) * size] = np.frombuffer(bytes(row["loads"]), "<u4")
    return out


def _prefixes(docs: DataFrame, loads: np.ndarray) -> DataFrame:
    """(rid, n, g, k, prefix): the first shingles in order, and a 128-bit hash of them and the size."""
    sent = docs.sparkSession.sparkContext.broadcast(loads)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = sent.value
        for batch in batches:
            out = []
            for rid, text in zip(batch["_q_rid"].tolist(), batch["text"]):
                have = shingles(text)
                n = len(have)
                order = np.lexsort((have, table[(have >> np.uint64(44)).astype(np.int64)]))
                raw = have[order[: n - -(-4 * n // 5) + 1]].tobytes()
                out.append((rid, n, *np.frombuffer(xxhash.xxh3_128_digest(raw, seed=n), "<i8").tolist(), raw))
            yield pd.DataFrame(out, columns=["rid", "n", "g", "k", "prefix"])

    return docs.select("_q_rid", F.col("text").cast("string").alias("text")).mapInPandas(run, "rid long, n long, g long, k long, prefix binary")


def _postings(groups: DataFrame) -> DataFrame:
    """(h, gid, n, pos) for every prefix shingle of every group."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            each = [np.frombuffer(p, np.int64) for p in batch["prefix"]]
            sizes = [len(e) for e in each]
            if sum(sizes):
                yield pd.DataFrame({
                    "h": np.concatenate(each), "gid": np.repeat(batch["rid"].to_numpy(), sizes), "n": np.repeat(batch["n"].to_numpy(), sizes),
                    "pos": np.concatenate([np.arange(s) for s in sizes]),
                })

    return groups.select("rid", "n", "prefix").mapInPandas(run, "h long, gid long, n long, pos long")


def _verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (u, v) whose whole sets are linked."""
    ids = pairs.select(F.col("u").alias("_q_rid")).unionAll(pairs.select("v")).distinct()
    texts = stored(
        docs.select("_q_rid", F.col("text").cast("string").alias("text")).join(small_side(cut(ids)), "_q_rid", "left_semi").dropDuplicates(["_q_rid"])
    )
    one = pairs.join(texts.select(F.col("_q_rid").alias("u"), F.col("text").alias("a")), "u")
    two = one.join(texts.select(F.col("_q_rid").alias("v"), F.col("text").alias("b")), "v")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: tuple[int, np.ndarray] | None = None
        for batch in batches:
            keep = []
            for v, a, b in zip(batch["v"].tolist(), batch["a"], batch["b"]):
                if last is None or last[0] != v:
                    last = (v, shingles(b))
                keep.append(linked(shingles(a), last[1]))
            yield batch.loc[keep, ["u", "v"]]

    return cut(two.mapInPandas(run, "u long, v long"))


#: Rows (n1, p1) and (n2, p2) of one list, a shingle's position counted from 0, may belong to linked
#: sets: sizes fit, the smaller has it in its first ninth, and what follows it is enough.
FITS = """5 * least(n1, n2) >= 4 * greatest(n1, n2)
  AND if(n1 < n2, p1, if(n1 > n2, p2, least(p1, p2))) <= least(n1, n2) - ceil(8 * least(n1, n2) / 9)
  AND least(n1 - p1, n2 - p2) >= ceil(4 * (n1 + n2) / 9)"""


def _lists(postings: DataFrame) -> DataFrame:
    """The postings that can meet another one: in lists of two at least, and with enough of the
    set left after the shingle even beside the list's smallest set."""
    shared = cut(postings.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("lo")).filter("c > 1").select("h", "lo"))
    return stored(
        postings.join(shared, "h").filter("n - pos >= ceil(4 * (n + greatest(lo, ceil(4 * n / 5))) / 9)").select("h", "gid", "n", "pos")
    )


def _first_pairs(lists: DataFrame, members: DataFrame) -> DataFrame:
    """Every group with one group of each of its lists and size bands, the one that has the
    shingle earliest (fewest rare shingles of its own); every member with its group."""
    banded = lists.withColumn("band", F.floor(F.log("n") / F.log(F.lit(1.25))).cast("int"))
    heads = stored(
        banded.groupBy("h", "band").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("pos", "gid", "n")).alias("head")).filter("c > 1")
        .select("h", "band", F.col("head.gid").alias("u"), F.col("head.n").alias("n1"), F.col("head.pos").alias("p1"))
    )
    across = (
        banded.withColumnsRenamed({"n": "n2", "pos": "p2"}).join(heads, ["h", "band"]).filter("gid <> u").filter(FITS)
        .select("u", F.col("gid").alias("v")).distinct()
    )
    inside = members.filter("rid <> gid").select(F.col("gid").alias("u"), F.col("rid").alias("v"))
    return cut(across.unionAll(inside))


def _second_pairs(lists: DataFrame, members: DataFrame, found: DataFrame, tested: DataFrame) -> DataFrame:
    """Candidate pairs across the components ``found`` so far, without those tested."""
    placed = cut(
        members.join(found.select(F.col("node").alias("rid"), "component"), "rid", "left").select("rid", "gid", "n", F.coalesce("component", "rid").alias("c"))
    )
    # groups whose members fell into several components share their whole prefix
    split = placed.groupBy("gid").agg(F.min("c").alias("a"), F.max("c").alias("b")).filter("a <> b").select("gid")
    parts = placed.join(cut(split), "gid", "left_semi")
    kinds = parts.select("gid", "c").distinct()
    inside = (
        kinds.alias("x").join(kinds.select("gid", F.col("c").alias("d")), "gid").filter("c < d")
        .join(parts.select("gid", "c", F.col("rid").alias("u")), ["gid", "c"])
        .join(parts.select("gid", F.col("c").alias("d"), F.col("rid").alias("v")), ["gid", "d"])
        .select("u", "v")
    )
    every = stored(lists.join(placed.drop("n"), "gid").select("h", "rid", "c", "n", "pos"))
    mixed = cut(every.groupBy("h").agg(F.min("c").alias("a"), F.max("c").alias("b")).filter("a <> b").select("h"))
    mine = stored(every.join(mixed, "h", "left_semi"))
    # one row per list, component and size, with the earliest position: what fits no other row here has no pair
    rows = cut(mine.groupBy("h", "c", "n").agg(F.min("pos").alias("p")))
    pairs = (
        rows.withColumnsRenamed({"n": "n1", "p": "p1"}).join(rows.withColumnsRenamed({"c": "d", "n": "n2", "p": "p2"}), "h")
        .filter("c < d").filter(FITS).select("h", "c", "n1", "d", "n2")
    )
    x = mine.select("h", "c", F.col("rid").alias("u"), F.col("n").alias("n1"), F.col("pos").alias("p1"))
    y = mine.select("h", F.col("c").alias("d"), F.col("rid").alias("v"), F.col("n").alias("n2"), F.col("pos").alias("p2"))
    across = cut(pairs).join(x, ["h", "c", "n1"]).join(y, ["h", "d", "n2"]).filter(FITS).select("u", "v")
    both = across.unionAll(inside).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    return cut(both.join(tested.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), ["u", "v"], "left_anti"))


def _linked_rows(docs: DataFrame) -> DataFrame:
    """(rid, n, component) of keyed ``docs``."""
    signed = stored(_signatures(docs))
    rows = signed.filter("piece IS NULL").select("rid", "n", "s", "t").distinct()
    classes = cut(rows.filter("n > 0").groupBy("s", "t", "n").agg(F.min("rid").alias("first")))
    loads = _loads(signed.filter("piece IS NOT NULL"))
    firsts = docs.join(small_side(classes.select(F.col("first").alias("_q_rid"))), "_q_rid", "left_semi").dropDuplicates(["_q_rid"])
    prefixes = stored(_prefixes(firsts, loads))
    groups = cut(prefixes.groupBy("n", "g", "k").agg(F.min("rid").alias("gid")))
    members = cut(prefixes.select("rid", "n", "g", "k").join(groups, ["n", "g", "k"]).select("rid", "gid", "n"))
    postings = _postings(prefixes.join(small_side(groups.select(F.col("gid").alias("rid"))), "rid", "left_semi"))
    lists = _lists(postings)
    tested = _first_pairs(lists, members)
    edges = _verified(tested, docs)
    late = _verified(_second_pairs(lists, members, components(edges), tested), docs)
    found = components(edges.unionAll(late))
    labelled = cut(
        classes.join(found.select(F.col("node").alias("first"), "component"), "first", "left").select("s", "t", "n", F.coalesce("component", "first").alias("component"))
    )
    return rows.join(labelled, ["s", "t", "n"], "left").select("rid", "n", F.coalesce("component", "rid").alias("component"))


def link(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (the smallest doc_id
    reachable by links, itself included).

    Texts without words, and null texts, have no shingles and link with nothing.  Null
    ids come last in order; rows that share an id are told apart by a hash of the text,
    and rows equal in both are one.  An empty table gives no rows.  Columns other than
    doc_id and text are not read."""
    rows = win.keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    found = cut(_linked_rows(rows))
    names = rows.select("doc_id", "_q_rid")
    out = names.join(found, names["_q_rid"] == found["rid"])
    if _same_ids(names):
        return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    roots = names.distinct().select(F.col("doc_id").alias("component_id"), F.col("_q_rid").alias("component"))
    return out.join(roots, "component").select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def _same_ids(names: DataFrame) -> bool:
    return names.filter(~F.col("doc_id").eqNullSafe(F.col("_q_rid"))).limit(1).count() == 0


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component, the one of smallest id; same columns."""
    rows = win.keyed(docs)
    found = _linked_rows(rows.select(F.col("text").cast("string").alias("text"), "_q_rid"))
    stay = cut(found.filter("rid = component").select(F.col("rid").alias("_q_rid")).distinct())
    return rows.join(small_side(stay), "_q_rid", "left_semi").dropDuplicates(["_q_rid"]).select(*docs.columns)
