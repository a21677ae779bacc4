"""Benchmark decontamination with one Aho-Corasick automaton.

Every window of ten consecutive words of the test items becomes a pattern of one
automaton over normalised text (words joined by one space).  Each document is
normalised, scanned once, and the hits are mapped back: from normalised offsets to
word numbers and, for documents with hits, to character offsets of the original.

The items are sent to the executors in chunks of at most ``max_item_chars``
characters, so the broadcast and the automaton are bounded; with more than one
chunk a batch of rows is scanned by one automaton after the other where it lies, and
the word ranges of each row are united there.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import only, remembers

#: Words in a window.
WINDOW = 10

#: Characters of test items in one automaton.  Windows overlap, so it has some ten nodes
#: for each: about 100 MB in a worker at this bound.
MAX_ITEM_CHARS = 250_000

#: A word: ASCII letters and digits, and everything beyond ASCII.
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")

_TO_BLANK = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def normalise(text: str) -> bytes:
    """Lower-cased (A-Z) words of the text in UTF-8, one space before, between and after."""
    words = text.encode("utf-8", "surrogatepass").lower().translate(_TO_BLANK).split(b" ")
    return b" " + b" ".join([w for w in words if w]) + b" "


def patterns(items: list[tuple[str, str | None]], window: int = WINDOW) -> dict[str, set[str]]:
    """Window -> ids of the items that hold it; windows as bytes read as Latin-1."""
    found: dict[str, set[str]] = {}
    for item_id, text in items:
        words = normalise(text or "").decode("latin-1").split(" ")[1:-1]
        if not words or words == [""]:
            continue
        for i in range(max(1, len(words) - window + 1)):
            found.setdefault(" " + " ".join(words[i : i + window]) + " ", set()).add(item_id)
    return found


def automaton(items: list[tuple[str, str | None]], window: int = WINDOW) -> ahocorasick.Automaton:
    built = ahocorasick.Automaton()
    for pattern, ids in patterns(items, window).items():
        built.add_word(pattern, (len(pattern) - 1, pattern.count(" ") - 1, ids))
    if len(built):
        built.make_automaton()
    return built


_BUILT: dict[object, ahocorasick.Automaton] = {}
remembers("automaton", _BUILT.clear)


def scan(text: str | None, find: ahocorasick.Automaton) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Words in the text, merged ranges [first, end) of hit words, and the items found."""
    if not text:
        return 0, [], set()
    flat = normalise(text).decode("latin-1")
    n = max(0, flat.count(" ") - 1) if len(flat) > 2 else 0
    if not n or not len(find):
        return n, [], set()
    ranges: list[list[int]] = []
    ids: set[str] = set()
    starts: list[int] | None = None
    for end, (length, words, found) in find.iter(flat):
        if starts is None:
            starts = [m.start() for m in re.finditer(" ", flat)]  # word k follows the k-th space
        first = bisect_left(starts, end - length)
        ids |= found
        while ranges and ranges[-1][0] >= first:
            first, words = first, max(words, ranges.pop()[1] - first)
        if ranges and ranges[-1][1] >= first:
            ranges[-1][1] = max(ranges[-1][1], first + words)
        else:
            ranges.append([first, first + words])
    return n, [(a, b) for a, b in ranges], ids


def _sent(docs: DataFrame, chunks: Iterator[list[tuple[str, str | None]]], window: int) -> tuple[list, list]:
    """The chunks of items as broadcasts, and the names under which their automata are remembered."""
    sent, tokens = [], []
    for number, items in enumerate(chunks):
        sent.append(docs.sparkSession.sparkContext.broadcast(items))
        tokens.append((id(sent[-1]), number, hashlib.sha1(repr(items).encode("utf-8", "surrogatepass")).hexdigest(), window))
    return sent, tokens


def _automaton(sent: list, tokens: list, k: int, window: int) -> ahocorasick.Automaton:
    """The automaton of a chunk; a worker holds one at a time."""
    if tokens[k] not in _BUILT:
        _BUILT.clear()
        _BUILT[tokens[k]] = automaton(sent[k].value, window)
    return _BUILT[tokens[k]]


def _hits(docs: DataFrame, chunks: Iterator[list[tuple[str, str | None]]], window: int) -> DataFrame:
    """A batch of rows stays in place while the chunks' automata pass over it, one in memory at a time."""
    sent, tokens = _sent(docs, chunks, window)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        only("automaton")
        order = list(range(len(sent)))
        for batch in batches:
            texts = batch["text"].tolist()
            found: list[tuple[int, list[tuple[int, int]], set[str]]] = [(0, [], set())] * len(texts)
            for k in order:
                find = _automaton(sent, tokens, k, window)
                for i, text in enumerate(texts):
                    n, ranges, ids = scan(text, find)
                    found[i] = (n, _merged(found[i][1], ranges), found[i][2] | ids)
            order.reverse()  # the next batch begins with the automaton at hand
            rows = []
            for doc_id, text, (n, ranges, ids) in zip(batch["doc_id"].array, texts, found):
                spans: list[tuple[int, int]] = []
                if ranges:
                    places = [m.span() for m in WORD.finditer(text.translate(_LOWER))]
                    spans = [(places[a][0], places[b - 1][1]) for a, b in ranges]
                rows.append((
                    None if pd.isna(doc_id) else int(doc_id), n, [a for a, _ in ranges], [b for _, b in ranges],
                    [a for a, _ in spans], [b for _, b in spans], sorted(ids),
                ))
            yield pd.DataFrame(rows, columns=["doc_id", "n_words", "word_from", "word_to", "char_from", "char_to", "items"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(
        run,
        "doc_id long, n_words long, word_from array<long>, word_to array<long>, char_from array<long>, char_to array<long>, items array<string>",
    )


def _merged(some: list[tuple[int, int]], more: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Both lists of ranges as one, overlapping and touching ranges united as ``scan`` does."""
    if not some or not more:
        return some or more
    out: list[tuple[int, int]] = []
    for a, b in sorted(some + more):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}


def _chunks(benchmark: DataFrame, max_item_chars: int) -> Iterator[list[tuple[str, str | None]]]:
    """The items in lists of at most ``max_item_chars`` characters (or one longer item), one list at a time."""
    chunk: list[tuple[str, str | None]] = []
    held = 0
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.col("text").cast("string")).filter("text is not null")
    for item_id, text in rows.distinct().toLocalIterator():
        if chunk and held + len(text) > max_item_chars:
            yield chunk
            chunk, held = [], 0
        chunk.append((item_id, text))
        held += len(text)
    yield chunk


def find(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, max_item_chars: int = MAX_ITEM_CHARS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, word_from / word_to (merged hit
    word ranges, end exclusive), char_from / char_to (the same as character offsets
    of the original text), items (sorted ids of items with a window here).

    Null texts have no words; a null item_id is listed as the empty string; items
    without words match nothing; an item shorter than the window matches as a whole.
    Repeated rows each give a row.  Empty ``docs`` give no rows, an empty benchmark
    no hits.  Columns other than doc_id, item_id and text are not read."""
    return _hits(docs, _chunks(benchmark, max_item_chars), window)


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the character spans."""
    hit = F.aggregate(F.zip_with("word_to", "word_from", lambda b, a: b - a), F.lit(0).cast("long"), lambda s, x: s + x)
    return find(docs, benchmark, **options).select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("items") > 0).alias("contaminated"), "char_from", "char_to",
    )


def remove(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that hold a window of a test item; same columns, rows in place.  A null
    or empty text holds none and stays, repeated rows are judged alike, an empty benchmark removes nothing."""
    # scanned beside the other columns, so that no text has to meet its verdict in a shuffle
    window = options.get("window", WINDOW)
    sent, tokens = _sent(docs, _chunks(benchmark, options.get("max_item_chars", MAX_ITEM_CHARS)), window)
    if not sent:
        return docs

    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        only("automaton")
        order = list(range(len(sent)))
        for texts in batches:
            left = pd.Series(True, index=texts.index)
            for k in order:  # a text that one automaton has found needs no other
                find = _automaton(sent, tokens, k, window)
                left &= pd.Series([keep and not scan(t, find)[2] for keep, t in zip(left, texts)], index=texts.index, dtype=bool)
            order.reverse()
            yield left

    return docs.filter(clean(F.col("text").cast("string")))
