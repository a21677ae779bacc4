"""HTML extraction: the main text of web pages by minimum-cut labelling.

Each page is a graph of its blocks (``html_blocks``).  A classifier gives every block the
log-odds of being content: the prior of the elements, roles and class words around it, plus a
logistic score of the text itself (length, links, punctuation, ...).  The cost of either label
is a terminal capacity.  Smoothness edges join neighbours in page order and blocks under one
parent; they weaken with the distance in the element tree and with a change of the prior.
The maximum flow from the content to the boilerplate terminal separates the labels at least
total cost; blocks on the content side, in page order, are the text.

The logistic weights are trained on the pages themselves: the blocks of at most ``SAMPLE_PAGES``
pages whose prior settles them (inside an article, or inside a menu, footer and the like) are the
examples.  Only that fit is bounded; every page is extracted whole, in the task that read it.

Results: one row per page, repeated rows included.  Null, empty and blank html, and a page without
content, give the empty text.  A block of equal cost on both sides is boilerplate.  Of the page
table only page_id, url and html are read, so other columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.html_blocks import HEADINGS, Block, blocks

#: Bounds of the fit: pages sampled in hash order, and the longest page taken for it.
SAMPLE_PAGES, SAMPLE_CHARS = 400, 65_536
#: A block whose prior reaches this far to either side is an example of the fit.
SETTLED = 3.0
#: The text's score cannot outweigh what the page's own markup says clearly.
SCORE_LIMIT = 2.0
#: Capacity of an edge between neighbours and between children of one parent, in nats.
ADJACENT, SAME_PARENT = 1.0, 0.5
_UNIT = 1000  # capacities are whole thousandths of a nat

#: Weights where the pages hold no settled example of both kinds: constant, then ``_features``.
DEFAULT_WEIGHTS = (-1.0, 0.6, -4.0, 1.0, 0.5, 0.3, -0.5, -1.5)
WEIGHTS = len(DEFAULT_WEIGHTS)


def _features(b: Block) -> tuple[float, ...]:
    n, words = len(b.text), b.text.count(" ") + 1
    return (
        1.0,
        math.log1p(words),
        b.in_links / n,
        1.0 if b.text[-1] in ".!?…。！？\"”»" else 0.0,
        min(b.text.count(",") / words, 0.5),
        1.0 if b.element in HEADINGS else 0.0,
        1.0 if b.element == "li" else 0.0,
        1.0 if "©" in b.text or "|" in b.text or "·" in b.text else 0.0,
    )


def log_odds(page: list[Block], weights: tuple[float, ...]) -> list[float]:
    """Content against boilerplate for each block: its prior and the limited score of its text."""
    return [b.prior + max(-SCORE_LIMIT, min(SCORE_LIMIT, sum(map(float.__mul__, _features(b), weights)))) for b in page]


def edges(page: list[Block]) -> list[tuple[int, int, int]]:
    """(block, later block, capacity): neighbours, and a block with the one before under its parent."""
    out, last = [], {}
    for i, b in enumerate(page):
        j = last.get(b.parent)
        last[b.parent] = i
        for k, strength, apart in ((i - 1, ADJACENT, max(0, b.apart - 2)), (j, SAME_PARENT, 0)):
            if k is not None and k >= 0:
                cap = int(_UNIT * strength * math.exp(-abs(b.prior - page[k].prior) / 2) / (1 + apart / 2))
                if cap:
                    out.append((k, i, cap))
    return out


def min_cut(gain: list[int], links: list[tuple[int, int, int]]) -> list[bool]:
    """The blocks on the source side of a minimum cut.  ``gain``: capacity from the source less
    capacity to the sink (their common part flows straight through).  Dinic's method."""
    n = len(gain)
    near: list[list[int]] = [[] for _ in range(n)]
    to: list[int] = []
    room: list[int] = []
    for a, b, cap in links:
        near[a].append(len(to))
        near[b].append(len(to) + 1)
        to += (b, a)
        room += (cap, cap)
    left = list(gain)
    while True:
        level = [-1] * n
        front = [i for i in range(n) if left[i] > 0]
        for i in front:
            level[i] = 0
        reached, depth = False, 0
        while front and not reached:
            depth += 1
            nxt = []
            for i in front:
                for e in near[i]:
                    j = to[e]
                    if room[e] and level[j] < 0:
                        level[j] = depth
                        reached = reached or left[j] < 0
                        nxt.append(j)
            front = nxt
        if not reached:
            return [x >= 0 for x in level]
        turn = [0] * n
        for start in range(n):
            while level[start] == 0 and left[start] > 0:
                path, at = [], start
                while True:
                    if left[at] < 0:
                        push = min(left[start], -left[at], min(room[e] for e in path))
                        for e in path:
                            room[e] -= push
                            room[e ^ 1] += push
                        left[start] -= push
                        left[at] += push
                        break
                    if turn[at] < len(near[at]):
                        e = near[at][turn[at]]
                        if room[e] and level[to[e]] == level[at] + 1:
                            path.append(e)
                            at = to[e]
                        else:
                            turn[at] += 1
                    elif path:
                        at = to[path.pop() ^ 1]
                        turn[at] += 1
                    else:
                        break
                if not path:
                    break


def content(page: list[Block], weights: tuple[float, ...]) -> list[bool]:
    """Which blocks of a page are main content."""
    return min_cut([round(_UNIT * z) for z in log_odds(page, weights)], edges(page))


def _fit(x: np.ndarray, y: np.ndarray, l2: float = 1.0) -> tuple[float, ...]:
    """Logistic regression by Newton steps, both classes with equal weight."""
    per_row = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (per_row * (y - p)) - l2 * w
        hess = (x * (per_row * p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def fit(pages: DataFrame, *, sample_pages: int = SAMPLE_PAGES, sample_chars: int = SAMPLE_CHARS) -> tuple[float, ...]:
    """Weights of the text score from at most ``sample_pages`` pages of at most ``sample_chars``
    characters, taken in hash order of url and html.  The driver receives sums of features of the
    settled blocks, grouped to their distinct values."""

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(b.prior > 0, _features(b)) for html in batch.column(0).to_pylist() for b in blocks(html) if abs(b.prior) >= SETTLED]
            yield pa.RecordBatch.from_arrays(
                [pa.array([y for y, _ in found], pa.bool_()), pa.array([list(f) for _, f in found], pa.list_(pa.float64()))], names=["y", "x"]
            )

    h = F.xxhash64("url", "html")
    taken = pages.filter(F.length("html") <= sample_chars).select("html", h.alias("_q_h")).orderBy("_q_h").limit(sample_pages).select("html")
    rows = taken.mapInArrow(examples, "y boolean, x array<double>").groupBy("y", "x").count().orderBy("y", "x").collect()
    if len({r["y"] for r in rows}) < 2:
        return DEFAULT_WEIGHTS
    times = [r["count"] for r in rows]
    x = np.repeat(np.array([r["x"] for r in rows]), times, axis=0)
    return _fit(x, np.repeat(np.array([float(r["y"]) for r in rows]), times))


def extract(pages: DataFrame, *, weights: tuple[float, ...] | None = None, batch_chars: int = 4_000_000) -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks, n_content) for every row of ``pages``: the content
    blocks joined by two newlines, and how many blocks the page has and keeps.
    A task works through its rows in slices of about ``batch_chars`` characters of html."""
    w = fit(pages) if weights is None else tuple(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(lo: int, hi: int, batch: pa.RecordBatch, rows: list) -> pa.RecordBatch:
            cols = [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo)]
            return pa.RecordBatch.from_arrays(
                [*cols, pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())],
                names=["page_id", "url", "text", "n_blocks", "n_content"],
            )

        for batch in batches:
            lo, chars, rows = 0, 0, []
            for i in range(batch.num_rows):
                html = batch.column(2)[i].as_py()
                page = blocks(html)
                kept = [b.text for b, keep in zip(page, content(page, w)) if keep]
                rows.append(("\n\n".join(kept), len(page), len(kept)))
                chars += len(html or "")
                if chars >= batch_chars:
                    yield flush(lo, i + 1, batch, rows)
                    lo, chars, rows = i + 1, 0, []
            if rows:
                yield flush(lo, batch.num_rows, batch, rows)

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    out = pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_blocks long, n_content long")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_blocks", "n_content")


def labelled_blocks(pages: DataFrame, *, weights: tuple[float, ...] | None = None) -> DataFrame:
    """(page_id, block, element, text, log_odds, content): every block with its classifier
    score and the label of the cut, for inspection and for other assemblies of the page."""
    w = fit(pages) if weights is None else tuple(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(
                chain.from_iterable(
                    [(i, n, b.element, b.text, z, keep) for n, (b, z, keep) in enumerate(zip(page, log_odds(page, w), content(page, w)))]
                    for i, page in enumerate(map(blocks, batch.column(1).to_pylist()))
                )
            )
            cols = list(zip(*rows)) or [()] * 6
            kinds = [pa.int32(), pa.string(), pa.string(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(cols[0], pa.int64())), *(pa.array(c, k) for c, k in zip(cols[1:], kinds))],
                names=["page_id", "block", "element", "text", "log_odds", "content"],
            )

    kind = dict(pages.dtypes)["page_id"]
    return pages.select("page_id", "html").mapInArrow(run, f"page_id {kind}, block int, element string, text string, log_odds double, content boolean")
