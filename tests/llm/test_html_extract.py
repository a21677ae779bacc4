"""HTML extraction: hand-made pages, the cut against enumeration, and the odd cases."""

from __future__ import annotations

import itertools
import random

import pytest

from quarry.llm import html_extract as H
from quarry.llm.html_blocks import blocks
from quarry.llm.queries import QUERIES

LONG = "The committee met on Tuesday, after long talks, and agreed that the old bridge should be repaired before the winter begins."

PAGES = {
    "plain": ("<html><body><nav><ul><li><a href=/>Home</a></li><li><a href=/b>News</a></li></ul></nav>"
              f"<article><h1>Old &amp; new</h1><p>{LONG}</p><p>Short.</p></article><footer>&copy; 2024</footer></body></html>",
              ["Old & new", LONG, "Short."]),
    "broken markup": (f"<body><div class=ad>Buy now</div><article><p><b>{LONG}<br><p>Second\n\t one.</p></b><p>Third &lt;ok&gt; &#233;&eacute;&amp",
                      [LONG, "Second one.", "Third <ok> éé&"]),
    "scripts": (f"<head><title>T</title><style>p > a {{}}</style><script>var t='</p><p>no</p>';</script></head><main><p>{LONG}</p>"
                f"<script>if (a<b && c>d) document.write('<p>no</p>');</script><!-- <p>no</p> --><p>{LONG}</p></main><noscript>no</noscript>", [LONG, LONG]),
    "unclosed comment and script": (f"<article><p>{LONG}</p></article><!-- never closed <p>no</p>", [LONG]),
    "comments in the article": (f"<article><header><h1>Title here</h1></header><p>{LONG}</p><section id='comments'><h2>Comments</h2><article class='comment'><p>{LONG} I agree.</p></article>"
                                "</section></article>", ["Title here", LONG]),
    "class names only": (f"<div id=header><h1>Site name</h1></div><div class='top menu'><a href=a>One</a> <a href=b>Two</a></div><div class='post-content'><h2>Head</h2><p>{LONG}</p><p>{LONG}</p></div>"
                         f"<div class='sidebar'><p>Popular now</p></div><div class='cookie-notice'>We use cookies. Accept?</div>", ["Head", LONG, LONG]),
    "no hints at all": (f"<table><tr><td><a href=a>One</a><td><a href=b>Two</a></table><p>{LONG}</p><p>{LONG}</p><div><a href=x>Terms</a> | <a href=y>Contact</a></div>", [LONG, LONG]),
    "form, aside, hidden": (f"<main><p>{LONG}</p><aside>Related: <a href=q>this</a></aside><form><label>Your mail</label><input><button>Send</button></form><p hidden>secret</p>"
                            f"<div role='dialog'>Log in</div><p>{LONG}</p></main>", [LONG, LONG]),
    "inline tags": ("<article><p>A<i>b</i>c <a href=x>link</a>, d<!-- x -->e, and the rest of a sentence that goes on for some while.</p><ul><li>first thing to do<li>second thing to do</ul></article>",
                    ["Abc link, de, and the rest of a sentence that goes on for some while.", "first thing to do", "second thing to do"]),
    "quotes in attributes": (f"<article data-x=\"a>b\" title='it\"s'><p class=x'y>{LONG}</p></article>", [LONG]),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    html, want = PAGES[name]
    page = blocks(html)
    assert [b.text for b, keep in zip(page, H.content(page, H.DEFAULT_WEIGHTS)) if keep] == want


def test_min_cut_is_minimal():
    r = random.Random(5)
    for _ in range(300):
        n = r.randint(1, 8)
        gain = [r.randint(-9, 9) for _ in range(n)]
        links = [(i - 1, i, r.randint(0, 6)) for i in range(1, n)] + [(r.randrange(n), r.randrange(n), r.randint(0, 4)) for _ in range(r.randint(0, 5))]
        links = [x for x in links if x[0] != x[1]]

        def cost(side):
            return sum(max(g, 0) if not s else max(-g, 0) for g, s in zip(gain, side)) + sum(c for a, b, c in links if side[a] != side[b])

        least = min(cost(s) for s in itertools.product([False, True], repeat=n))
        side = H.min_cut(gain, links)
        assert cost(side) == least
        # of the minimum cuts the one with the fewest blocks of content
        assert sum(side) == min(sum(s) for s in itertools.product([False, True], repeat=n) if cost(s) == least)


def test_smoothness_changes_labels():
    page = blocks(f"<div><p>{LONG}</p><p>Yes</p><p>{LONG}</p></div>")
    alone = [z > 0 for z in H.log_odds(page, H.DEFAULT_WEIGHTS)]
    assert alone == [True, False, True] and H.content(page, H.DEFAULT_WEIGHTS) == [True, True, True]


def test_long_page_stays_linear():
    page = blocks("<article>" + f"<p>{LONG}</p><div class=ad>Buy</div>" * 5_000 + "</article>" + "<div><span" * 5_000 + "=\"" * 2_000)
    keep = H.content(page, H.DEFAULT_WEIGHTS)
    assert sum(keep) == 5_000 and all(k == (b.element == "p") for b, k in zip(page, keep) if b.text in (LONG, "Buy"))


def test_extract_odd_rows(spark):
    rows = [(1, "u", PAGES["plain"][0], 9, "x"), (1, "u", PAGES["plain"][0], 9, "x"), (None, None, None, 9, "y"), (2, "v", "", 9, "z"), (3, None, " \n", 9, None),
            (4, "w", "no markup at all", None, None), (5, "w", "<article><p>" + "word " * 300_000 + "</p>", None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int, n_chars string")
    got = sorted((tuple(r) for r in H.extract(pages).select("page_id", "url", "text", "n_chars", "n_blocks").collect()), key=str)
    plain = "\n\n".join(PAGES["plain"][1])
    assert (None, None, "", 0, 0) in got and (2, "v", "", 0, 0) in got and (3, None, "", 0, 0) in got
    assert got.count((1, "u", plain, len(plain), 6)) == 2
    assert [len(r[2]) for r in got if r[0] == 5] == [300_000 * 5 - 1]
    assert H.extract(pages.limit(0)).count() == 0
    shown = H.labelled_blocks(pages.filter("page_id = 1").limit(1), weights=H.DEFAULT_WEIGHTS).orderBy("block").collect()
    assert [r["content"] for r in shown] == [False, False, True, True, True, False]


def test_query_keeps_the_articles(spark):
    """The generated pages have one article each; all of it is kept and nothing else."""
    import re
    from html import unescape

    d = "/root/testdata/sf0.001"
    html = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    got = QUERIES["op11_html_extract"](spark, d).collect()
    assert {r["page_id"] for r in got} == set(html) and len(got) == len(html)
    for r in got:
        article = html[r["page_id"]].split("<article>")[1].split("</article>")[0]
        parts = re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1)>", "\0", article.replace("<br>", " "))).split("\0")
        want = "\n\n".join(x for x in (" ".join(unescape(p).split()) for p in parts) if x)
        assert r["text"] == want and r["n_chars"] == len(want)


def test_fit_is_repeatable(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    assert H.fit(pages) == H.fit(pages.repartition(7)) and H.fit(pages.limit(0)) == H.DEFAULT_WEIGHTS
