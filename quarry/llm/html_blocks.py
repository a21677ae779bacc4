"""Blocks of one page of HTML: a small per-row helper of ``html_extract``.

A forgiving scan in one pass and linear time.  An element that is not phrasing content
starts and ends a block; a line break is white space inside one.  Each block knows its
white-space-normalised text, the characters of it inside links, its element, and a prior:
the sum of what its ancestors say (fixed values below).
"""

from __future__ import annotations

import re
from html import unescape
from typing import NamedTuple

# Element names of HTML.
PHRASING = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd map mark meter nobr picture progress q rb rp rt ruby s samp small span strike strong sub sup time tt u var".split()
)
VOID = frozenset("area base basefont br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
NEVER = frozenset("head script style textarea title xmp iframe noembed noframes noscript template svg math object audio video canvas map select datalist button".split())
ENDED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th")}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

# Log-odds for main content of an element, of an ARIA role, and of a word of a class or id.
ARTICLE, HIDDEN = 3.0, -6.0
ELEMENT = {"nav": -6.0, "footer": -6.0, "aside": -5.0, "header": -4.0, "form": -2.0, "dialog": -6.0, "menu": -6.0, "label": -3.0, "legend": -3.0, "address": -1.0}
ROLE = {
    "navigation": -6.0, "banner": -4.0, "contentinfo": -6.0, "complementary": -5.0, "search": -6.0, "form": -2.0, "alert": -6.0, "alertdialog": -6.0, "dialog": -6.0,
    "menu": -6.0, "menubar": -6.0, "toolbar": -6.0, "tablist": -4.0, "status": -4.0,
}
HINT = {
    -6.0: "ad ads adv advert adverts advertisement advertising adsense advertorial dfp sponsor sponsored promo promos promotion banner comment comments disqus respond replies reply discussion "
          "cookie cookies consent gdpr notice notices notification notifications popup modal overlay nav navbar navigation navi menu menus breadcrumb breadcrumbs pagination pager footer",
    -5.0: "sidebar sidebars aside rail widget widgets related recommended recommendation recommendations trending popular newsletter subscribe subscription signup signin login paywall "
          "share sharing social follow copyright colophon legal alert announcement skip tags search searchbox outbrain taboola",
    -4.0: "header masthead topbar toolbar",
}
HINTS = {word: weight for weight, words in HINT.items() for word in words.split()}
HINT_STEMS = ("comment", "advert", "sidebar", "navbar", "cookie", "newsletter", "breadcrumb", "sponsor", "footer", "pagination", "disqus")
GOOD_HINTS = frozenset("content article articlebody post entry story main maincontent body text prose".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z)", re.S
)
_ATTR = re.compile(r"([^\s=/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_HINT_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RAW_END = {name: re.compile(rf"</{name}(?![^\s/>])[^>]*>?", re.I) for name in RAW}
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Block(NamedTuple):
    text: str
    in_links: int  # characters of the text inside links
    element: str
    prior: float
    parent: int  # number of the element around its own
    apart: int  # steps in the element tree from the block before


class _Open(NamedTuple):
    name: str
    number: int
    prior: float
    inside: bool  # inside an article or main element that is not itself part of something else
    dropped: bool


def _hint(words: str) -> float:
    low = [w.lower() for w in _HINT_WORD.findall(words)]
    worst = min((HINTS.get(w, -6.0 if w.startswith(HINT_STEMS) else 0.0) for w in low), default=0.0)
    good = any(w in GOOD_HINTS for w in low)
    if worst:
        return 0.0 if good else worst
    return 1.5 if good else 0.0


def _opened(name: str, attrs: str, up: _Open, number: int) -> _Open:
    """The state below a start tag, from the state above it."""
    weight, inside, main = ELEMENT.get(name, 0.0), up.inside, name in ("article", "main")
    if name == "header" and inside:
        weight = 0.0  # an article's own header holds its title
    if "=" in attrs or "hidden" in attrs:
        found = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(attrs)}
        role = (found.get("role") or "").lower()
        main = main or role in ("article", "main")
        named = f"{found.get('class') or ''} {found.get('id') or ''}"
        said = min(ROLE.get(role, 0.0), _hint(named) if name not in ("html", "body") and len(named) > 1 else 0.0, key=lambda w: (w >= 0, -abs(w)))
        if inside and "header" in named.lower() and said == -4.0:
            said = 0.0
        weight = min(weight, said) if min(weight, said) < 0 else max(weight, said)
        if re.search(r"\bhidden\b", _ATTR.sub("", attrs)) or (found.get("aria-hidden") or "").lower() == "true" or _UNSEEN.search(found.get("style") or ""):
            weight = min(weight, HIDDEN)
    if main and weight >= 0 and not inside and up.prior > -3.0:
        weight, inside = weight + ARTICLE, True
    return _Open(name, number, max(-12.0, min(6.0, up.prior + weight)), inside, up.dropped or name in NEVER)


def blocks(html: str | None) -> list[Block]:
    """The blocks of a page in page order; none for null or empty.  Ends without a start are
    ignored, open elements end with their parent or the page, a quote or comment that is not
    closed ends with the tag or the page."""
    if not html:
        return []
    out: list[Block] = []
    top = _Open("", 0, 0.0, False, False)
    stack, still_open = [top], {}
    numbers = deep_before = 0
    low = 1  # the shallowest the stack has been since the block before
    pieces: list[str] = []
    linked: list[int] = []
    in_link = False

    def close_block() -> None:
        nonlocal low, deep_before
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                here, deep = stack[-1], len(stack)
                apart = deep_before + deep - 2 * min(low, deep) if out else 0
                out.append(Block(text, min(sum(linked), len(text)), here.name, here.prior, stack[-2].number if deep > 1 else 0, apart))
                deep_before = low = deep
            pieces.clear()
            linked.clear()

    def pop() -> None:
        nonlocal low
        gone = stack.pop()
        still_open[gone.name] -= 1
        low = min(low, len(stack))

    def put(raw: str) -> None:
        if not stack[-1].dropped:
            text = unescape(raw) if "&" in raw else raw
            pieces.append(text)
            if in_link:
                linked.append(len(text.strip()))

    at, end = 0, len(html)
    while at < end:
        m = _TAG.search(html, at)
        if m is None:
            put(html[at:])
            break
        if m.start() > at:
            put(html[at : m.start()])
        at = m.end()
        name = m.group(2)
        if name is None:
            continue
        name = name.lower()
        if m.group(1):
            if name == "a":
                in_link = False
            elif name not in PHRASING and name not in VOID:
                close_block()
                if still_open.get(name):
                    in_link = False
                    while stack[-1].name != name:
                        pop()
                    pop()
            continue
        if name == "a":
            in_link = True
            continue
        if name in PHRASING:
            continue
        if name in VOID:
            if name == "hr":
                close_block()
            elif name == "br":
                pieces.append(" ")
            continue
        close_block()
        in_link = False
        if name in RAW:
            shut = _RAW_END[name].search(html, at)
            at = shut.end() if shut else end
            continue
        if stack[-1].name == "p":
            pop()
        while stack[-1].name in ENDED_BY.get(name, ()):
            pop()
        if name == "body" and still_open.get("head"):
            while stack[-1].name != "head":
                pop()
            pop()
        numbers += 1
        stack.append(_opened(name, m.group(3), stack[-1], numbers))
        still_open[name] = still_open.get(name, 0) + 1
    close_block()
    return out
