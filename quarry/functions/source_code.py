"""Small per-row helpers for Go and HCL texts: their tokens, and the layout of an HCL body.

``go_tokens`` and ``hcl_tokens`` only tell words, brackets, line ends, strings and comments apart; what
the tokens mean (matching brackets, declarations, blocks, attributes, line ranges) is worked out
in Spark (``operators.blocks``).  Positions are character offsets of the text.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

WORD, OPEN, CLOSE, NEWLINE, STRING, SIGN, COMMENT = "w", "o", "c", "n", "s", "p", "#"


class Token(NamedTuple):
    kind: str
    text: str
    pos: int
    end: int
    line: int
    line_from: int  # offset of the line's first character
    lead: str  # comments between the token before and this one
    alone: bool  # nothing but blanks before it on its line


# Groups in the order of the kinds: comment, string, word, open, close, newline, any other sign.
_GO_TOKEN = re.compile(r"""(//[^\n]*|/\*.*?\*/)|("(?:\\.|[^"\\\n])*"|`[^`]*`|'(?:\\.|[^'\\\n])*')|(\w+)|([{(\[])|([})\]])|(\n)|(\S)""", re.S)
_KINDS = (COMMENT, STRING, WORD, OPEN, CLOSE, NEWLINE, SIGN)


def _placed(src: str, found: Iterator[tuple[str, int, int]]) -> Iterator[Token]:
    """Tokens with their lines; a comment is a token and also the lead of the next other one."""
    breaks = [m.start() for m in re.finditer("\n", src)]
    lead, last = "", -1
    for kind, pos, end in found:
        n = bisect_right(breaks, pos - 1)
        start = breaks[n - 1] + 1 if n else 0
        yield Token(kind, src[pos:end], pos, end, n + 1, start, "" if kind == COMMENT else lead, last <= start)
        last = end
        lead = lead + src[pos:end] if kind == COMMENT else ""


def go_tokens(src: str) -> Iterator[tuple[str, str, int, int, int, int, int]]:
    """(kind, text, pos, end, line, doc_line, doc_from) of the tokens that are no comments; of a string only its
    last quote is the text.  The run of lines that hold a // comment alone and ends right above a token's line
    begins at ``doc_line`` and offset ``doc_from`` (without one: the token's own line)."""
    line, line_from, last = 1, 0, -1
    noted, note = -1, (0, 0)  # the last such line, where its run begins
    for m in _GO_TOKEN.finditer(src):
        group = m.lastindex
        pos, end = m.span()
        if group > 2:
            doc_line, doc_from = note if noted == line - 1 else (line, line_from)
            yield _KINDS[group - 1], m.group(), pos, end, line, doc_line, doc_from
            if group == 6:
                line, line_from = line + 1, end
        else:
            if group == 2:
                doc_line, doc_from = note if noted == line - 1 else (line, line_from)
                yield STRING, src[end - 1], pos, end, line, doc_line, doc_from
            elif src.startswith("//", pos) and last <= line_from:
                if noted != line - 1:
                    note = line, line_from
                noted = line
            if breaks := src.count("\n", pos, end):
                line, line_from = line + breaks, src.rfind("\n", pos, end) + 1
        last = end


# --------------------------------------------------------------------------- HCL

_HCL_TOKEN = re.compile(r'"|#[^\n]*|//[^\n]*|/\*.*?\*/|<<[-~]?(\w+)[ \t]*\n', re.S)
_HCL_IN_STRING = re.compile(r'\\.|\$\$\{|%%\{|[$%]\{|"|\n', re.S)
_HCL_PLAIN = re.compile(r"([A-Za-z_][\w-]*)|([{(\[])|([})\]])|(\n)|([=!<>]=|=>|[^\s])")
_HCL_ATTR = re.compile(r"([A-Za-z_][\w-]*)[ \t]*=(?![=>])[ \t]*")


def _fill(text: str, char: str) -> str:
    return re.sub(r"[^\n]", char, text)


def _string_end(src: str, at: int) -> int:
    """After the closing quote of the string that opens at ``at``; templates may hold strings."""
    i = at + 1
    while m := _HCL_IN_STRING.search(src, i):
        i = m.end()
        if m.group() == '"':
            return i
        if m.group() == "\n":
            return m.start()
        if m.group() in ("${", "%{"):
            depth = 1
            while depth and i < len(src):
                depth += {"{": 1, "}": -1}.get(src[i], 0)
                i = _string_end(src, i) if src[i] == '"' else i + 1
    return len(src)


def _hcl_masked(src: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of the strings, heredocs and comments."""
    i = 0
    while m := _HCL_TOKEN.search(src, i):
        if m.group() == '"':
            i = _string_end(src, m.start())
        elif m.group(1):
            end = re.compile(r"^[ \t]*" + m.group(1) + r"\b", re.M).search(src, m.end())
            i = end.end() if end else len(src)
        else:
            i = m.end()
        yield (STRING if m.group() == '"' or m.group(1) else COMMENT), m.start(), i


def mask_hcl(src: str) -> str:
    """Strings and heredocs become quote characters, comments ``#``."""
    out, i = [], 0
    for kind, start, end in _hcl_masked(src):
        # a heredoc is one value, whatever its lines
        out += [src[i:start], _fill(src[start:end], "#") if kind == COMMENT else _fill(src[start:end], '"').replace("\n", '"')]
        i = end
    return "".join(out) + src[i:]


def hcl_tokens(src: str) -> Iterator[Token]:
    def found():
        i = 0
        for kind, start, end in [*_hcl_masked(src), (None, len(src), len(src))]:
            for m in _HCL_PLAIN.finditer(src, i, start):
                yield (WORD, OPEN, CLOSE, NEWLINE, SIGN)[m.lastindex - 1], m.start(), m.end()
            if kind:
                yield kind, start, end
            i = end

    return _placed(src, found())


def format_hcl(text: str, depth: int) -> str:
    """Lines of a body, indented by two blanks a level from ``depth`` on; ``=`` aligned in
    runs of one-line attributes; blank lines around it dropped."""
    text = text.strip("\n").rstrip()
    masked = mask_hcl(text)
    out: list[tuple[str, int | None]] = []  # line, and the width of its attribute's name
    at, level, inside = 0, 0, False
    for line in text.split("\n"):
        code = masked[at : at + len(line)]
        after = masked[at + len(line) : at + len(line) + 1]
        at += len(line) + 1
        if inside:  # within a heredoc
            out.append((line, None))
        else:
            opened, closed = len(re.findall(r"[{(\[]", code)), len(re.findall(r"[})\]]", code))
            first = len(re.match(r"[\s})\]]*", code).group().replace(" ", "").replace("\t", ""))
            pad = "  " * (depth + level - first)
            m = _HCL_ATTR.match(code.lstrip())
            value = line.strip()
            if m:
                value = f"{m.group(1)} = {value[m.end():]}"
            out.append((pad + value if value else "", len(pad) + len(m.group(1)) if m and opened == closed and after != '"' else None))
            level += opened - closed
        inside = after == '"'
    for i, (line, width) in enumerate(out):
        if width is not None and (i == 0 or out[i - 1][1] is None):
            run = i
            while run < len(out) and out[run][1] is not None:
                run += 1
            widest = max(w for _, w in out[i:run])
            out[i:run] = [(s[:w] + " " * (widest - w) + s[w:], w) for s, w in out[i:run]]
    return "\n".join(s for s, _ in out)
