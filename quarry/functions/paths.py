"""Path expressions: segments, dirname, ancestors, prefix rules, remote URLs.

Prefix rules are plain string prefixes, not segment aware (``ent`` also matches
``entry.go``), as in the reference; ``segment_aware=True`` gives the stricter form.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def segments(path) -> Column:
    return F.split(_col(path), "/")


def basename(path) -> Column:
    return F.element_at(segments(path), -1)


def dirname(path) -> Column:
    """Directory part; a path without ``/`` gives ``.``."""
    p = _col(path)
    return F.when(F.instr(p, "/") == 0, F.lit(".")).otherwise(F.regexp_replace(p, "/[^/]*$", ""))


def parent(path) -> Column:
    """Parent directory; top-level entries get the empty string (the tree root)."""
    p = _col(path)
    return F.when(F.instr(p, "/") == 0, F.lit("")).otherwise(F.regexp_replace(p, "/[^/]*$", ""))


def ancestors(path) -> Column:
    """Proper ancestor directories, shortest first (``a/b/c`` -> ``[a, a/b]``)."""
    segs = segments(path)
    return F.when(F.size(segs) > 1, F.transform(
        F.sequence(F.lit(1), F.size(segs) - 1), lambda i: F.array_join(F.slice(segs, 1, i), "/")
    )).otherwise(F.array().cast("array<string>"))


def prefix_match(path, prefix: str, segment_aware: bool = False) -> Column:
    p = _col(path)
    if not segment_aware:
        return p.startswith(prefix)
    pre = prefix.rstrip("/")
    return (p == F.lit(pre)) | p.startswith(pre + "/")


def any_prefix(path, prefixes: Sequence[str], segment_aware: bool = False) -> Column:
    """OR of prefix tests; each term pushes down to parquet as ``StringStartsWith``."""
    terms = [prefix_match(path, x, segment_aware) for x in prefixes]
    if not terms:
        return F.lit(False)
    out = terms[0]
    for t in terms[1:]:
        out = out | t
    return out


def skip(path, exclude: Sequence[str], include: Sequence[str], segment_aware: bool = False) -> Column:
    """True when an exclude prefix matches and no include prefix does."""
    return any_prefix(path, exclude, segment_aware) & ~any_prefix(path, include, segment_aware)


def below(path, target: str) -> Column:
    """Inside ``target`` (empty target = the whole tree)."""
    if not target:
        return F.lit(True)
    return _col(path).startswith(target.rstrip("/") + "/")


def url_owner_repo(url) -> Column:
    """``(owner, repo)`` from a remote URL: strip ``.git``, take the last two parts."""
    parts = F.split(F.regexp_replace(_col(url), r"\.git$", ""), "/")
    ok = F.size(parts) >= 2
    return F.struct(
        F.when(ok, F.element_at(parts, -2)).alias("owner"),
        F.when(ok, F.element_at(parts, -1)).alias("repo"),
    )


def git_blob_hash(content) -> Column:
    """Git blob id: ``sha1("blob " + byte length + NUL + bytes)``."""
    c = _col(content)
    b = c.cast("binary")
    return F.sha1(F.concat(F.lit("blob ").cast("binary"), F.octet_length(b).cast("string").cast("binary"),
                           F.unhex(F.lit("00")), b))
