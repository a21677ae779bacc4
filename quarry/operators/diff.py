"""Line diff in order (H7): a patience diff of whole tables of files.

Lines that occur once on both sides of a stretch are its anchors; of the anchors a longest
increasing run (in both files) is kept, and the stretches between them are diffed in the same way until no
common line is left.  A stretch whose common lines all repeat matches what it starts and ends with on both
sides, or else pairs the k-th occurrence of a line with the k-th.  Both texts of a path meet in one
shuffle; their line digests are matched there, and only the lines that are shown become rows, which still lie by path
for the hunks and the replay.  No row, window or group exceeds one file.

A file is read as lines that end with a line feed; a last line without one carries the usual
mark, so that the script gives back the exact text.  Null content and an absent file have no lines.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left, bisect_right
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What stands under a last line without a line feed.
NO_NEWLINE = "\n\\ No newline at end of file"


def _lines(text: Column) -> Column:
    """The lines of a text, without their line feeds."""
    pieces = F.split(text, "\n", -1)
    last = F.element_at(pieces, -1)
    ended = F.slice(pieces, 1, F.size(pieces) - 1)
    return F.when(F.length(text) > 0, F.when(last == "", ended).otherwise(F.concat(ended, F.array(F.concat(last, F.lit(NO_NEWLINE)))))).otherwise(F.array().cast("array<string>"))


def file_lines(files: DataFrame, *, path: str = "path", content: str = "content") -> DataFrame:
    """(path, line, text): lines from 1."""
    f = files.select(F.col(path).alias("path"), F.posexplode(_lines(F.col(content))).alias("at", "text"))
    return f.select("path", (F.col("at") + 1).cast("long").alias("line"), "text")


def _longest(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of (a, b) pairs ascending in a, a longest run that ascends in b."""
    tails: list[int] = []  # smallest last b of a run of each length
    ends: list[int] = []  # its place
    before = [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tails, b)
        before[i] = ends[k - 1] if k else -1
        if k == len(tails):
            tails.append(b)
            ends.append(i)
        else:
            tails[k], ends[k] = b, i
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(pairs[i])
        i = before[i]
    return out[::-1]


_Lines = list[tuple[int, str]]  # number and digest


def _without_anchors(a: _Lines, b: _Lines) -> list[tuple[int, int]]:
    """Matches of a stretch whose common lines all repeat: the lines that both sides start and end with,
    else the longest increasing run of k-th occurrences paired with k-th."""
    n = min(len(a), len(b))
    head = next((i for i in range(n) if a[i][1] != b[i][1]), n)
    tail = next((i for i in range(n - head) if a[-1 - i][1] != b[-1 - i][1]), n - head)
    pairs = [(x, y) for (x, _), (y, _) in [*zip(a[:head], b[:head]), *zip(a[len(a) - tail :], b[len(b) - tail :])]]
    if not pairs:
        places: dict[str, list[int]] = {}
        for line, h in b[::-1]:
            places.setdefault(h, []).append(line)
        pairs = _longest([(line, places[h].pop()) for line, h in a if places.get(h)])
    return pairs


def _matches(a: _Lines, b: _Lines) -> list[tuple[int, int]]:
    """The lines that both files keep, ascending in both."""
    found, stretches = [], [(a, b)]
    while stretches:
        a, b = stretches.pop()
        na, nb = Counter(h for _, h in a), Counter(h for _, h in b)
        if na.keys().isdisjoint(nb):
            continue
        at = {h: line for line, h in b}
        once = [(line, at[h]) for line, h in a if na[h] == 1 == nb[h]]
        new = sorted(_longest(once) if once else _without_anchors(a, b))
        found += new
        # what lies between two matches is a stretch of its own
        between: list[tuple[_Lines, _Lines]] = [([], []) for _ in range(len(new) + 1)]
        for side, lines in enumerate((a, b)):
            gone = [pair[side] for pair in new]
            known = set(gone)
            for x in lines:
                if x[0] not in known:
                    between[bisect_right(gone, x[0])][side].append(x)
        stretches += [(x, y) for x, y in between if x and y]
    return found


_TOLD = ("in_a", "at", "line", "place", "other")


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in _TOLD])))
def _told(a_lines, a_digests, b_lines, b_digests):
    """Every line of both sides by its place (``at``) in the arrays, with the match before it (``place``) and its own
    one (``other``; 0: none)."""
    import numpy as np
    import pyarrow as pa
    flat, counts = array("q"), [0]
    for row in zip(a_lines, a_digests, b_lines, b_digests):
        al, ah, bl, bh = (x.as_py() for x in row)
        pairs = _matches([*zip(al, ah)], [*zip(bl, bh)])
        for in_a, lines, marks in ((1, al, pairs), (0, bl, [(y, x) for x, y in pairs])):
            others: dict[int, list[int]] = {}
            for line, other in marks:
                others.setdefault(line, []).append(other)
            place = 0
            for at, line in enumerate(lines):
                if mine := others.get(line):
                    place = max(place, line if in_a else max(mine))
                for other in mine or [0]:
                    flat.extend((in_a, at, line, place, other))
        counts.append(len(flat) // len(_TOLD))
    columns = np.frombuffer(flat, np.int64).reshape(-1, len(_TOLD)) if flat else np.zeros((0, len(_TOLD)), np.int64)
    items = pa.StructArray.from_arrays([pa.array(columns[:, i]) for i in range(len(_TOLD))], names=_TOLD)
    return pa.ListArray.from_arrays(pa.array(counts, pa.int32()), items)


def script(before: DataFrame, after: DataFrame, *, path: str = "path", content: str = "content", keep: bool = False) -> DataFrame:
    """(path, place, kind, op, a_line, b_line, text) of every file that differs: ``-`` a line of ``before`` that
    goes, ``+`` one of ``after`` that comes, with ``keep`` also the lines of both (`` ``).  A path is in order by
    place (the last common line before, 0 at the start), kind and line."""
    old, new = (df.select(F.col(path).alias("path"), F.lit(s).alias("s"), F.coalesce(F.col(content), F.lit("")).alias("text")) for df, s in ((before, "a"), (after, "b")))
    texts = lambda s: F.collect_list(F.when(F.col("s") == s, F.col("text")))
    met = old.unionAll(new).groupBy("path").agg(texts("a").alias("a"), texts("b").alias("b"))
    one = lambda c: F.when(F.size(c) == 0, F.array(F.lit(""))).otherwise(F.col(c))
    # a path that repeats: each text of one side with each other one of the other side; their lines stand beside each other
    pairs = F.flatten(F.transform(one("a"), lambda x: F.transform(F.filter(one("b"), lambda y: x != y), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    both = met.select("path", pairs.alias("pairs")).filter("size(pairs) > 0")
    numbered = lambda text: F.transform(_lines(text), lambda x, i: F.struct((i + 1).cast("long").alias("line"), F.md5(x).alias("h"), x.alias("text")))
    sides = both.select("path", *(F.sort_array(F.flatten(F.transform(F.col(f"pairs.{s}"), numbered))).alias(s) for s in "ab"))
    told = sides.select("path", "a", "b", F.explode(_told("a.line", "a.h", "b.line", "b.h")).alias("t"))
    is_a, kept = F.col("t.in_a") == 1, F.col("t.other") > 0
    told = told.filter(~kept | (is_a if keep else F.lit(False)))
    line, none, at = F.col("t.line"), F.lit(None).cast("long"), F.col("t.at").cast("int")
    return told.select(
        "path", F.col("t.place").alias("place"), F.when(kept, 0).when(is_a, 1).otherwise(2).alias("kind"), F.when(kept, " ").when(is_a, "-").otherwise("+").alias("op"),
        F.when(is_a, line).otherwise(none).alias("a_line"), F.when(kept, F.col("t.other")).when(is_a, none).otherwise(line).alias("b_line"),
        F.when(is_a, F.get("a", at)["text"]).otherwise(F.get("b", at)["text"]).alias("text"),
    )


def replay(before: DataFrame, changes: DataFrame, *, path: str = "path", content: str = "content") -> DataFrame:
    """(path, content): ``before`` after the ``-`` and ``+`` rows of ``script``; files without rows unchanged."""
    mine = before.select(F.col(path).alias("path"), F.col(content).alias("content"))
    added = F.struct("place", F.lit(1).alias("kind"), F.col("b_line").alias("line"), "text")
    per_file = changes.groupBy("path").agg(
        F.collect_list(F.when(F.col("op") == "-", F.col("a_line"))).alias("gone"), F.collect_list(F.when(F.col("op") == "+", added)).alias("added"))
    lines = F.transform(_lines(F.coalesce("content", F.lit(""))), lambda x, i: F.struct((i + 1).cast("long").alias("place"), F.lit(0).alias("kind"), (i + 1).cast("long").alias("line"), x.alias("text")))
    j = mine.join(per_file, "path", "full_outer").withColumn("lines", F.when(F.col("gone").isNotNull(), lines))
    stay = F.transform(F.array_except(F.col("lines.line"), "gone"), lambda n: F.get("lines", (n - 1).cast("int")))
    ended = lambda x: F.when(x.endswith(NO_NEWLINE), F.left(x, F.length(x) - len(NO_NEWLINE))).otherwise(F.concat(x, F.lit("\n")))
    after = F.array_join(F.transform(F.sort_array(F.concat(stay, "added")), lambda x: ended(x["text"])), "")
    return j.select("path", F.when(F.col("gone").isNull(), F.col("content")).otherwise(after).alias("content"))


def unified(before: DataFrame, after: DataFrame, *, context: int = 3, path: str = "path", content: str = "content") -> DataFrame:
    """(path, hunk, header, text): the dry run as unified hunks, numbered from 1 in each file, with
    ``context`` unchanged lines around the changes and the header ``@@ -start,n +start,n @@``."""
    rows = script(before, after, path=path, content=content, keep=True)
    order = Window.partitionBy("path").orderBy("place", "kind", F.coalesce("a_line", "b_line"))
    at = rows.withColumn("at", F.row_number().over(order))
    changed = F.when(F.col("op") != " ", F.col("at"))
    walk = Window.partitionBy("path").orderBy("at")
    # the next change is the last one of the way back: a frame that ends at a file's end is built anew for each row
    back = Window.partitionBy("path").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, 0)
    near = at.withColumn("next", F.min(changed).over(back)).withColumn("past", F.max(changed).over(walk.rowsBetween(Window.unboundedPreceding, 0)))
    # lines of either file up to here, for the start of a side without lines in its hunk
    near = near.withColumn("a_so_far", F.coalesce(F.max("a_line").over(walk.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    near = near.withColumn("b_so_far", F.coalesce(F.max("b_line").over(walk.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    shown = near.filter((F.col("at") - F.col("past") <= context) | (F.col("next") - F.col("at") <= context))
    starts = F.when(F.col("at") - F.lag("at", 1, -1).over(walk) > 1, 1).otherwise(0)
    hunks = shown.withColumn("starts", starts).withColumn("hunk", F.sum("starts").over(walk.rowsBetween(Window.unboundedPreceding, 0)))
    side = lambda c: F.concat(
        F.coalesce(F.min(f"{c}_line"), F.min(f"{c}_so_far")).cast("string"),
        F.when(F.count(f"{c}_line") == 1, F.lit("")).otherwise(F.concat(F.lit(","), F.count(f"{c}_line").cast("string"))))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.concat("op", "text").alias("shown")))), lambda x: x["shown"]), "\n")
    return hunks.groupBy("path", "hunk").agg(F.concat(F.lit("@@ -"), side("a"), F.lit(" +"), side("b"), F.lit(" @@")).alias("header"), body.alias("text"))
