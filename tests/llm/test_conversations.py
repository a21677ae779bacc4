"""Prefix trie and structure repair of conversations against plain Python, with the odd cases."""

from __future__ import annotations

import hashlib
import heapq
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

from quarry.llm import conversation_repair as R
from quarry.llm import prefix_trie as T
from quarry.llm.ordered import running, streamed_sha256
from quarry.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"
WORD, SEEN = re.compile("[^\x20\x09-\x0d]+"), re.compile("[^\x20\x09-\x0d]")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def tie(role: str, text: str) -> str:
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def in_order(rows):
    """(role, text) by turn, nulls first, ties by the digest of both."""
    return [(r, x) for *_, r, x in sorted((t is not None, t or 0, tie(r, x), r, x) for t, r, x in rows)]


def trie(rows) -> set:
    conv = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            conv[c].append((t, r or "", x or ""))
    own = {c: in_order(v) for c, v in conv.items()}
    whole = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + v[h:]
    members = defaultdict(list)
    for c, v in whole.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    kids = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        words = (len(m) - 1) * len(WORD.findall(k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += kids[k] == 0
            saved[k[:d]] += words
    return {
        (min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], sha(",".join(map(str, sorted(c for c in m if len(whole[c]) == len(k))))))
        for k, m in members.items()
    }


def cheapest(codes):
    """(cost, edits, outcome) by Dijkstra over (row, last role), labels ordered by cost and edits."""
    legal = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, edits, i, last, out = heapq.heappop(heap)
        if (i, last) in done:
            continue
        done.add((i, last))
        if i == len(codes) and last in ("", "a"):
            return cost, edits, out
        for r in "ua":
            if (last, r) in legal:
                heapq.heappush(heap, (cost + 5, edits + "I", i, r, out + ((None, r),)))
        if i < len(codes):
            initial, goes, cut = codes[i]
            heapq.heappush(heap, (cost + 2, edits + "D", i + 1, last, out))
            if not goes:
                extra = 5 if cut else 0
                if (last, initial) in legal:
                    heapq.heappush(heap, (cost + extra, edits + "K", i + 1, initial, out + ((i, None),)))
                for r in "ua":
                    if (last, r) in legal:
                        heapq.heappush(heap, (cost + extra + 1, edits + "R", i + 1, r, out + ((i, r),)))


def repaired(rows, damage=True) -> dict:
    conv = defaultdict(list)
    for c, t, r, x in rows:
        conv[c]
        r, x = " " if r is None else r, " " if x is None else x
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20 if damage else None
        if k != 0:
            conv[c] += [(t, "user" if k == 4 else r, "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x)] * (2 if k == 3 else 1)
    out = {}
    for c, own in conv.items():
        whole, seen, faults, codes = in_order(own), set(), Counter(), []
        for r, x in whole:
            shown = SEEN.findall(x)
            f = "blank" if not shown else "duplicate" if (r, x) in seen else "" if shown[-1] in ".!?" else "truncated"
            seen.add((r, x))
            faults[f] += 1
            codes.append((r[:1], f in ("blank", "duplicate"), f == "truncated"))
        turns = [t for t, *_ in own if t is not None]
        cost, edits, kept = cheapest(codes)
        name = {"u": "user", "a": "assistant"}
        lines = [f"{name[r] if r else whole[i][0]}:{'' if i is None else whole[i][1]}" for i, r in kept]
        out[c] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults["blank"], faults["duplicate"], faults["truncated"],
            sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(codes)), cost, edits, sha("\n".join(lines)),
        )
    return out


def table(seed: int) -> list[tuple]:
    """Shared beginnings, whole copies, one long conversation, null and odd values, repeated rows."""
    r = random.Random(seed)
    says = ["Yes.", "No!", "so it goes", "", " \n", "What? Why", "A b c d e f.", "end?\t", "日本 é.", None]
    rows = []
    for c in [*range(0, 47), 60, 61, 65, 79, 100_020, -1, -20, -25]:
        n = r.choice([1, 1, 2, 3, 4, 5, 8])
        like = r.random() < 0.5
        rows += [(c, t, r.choice(["user", "assistant"]) if not like else ["system", "user", "assistant"][t % 3], says[t % 3] if like else r.choice(says)) for t in range(n)]
    rows += [(200, t, ("user", "assistant")[t % 2], f"turn {t % 37}.") for t in range(260)]
    rows += [(201 + i, t, ("user", "assistant")[t % 2], f"turn {t % 37}.") for i in range(3) for t in range(40)]
    rows += [(None, 1, "user", "hi."), (None, None, None, None), (5, None, "tool", "x."), (5, None, "assistant", "y."), (7, 2, "System", "z."), (7, 2, "", "z.")]
    rows += [(8, 3, "user", "again.")] * 300 + [(9, 10, "user", "far."), (9, 1, "user", "near.")]
    return rows


def test_trie(spark):
    rows = table(1)
    frame = spark.createDataFrame([(*x, 1, "k") for x in rows], SCHEMA + ", depth int, key string").repartition(5)
    got = [tuple(x) for x in T.nodes(frame).collect()]
    assert len(got) == len(set(got)) and set(got) == trie(rows)


def test_trie_does_not_depend_on_the_sketch(spark):
    """A sketch that is far too small proves almost nothing and costs only shuffles."""
    rows = table(3)
    least, T.MIN_WIDTH = T.MIN_WIDTH, 8
    try:
        assert {tuple(x) for x in T.nodes(spark.createDataFrame(rows, SCHEMA), max_width=8).collect()} == trie(rows)
    finally:
        T.MIN_WIDTH = least


def test_screen_proves_singletons_only(spark):
    rows = T.prefixes(T.rebuilt(T.turns(spark.createDataFrame(table(4), SCHEMA)))[1])
    seen = T.screened(rows)
    wrong = seen.join(rows.groupBy("key").count(), "key").filter("alone AND count > 1").count()
    assert wrong == 0 and seen.filter("alone").count() > 0


def test_trie_small(spark):
    one = spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)  # no conversation at all, as in an empty table
    assert T.nodes(one).count() == 0
    # conversation 1 takes its first 3 turns from 0, which is absent, and has no turn beyond
    assert zlib.crc32(b"1") % 4 == 3
    turnless = [(1, 1, "user", "x")]
    assert {tuple(x) for x in T.nodes(spark.createDataFrame(turnless, SCHEMA)).collect()} == trie(turnless) == {(1, 0, None, 1, 0, 1, 0, sha("1"))}


def test_repair(spark):
    """Blocks of sqrt(n) rows even in short conversations."""
    rows = table(1)
    frame = spark.createDataFrame([(*x, 1, "k") for x in rows], SCHEMA + ", place int, g string").repartition(4)
    got = R.report(frame, min_block=1).collect()
    assert {x["conv_id"]: tuple(x)[1:] for x in got} == repaired(rows) and len(got) == len(repaired(rows))


def test_repair_undamaged_rows(spark):
    rows = table(2)
    frame = spark.createDataFrame(rows, SCHEMA)
    got = R.report(frame, damage=False).collect()
    want = repaired(rows, damage=False)
    assert {x["conv_id"]: tuple(x)[1:] for x in got} == want
    lines = defaultdict(list)
    for x in R.repair(R.prepared(frame)).orderBy("place", "sub").collect():
        lines[x["conv_id"]].append((x["edit"], f"{x['role']}:{x['text']}"))
        assert (x["edit"] == "I") == (x["text"] == "") or x["edit"] != "I"
    for c, expected in want.items():
        assert "".join(e for e, _ in lines[c]) == expected[6].replace("D", "") and sha("\n".join(t for _, t in lines[c])) == expected[7]


def test_blocks_agree_with_enumeration():
    """Any cut into blocks gives the edits of the whole."""
    r = random.Random(8)
    letters = list(R._MOVES)
    for _ in range(300):
        codes = "".join(r.choice(letters) for _ in range(r.randint(1, 14)))
        rows = []
        for c in codes:
            cut = c in R._TRUNCATED
            rows.append(((R._INITIALS[R._TRUNCATED.index(c)] if cut else c.lower()).replace("x", "t"), c.isupper(), cut))
        cost, edits, _ = cheapest(rows)
        size = r.randint(1, 5)
        parts = [codes[i : i + size] for i in range(0, len(codes), size)]
        marks, v = [], R._ACCEPT
        for p in reversed(parts):
            marks.append(v)
            v = R.applied(R.matrix(p), v)
        state, told = 0, ""
        for p, behind, n in zip(parts, reversed(marks), range(len(parts))):
            e, roles, state = R.walks(p, behind, n == len(parts) - 1)[state]
            assert len(e) == len(roles)
            told += e
        assert (v[0], told) == (cost, edits)


def test_repair_small(spark):
    assert R.report(spark.createDataFrame([], SCHEMA)).count() == 0
    gone = [(c, 0, "user", "x.") for c in range(300) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    got = R.report(spark.createDataFrame(gone, SCHEMA)).collect()
    assert len(got) == len(gone) and {tuple(x)[1:] for x in got} == {(0, 0, 0, 0, 0, 0, "", sha(""))}


def test_queries_on_the_table(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(x) for x in spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {tuple(x) for x in QUERIES["op12_prefix_trie"](spark, d).collect()} == trie(rows)
    assert {x["conv_id"]: tuple(x)[1:] for x in QUERIES["op13_conversation_repair"](spark, d).collect()} == repaired(rows)


def test_running_sums_cross_tasks(spark):
    rows = [(i % 3 if i % 5 else 0, i, i % 7) for i in range(5_000)]
    got = running(spark.createDataFrame(rows, "g long, at long, n long").repartition(9), "g", ["at"], {"before": "n"}).collect()
    past = Counter()
    want = {}
    for g, at, n in rows:
        want[at] = past[g]
        past[g] += n
    assert {x["at"]: x["before"] for x in got} == want


def test_streamed_digests(spark):
    rows = [(i % 4, i, f"l{i}é" if i % 3 else "") for i in range(2_000)]
    got = streamed_sha256(spark.createDataFrame(rows, "g long, at long, line string").repartition(6), "g", ["at"], "line", b"\n").collect()
    assert {x["g"]: x["sha256"] for x in got} == {g: sha("\n".join(x for k, _, x in rows if k == g)) for g in range(4)}


def test_sql_equals_plain_python():
    """The DuckDB SQL on the odd rows as well."""
    import duckdb
    import pandas as pd

    from quarry.llm.queries import ORACLE_SQL

    rows = [x for x in table(1) if x[0] != 200]  # the long conversation is left to Spark
    frame = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    con = duckdb.connect()
    con.register("frame", frame)
    con.execute("CREATE TABLE conversations AS SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, role::VARCHAR AS role, text::VARCHAR AS text FROM frame")
    assert set(con.execute(ORACLE_SQL["op12_prefix_trie"]).fetchall()) == trie(rows)
    assert {x[0]: tuple(x[1:]) for x in con.execute(ORACLE_SQL["op13_conversation_repair"]).fetchall()} == repaired(rows)
