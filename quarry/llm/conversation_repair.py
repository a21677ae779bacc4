"""Conversation structure repair: the cheapest edits that give every conversation legal roles.

A conversation is legal when the initials of its roles read ``(s?(ua)+)?``.  Edits of a row: Keep (0),
Rerole to user or assistant (1), Delete (2, the only one for a blank or repeated row); Insert puts an
empty user or assistant row anywhere (5); a truncated row that is not deleted costs 5 more.  Of the
cheapest sequences the one whose initials are least in ASCII is taken.

Square-root checkpointed dynamic programme.  The state before a row is what the legal prefix ends in
(nothing, s, u, a), so all that is behind a row is a vector of four costs.  A conversation of n rows is cut
into blocks of ceil(sqrt(n)) rows:

1. each block, in a task of its own, becomes its 4 x 4 matrix of cheapest costs between states;
2. the matrices are applied from the end of the conversation to its start, and the vector behind each
   block is stored: the checkpoints, about sqrt(n) of them;
3. each block computes its vectors again from its checkpoint and walks forward, from each of the four
   states that it may be entered in, along the least tight edit;
4. the states at the block borders are followed from the start, which settles each block's walk.

So no task holds more than a block or a conversation's checkpoints, however long a conversation is.
Rows that equal each other (same turn, role and text) are counted before they are shuffled, and texts
travel only at the end, for the rows that stay.

Rows: null role or text is one space; rows of one turn are taken in the order of a digest of role and text,
null turns first; rows without conv_id are a conversation of their own (null).  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import stored
from quarry.llm.ordered import running, streamed_sha256

#: Least rows of a block: conversations up to it are one block.
MIN_BLOCK = 64
#: Costs of the edits, white space and the ends of sentences.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
BLANKS = " \t\n\x0b\x0c\r"
ENDS = ".!?"

#: States: nothing yet, after s, after u, after a; the state that a user or assistant row leads to.
_STEP = (2, 2, 3, 2)
_ROLE = "-sua"
_NEVER = 1 << 60
#: One letter for a row: its role's initial (x: any other), upper case if it must go; digits: truncated s, u, a, x.
_INITIALS, _TRUNCATED = "suax", "1234"
_ACCEPT = (0, 10, 5, 0)  # costs of ending, with the inserts that complete a pair


def _moves(code: str) -> tuple[tuple, ...]:
    """For each state: (extra cost of staying, state after Keep or -1, whether the row may stay)."""
    stays = not code.isupper()
    initial = _INITIALS[_TRUNCATED.index(code)] if code in _TRUNCATED else code.lower()
    extra = TRUNCATED if code in _TRUNCATED else 0
    keep = {"s": (1, -1, -1, -1), "u": (2, 2, -1, 2), "a": (-1, -1, 3, -1), "x": (-1, -1, -1, -1)}[initial]
    return tuple((extra, keep[q], stays) for q in range(4))


_MOVES = {c: _moves(c) for c in _INITIALS + _INITIALS.upper() + _TRUNCATED}


def _before(code: str, v: tuple) -> tuple:
    """The cost vector before a row from the one behind it; inserts come before the row."""
    out = []
    for q, (extra, kept, stays) in enumerate(_MOVES[code]):
        best = DELETE + v[q]
        if stays:
            best = min(best, REROLE + extra + v[_STEP[q]])
            if kept >= 0:
                best = min(best, KEEP + extra + v[kept])
        out.append(best)
    u, a = min(out[2], INSERT + out[3]), min(out[3], INSERT + out[2])
    return tuple(min(x, _NEVER) for x in (min(out[0], INSERT + u), min(out[1], INSERT + u), u, a))


def matrix(codes: str) -> list[int]:
    """Cheapest costs through a block: entry 4 * q + r from state q before it to state r behind it."""
    columns = []
    for r in range(4):
        v = tuple(0 if q == r else _NEVER for q in range(4))
        for code in reversed(codes):
            v = _before(code, v)
        columns.append(v)
    return [columns[r][q] for q in range(4) for r in range(4)]


def applied(m: list[int], v: tuple) -> tuple:
    """The vector before a block from its matrix and the vector behind it."""
    return tuple(min(_NEVER, *(m[4 * q + r] + v[r] for r in range(4))) for q in range(4))


def _walk(codes: str, vectors: list[tuple], state: int, at_end: bool) -> tuple[str, str, int]:
    edits, roles = [], []
    for i, code in enumerate(codes):
        while True:
            here, behind = vectors[i], vectors[i + 1]
            extra, kept, stays = _MOVES[code][state]
            if here[state] == DELETE + behind[state]:
                edits.append("D")
                roles.append("-")
                break
            inserted = here[state] == INSERT + here[_STEP[state]]
            if not inserted and stays and kept >= 0 and here[state] == KEEP + extra + behind[kept]:
                edits.append("K")
                state = kept
            else:
                edits.append("I" if inserted else "R")
                state = _STEP[state]
            roles.append(_ROLE[state])
            if not inserted:
                break
    while at_end and _ACCEPT[state]:
        edits.append("I")
        state = _STEP[state]
        roles.append(_ROLE[state])
    return "".join(edits), "".join(roles), state


def walks(codes: str, behind: tuple, at_end: bool) -> list[tuple[str, str, int]]:
    """(edits, initials of the roles after them, state behind the block) of the least tight walk from
    each state before the block; at the end of the conversation with the inserts that complete it."""
    vectors = [behind]
    for code in reversed(codes):
        vectors.append(_before(code, vectors[-1]))
    vectors.reverse()
    return [_walk(codes, vectors, q, at_end) for q in range(4)]


# Spark ------------------------------------------------------------------------------------------

def _group(conv_id: str = "conv_id") -> Column:
    return F.coalesce(F.col(conv_id).cast("string"), F.lit(""))


def _digest(role: str, text: str) -> Column:
    return F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), F.col(role), F.col(text)))


def prepared(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): the table without nulls in role and text."""
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.lit(1).cast("long").alias("copies"),
    )


def damaged(rows: DataFrame) -> DataFrame:
    """``prepared`` rows after a repeatable damage by crc32(``conv_id:turn``) % 20: 0 drops a row, 1 empties
    its text, 2 takes its ends of sentences, 3 repeats it, 4 makes it the user's."""
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = rows.withColumn("_q_r", F.pmod(F.crc32(name.cast("binary")), F.lit(20))).filter("_q_r <> 0")
    r = F.col("_q_r")
    return rows.select(
        "conv_id", "turn", F.when(r == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(r == 1, F.lit("")).when(r == 2, F.translate("text", ENDS, "")).otherwise(F.col("text")).alias("text"),
        F.when(r == 3, F.col("copies") * 2).otherwise(F.col("copies")).alias("copies"),
    )


def _units(rows: DataFrame) -> DataFrame:
    """(g, conv_id, turn, digest, initial, fault, place): each row in its place of its conversation (from 0)."""
    trimmed = F.rtrim(F.col("text"), F.lit(BLANKS))
    narrow = rows.select(
        _group().alias("g"), "conv_id", "turn", _digest("role", "text").alias("digest"), F.substring("role", 1, 1).alias("initial"),
        (F.length(trimmed) == 0).alias("blank"), (~F.substring(trimmed, -1, 1).isin(*ENDS)).alias("cut"), "copies",
    )
    same = narrow.groupBy("g", "conv_id", "turn", "digest").agg(
        F.first("initial").alias("initial"), F.first("blank").alias("blank"), F.first("cut").alias("cut"), F.sum("copies").alias("n")
    )
    order = F.struct(F.col("turn").isNotNull(), F.coalesce("turn", F.lit(0).cast("long")))
    firsts = same.groupBy("g", "digest").agg(F.min(order).alias("first"))
    told = same.join(firsts, ["g", "digest"]).withColumn("is_first", order == F.col("first")).drop("first")
    placed = running(told, "g", ["turn", "digest"], {"before": "n"})
    run = F.lit(1 << 16).cast("long")
    runs = placed.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, run)).alias("from"))
    each = F.sequence(F.col("from"), F.least(F.col("n"), F.col("from") + run) - 1)
    units = runs.select("*", F.explode(each).alias("k"))
    fault = (
        F.when(F.col("blank"), "blank").when(~F.col("is_first") | (F.col("k") > 0), "duplicate").when(F.col("cut"), "truncated").otherwise("none")
    )
    return stored(units.select("g", "conv_id", "turn", "digest", "initial", fault.alias("fault"), (F.col("before") + F.col("k")).alias("place")))


def _code() -> Column:
    known = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("x")
    cut = F.translate(known, _INITIALS, _TRUNCATED)
    return F.when(F.col("fault").isin("blank", "duplicate"), F.upper(known)).when(F.col("fault") == "truncated", cut).otherwise(known)


def _solved(units: DataFrame, min_block: int) -> tuple[DataFrame, DataFrame]:
    """(conversations: g, cost) and (blocks: g, block, first, edits, roles): the cheapest cost, and the edits of each block."""
    sizes = units.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    step = F.greatest(F.lit(min_block), F.ceil(F.sqrt("n"))).cast("long")
    cut = units.join(sizes.select("g", step.alias("step")), "g").select("g", F.expr("place div step").alias("block"), "place", _code().alias("code"))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("place", "code"))), lambda x: x["code"])
    blocks = cut.groupBy("g", "block").agg(F.min("place").alias("first"), F.array_join(in_order, "").alias("codes"))

    def with_matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {}
            codes = batch.column("codes").to_pylist()
            for c in codes:
                if c not in found:
                    found[c] = matrix(c)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([found[c] for c in codes], pa.list_(pa.int64()))], names=[*batch.schema.names, "costs"])

    blocks = stored(blocks.mapInArrow(with_matrix, "g string, block long, first long, codes string, costs array<long>"))

    def checkpoints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From the matrices of a conversation, last block first, the vector behind each block."""
        for batch in batches:
            out = []
            for g, chain in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                v = _ACCEPT
                for i, link in enumerate(reversed(chain)):
                    behind, v = v, applied(link["costs"], v)
                    out.append((g, link["block"], list(behind), i == 0, v[0] if link["block"] == 0 else None))
            cols = list(zip(*out)) or [()] * 5
            kinds = [pa.string(), pa.int64(), pa.list_(pa.int64()), pa.bool_(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["g", "block", "behind", "at_end", "cost"])

    chains = blocks.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("block", "costs"))).alias("chain"))  # sqrt(n) matrices a conversation
    marks = stored(chains.mapInArrow(checkpoints, "g string, block long, behind array<long>, at_end boolean, cost long"))

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, out = {}, []
            for args in zip(batch.column("codes").to_pylist(), map(tuple, batch.column("behind").to_pylist()), batch.column("at_end").to_pylist()):
                if args not in found:
                    found[args] = walks(*args)
                out.append(found[args])
            yield pa.RecordBatch.from_arrays(
                [batch.column("g"), batch.column("block"), batch.column("first"),
                 pa.array([[w[0] for w in four] for four in out], pa.list_(pa.string())), pa.array([[w[1] for w in four] for four in out], pa.list_(pa.string())),
                 pa.array([[w[2] for w in four] for four in out], pa.list_(pa.int32()))],
                names=["g", "block", "first", "edits", "roles", "exits"],
            )

    ways = stored(
        blocks.select("g", "block", "first", "codes").join(marks.select("g", "block", "behind", "at_end"), ["g", "block"])
        .mapInArrow(walked, "g string, block long, first long, edits array<string>, roles array<string>, exits array<int>")
    )
    # the state that each block is entered in: the exits followed from the start
    exits = ways.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("block", "exits"))).alias("chain"))

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for g, chain in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                state = 0
                for link in chain:
                    out.append((g, link["block"], state))
                    state = link["exits"][state]
            cols = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.int32()))], names=["g", "block", "entry"])

    entered = exits.mapInArrow(entries, "g string, block long, entry int")
    chosen = ways.join(entered, ["g", "block"]).select("g", "block", "first", F.expr("edits[entry]").alias("edits"), F.expr("roles[entry]").alias("roles"))
    return marks.filter("block = 0").select("g", "cost"), stored(chosen)


def _stays(chosen: DataFrame) -> DataFrame:
    """(g, place, sub, edit, initial): each row that is kept, reroled or inserted.  An inserted row has the place
    of the row that it stands before; ``sub`` orders what shares a place."""

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for g, place, edits, roles in zip(*(batch.column(c).to_pylist() for c in ("g", "first", "edits", "roles"))):
                sub = 0
                for e, r in zip(edits, roles):
                    if e != "D":
                        out.append((g, place, sub, e, r))
                    place, sub = (place, sub + 1) if e == "I" else (place + 1, 0)
            cols = list(zip(*out)) or [()] * 5
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["g", "place", "sub", "edit", "initial"])

    return chosen.select("g", "first", "edits", "roles").mapInArrow(spelled, "g string, place long, sub int, edit string, initial string")


def _repaired(rows: DataFrame, units: DataFrame, chosen: DataFrame) -> DataFrame:
    left = _stays(chosen)
    spoken = F.when(F.col("initial") == "u", F.lit("user")).otherwise(F.lit("assistant"))
    fresh = left.filter("edit = 'I'").select(
        "g", F.when(F.col("g") != "", F.col("g")).cast("long").alias("conv_id"), "place", "sub", "edit", F.lit(None).cast("long").alias("turn"), spoken.alias("role"), F.lit("").alias("text")
    )
    own = left.filter("edit <> 'I'").join(units.select("g", "place", "conv_id", "turn", "digest"), ["g", "place"])
    texts = rows.groupBy(_group().alias("g"), "turn", _digest("role", "text").alias("digest")).agg(F.first("role").alias("role"), F.first("text").alias("text"))
    texts = texts.withColumnRenamed("turn", "_q_turn").withColumnRenamed("g", "_q_g").withColumnRenamed("digest", "_q_d")
    own = own.join(texts, (F.col("g") == F.col("_q_g")) & F.col("turn").eqNullSafe(F.col("_q_turn")) & (F.col("digest") == F.col("_q_d")))
    own = own.select("g", "conv_id", "place", "sub", "edit", "turn", F.when(F.col("edit") == "K", F.col("role")).otherwise(spoken).alias("role"), "text")
    return own.unionAll(fresh)


def repair(rows: DataFrame, *, min_block: int = MIN_BLOCK) -> DataFrame:
    """The repaired conversations of ``prepared`` (or ``damaged``) rows: (conv_id, place, sub, edit, turn, role,
    text), one row for each that is kept (K), reroled (R) or inserted (I, without turn), in the order of place
    and sub.  Conversations that lose every row are absent."""
    units = _units(rows)
    return _repaired(rows, units, _solved(units, min_block)[1]).drop("g")


def report(conversations: DataFrame, *, damage: bool = True, min_block: int = MIN_BLOCK) -> DataFrame:
    """One row per conv_id of the table: gaps in its turns, its blank, duplicate and truncated rows, its illegal
    neighbours, the cost and edits (``audit``) of the repair, and the SHA-256 of the repaired ``role:text`` lines.
    A conversation without rows after the damage has zeros, no edits and the digest of nothing."""
    rows = prepared(conversations)
    everyone = rows.select(_group().alias("g"), "conv_id").distinct()
    rows = damaged(rows) if damage else rows
    units = _units(rows)
    costs, chosen = _solved(units, min_block)
    faults = units.groupBy("g").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0).cast("long")).alias("gaps"),
        *(F.count(F.when(F.col("fault") == f, 1)).alias(f) for f in ("blank", "duplicate", "truncated")),
    )
    nxt = units.select("g", (F.col("place") - 1).alias("place"), F.col("initial").alias("then"))
    pairs = units.select("g", "place", "initial").join(nxt, ["g", "place"])
    illegal = pairs.groupBy("g").agg(F.count(F.when(~F.concat("initial", "then").isin("su", "ua", "au"), 1)).alias("illegal"))
    audits = chosen.groupBy("g").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "edits"))), lambda x: x["edits"]), "").alias("audit"))
    lines = _repaired(rows, units, chosen).select("g", "place", "sub", F.concat("role", F.lit(":"), "text").alias("line"))
    digests = streamed_sha256(lines, "g", ["place", "sub"], "line", b"\n").withColumnRenamed("sha256", "repaired_sha256")
    out = everyone
    for part in (faults, illegal, costs, audits, digests):
        out = out.join(part, "g", "left")
    zero = F.lit(0).cast("long")
    return out.select(
        "conv_id", *(F.coalesce(c, zero).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
