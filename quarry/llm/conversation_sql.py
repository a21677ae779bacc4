"""DuckDB SQL of the two conversation operators."""

from __future__ import annotations


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII string expression, bit by bit (DuckDB has no function for it)."""
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({text}) + 1), lambda i: ascii(({text})[i])::BIGINT)),
        lambda a, b: list_reduce(list_prepend(xor(a, b), range(0, 8)), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)))"""


PREFIX_TRIE = f"""
WITH t AS (SELECT conv_id AS c, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, list({{'r': r, 'x': x}} ORDER BY turn NULLS FIRST, md5(length(r)::VARCHAR || ':' || r || x)) AS l FROM t GROUP BY c),
k AS (SELECT c, l, c - c % 20 AS base, ({_crc32('c::VARCHAR')} % 4)::INTEGER AS h FROM o),
w AS (SELECT k.c, list_concat(list_slice(coalesce(b.l, []), 1, h), list_slice(k.l, h + 1, len(k.l))) AS l FROM k LEFT JOIN o b ON b.c = k.base),
p AS (SELECT c, len(l) AS n, unnest(range(0, len(l) + 1)) AS d, l FROM w),
m AS (SELECT c, n, d, list_slice(l, 1, d) AS s FROM p),
g AS (SELECT s, d, min(c) AS c, count(*) AS n_convs, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d) AS ends,
             (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(s[d].x, '[^\\x20\\x09-\\x0D]+')) END AS saved FROM m GROUP BY s, d),
u AS (SELECT *, list_slice(s, 1, d - 1) AS up FROM g),
f AS (SELECT up AS s, count(*) AS n FROM u WHERE d > 0 GROUP BY up),
v AS (SELECT u.*, coalesce(f.n, 0) AS kids FROM u LEFT JOIN f ON f.s = u.s),
a AS (SELECT list_slice(s, 1, e) AS s, e AS d, sum(saved)::BIGINT AS saved, count(*) FILTER (kids = 0) AS leaves FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM v) GROUP BY 1, 2)
SELECT v.c AS conv_id, v.d::BIGINT AS depth, CASE WHEN v.d > 0 THEN q.c END AS parent_conv_id, v.n_convs::BIGINT AS n_convs, v.kids::BIGINT AS n_children,
       a.leaves::BIGINT AS n_leaves, a.saved AS saved_tokens, sha256(coalesce(v.ends, '')) AS ends_sha256
FROM v JOIN a ON a.s = v.s AND a.d = v.d LEFT JOIN g q ON q.s = v.up AND v.d > 0 AND q.d = v.d - 1"""

_NAME = "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"

#: Rows after the damage, numbered, and a recursive query from the last row to the first that carries for each
#: state the least (cost, edits, repaired rows); structs compare in this order.
_REPAIR = f"""
WITH RECURSIVE d AS (SELECT conv_id AS c, turn AS t, coalesce(role, ' ') AS r, coalesce(text, ' ') AS x, {_crc32(f'({_NAME})')} % 20 AS k FROM conversations),
e AS (SELECT c, t, CASE WHEN k = 4 THEN 'user' ELSE r END AS r, CASE WHEN k = 1 THEN '' WHEN k = 2 THEN translate(x, '.!?', '') ELSE x END AS x,
             unnest(CASE WHEN k = 3 THEN [1, 2] ELSE [1] END) AS copy FROM d WHERE k <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY t NULLS FIRST, md5(length(r)::VARCHAR || ':' || r || x), copy) AS i FROM e),
y AS (SELECT *, rtrim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS z, row_number() OVER (PARTITION BY c, r, x ORDER BY i) AS nth,
             lead(r) OVER (PARTITION BY c ORDER BY i) AS nxt FROM o),
f AS (SELECT c, t, r, x, i, nxt, CASE WHEN z = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN z[-1] NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM y),
s AS (SELECT c, count(*) AS n, coalesce(max(t) - min(t) + 1 - count(DISTINCT t), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank,
             count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
             count(*) FILTER (nxt IS NOT NULL AND r[1] || nxt[1] NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY c),
-- the best rest (cost, edits, repaired roles) from the states nothing, s, u and a before row i
v AS (
  SELECT c, n + 1 AS i, {{'k': 0, 'e': '', 'o': []::VARCHAR[]}} AS v0, {{'k': 10, 'e': 'II', 'o': ['user:', 'assistant:']}} AS v1,
         {{'k': 5, 'e': 'I', 'o': ['assistant:']}} AS v2, {{'k': 0, 'e': '', 'o': []::VARCHAR[]}} AS v3 FROM s
  UNION ALL
  SELECT c, i, least(b0, {{'k': 5 + u.k, 'e': 'I' || u.e, 'o': list_prepend('user:', u.o)}}), least(b1, {{'k': 5 + u.k, 'e': 'I' || u.e, 'o': list_prepend('user:', u.o)}}), u, a
  FROM (SELECT c, i, b0, b1, least(b2, {{'k': 5 + b3.k, 'e': 'I' || b3.e, 'o': list_prepend('assistant:', b3.o)}}) AS u,
               least(b3, {{'k': 5 + b2.k, 'e': 'I' || b2.e, 'o': list_prepend('user:', b2.o)}}) AS a
        FROM (SELECT f.c, f.i, {{B0}} AS b0, {{B1}} AS b1, {{B2}} AS b2, {{B3}} AS b3
              FROM v JOIN f ON f.c IS NOT DISTINCT FROM v.c AND f.i = v.i - 1)))
SELECT a.c AS conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(v0.k, 0)::BIGINT AS cost, coalesce(v0.e, '') AS audit, sha256(coalesce(array_to_string(v0.o, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT c FROM d) a LEFT JOIN s ON s.c IS NOT DISTINCT FROM a.c LEFT JOIN v ON v.c IS NOT DISTINCT FROM a.c AND v.i = 1"""


def _cheapest(state: int, keeps: list[tuple[str, int]], to: int) -> str:
    """The best rest before a row: ``keeps`` are the initials that may stay in this state and where they lead,
    ``to`` is the state that a new role leads to."""
    role = {2: "user", 3: "assistant"}[to]
    extra = "CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END"
    delete = f"{{'k': 2 + v{state}.k, 'e': 'D' || v{state}.e, 'o': v{state}.o}}"
    rerole = f"{{'k': 1 + {extra} + v{to}.k, 'e': 'R' || v{to}.e, 'o': list_prepend('{role}:' || x, v{to}.o)}}"
    out = f"CASE WHEN fault IN ('blank', 'duplicate') THEN {delete}"
    for initial, after in keeps:
        keep = f"{{'k': {extra} + v{after}.k, 'e': 'K' || v{after}.e, 'o': list_prepend(r || ':' || x, v{after}.o)}}"
        out += f" WHEN r[1] = '{initial}' THEN least({delete}, {rerole}, {keep})"
    return f"{out} ELSE least({delete}, {rerole}) END"


CONVERSATION_REPAIR = (
    _REPAIR.replace("{B0}", _cheapest(0, [("s", 1), ("u", 2)], 2)).replace("{B1}", _cheapest(1, [("u", 2)], 2))
    .replace("{B2}", _cheapest(2, [("a", 3)], 3)).replace("{B3}", _cheapest(3, [("u", 2)], 2))
)
