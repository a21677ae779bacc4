"""DuckDB SQL for every catalogued query (the correctness oracle).

``VIEWS`` mirrors ``quarry.sources.corpus`` one to one; ``sql(views, body)``
prepends the needed views as CTEs.  DuckDB dialect notes: ``lambda x: ...``
lambdas, ``regexp_replace(.., 'g')`` to replace all matches, lists are 1-based.
"""

from __future__ import annotations

from quarry.sources import code_shapes as SH

EPOCH = "TIMESTAMP '2024-01-01 00:00:00'"

VIEWS: dict[str, str] = {
    "doctable": f"""
      SELECT doc_id AS id, 'repo' || (doc_id % 2)::VARCHAR AS repository, lang AS context,
             source || '/' || doc_id::VARCHAR || '.txt' AS filepath, text AS description,
             {EPOCH} + to_minutes(((doc_id * 37) % 1440)::BIGINT) AS updated_at
      FROM documents""",
    "incoming": f"""
      SELECT 'repo' || (doc_id % 2)::VARCHAR AS repository, lang AS context,
             source || '/' || doc_id::VARCHAR || '.txt' AS filepath, text AS content,
             {EPOCH} + to_minutes(((doc_id * 53) % 1440)::BIGINT) AS modified_at
      FROM documents WHERE doc_id % 5 <> 0""",
    "allfiles": f"""
      SELECT 'repo' || (doc_id % 2)::VARCHAR AS repository, lang AS context,
             source || '/' || doc_id::VARCHAR || '.txt' AS filepath, text AS content
      FROM documents""",
    "docfiles": """
      SELECT source || '/' || doc_id::VARCHAR || '.txt' AS path, text AS content FROM documents""",
    "vectors": """
      SELECT vec_id AS id, 'repo' || (label % 2)::VARCHAR AS repository, 'ctx' || (label % 5)::VARCHAR AS context,
             'src' || (vec_id % 20)::VARCHAR || '/' || vec_id::VARCHAR || '.txt' AS filepath, embedding, label
      FROM embeddings""",
    "sitefiles": """
      SELECT path, min(page_id) AS page_id, arg_min(html, page_id) AS content FROM (
        SELECT regexp_replace(regexp_replace(url, '^https?://', ''), '/?([?#].*)?$', '', 'g') AS path, page_id, html
        FROM pages) GROUP BY path""",
    "gofiles": f"""
      SELECT 'f' || p_partkey::VARCHAR || '.go' AS path,
             {SH.sql_by_shape("p_partkey", [g.text for g in SH.GO], k="p_partkey", v="p_size")} AS content FROM part""",
    "hclfiles": f"""
      SELECT 's' || s_suppkey::VARCHAR || '.tf' AS path,
             {SH.sql_by_shape("s_suppkey", [h.text for h in SH.HCL], k="s_suppkey", v="s_nationkey")} AS content FROM supplier""",
    "gofuncs": " UNION ALL ".join(
      f"""SELECT 'f' || p_partkey::VARCHAR || '.go' AS path, 'F' || p_partkey::VARCHAR AS name, {g.func[0]} AS start_line,
             {g.func[1]} AS end_line, {SH.sql(g.decl + g.body + "}", k="p_partkey", v="p_size")} AS content
      FROM part WHERE p_partkey % {len(SH.GO)} = {i}""" for i, g in enumerate(SH.GO)),
    "govars": " UNION ALL ".join(
      f"""SELECT 'f' || p_partkey::VARCHAR || '.go' AS path, {SH.sql(name, k="p_partkey")} AS name, {line} AS start_line,
             {line} AS end_line FROM part WHERE p_partkey % {len(SH.GO)} = {i}"""
      for i, g in enumerate(SH.GO) for name, line in g.vars),
    "hclblocks": " UNION ALL ".join(
      f"""SELECT 's' || s_suppkey::VARCHAR || '.tf' AS path, '{kind}' AS block_type, {SH.sql(name, k="s_suppkey")} AS block_name,
             {first} AS start_line, {last} AS end_line, {SH.sql(text, k="s_suppkey", v="s_nationkey")} AS content
      FROM supplier WHERE s_suppkey % {len(SH.HCL)} = {i}"""
      for i, h in enumerate(SH.HCL) for kind, name, first, last, text in h.blocks),
    "hclattrs": " UNION ALL ".join(
      f"""SELECT 's' || s_suppkey::VARCHAR || '.tf' AS path, {SH.sql(own, k="s_suppkey")} AS block_name, {first} AS block_start,
             '{name}' AS name, {SH.sql(value, k="s_suppkey", v="s_nationkey")} AS value, {line} AS line_no
      FROM supplier WHERE s_suppkey % {len(SH.HCL)} = {i}"""
      for i, h in enumerate(SH.HCL) for own, first, name, value, line in h.attributes),
    "planchanges": """
      SELECT l_orderkey::VARCHAR AS plan_id, o_orderpriority AS query,
             (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, 'f' || l_partkey::VARCHAR || '.go')
              - 1)::INTEGER AS change_index,
             'f' || l_partkey::VARCHAR || '.go' AS path, 'function' AS target_type,
             'F' || l_partkey::VARCHAR AS target_name, '' AS block_content,
             'return ' || l_linenumber::VARCHAR AS new_content, 'line ' || l_linenumber::VARCHAR AS new_comment
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "reviews": """
      SELECT o_orderkey::VARCHAR AS plan_id, o_orderstatus = 'F' AS result, 'status ' || o_orderstatus AS comment
      FROM orders""",
    "ciruns": """
      SELECT event_id AS id, event_type AS name, 'u' || user_id::VARCHAR AS branch, 'completed' AS status,
             CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS conclusion,
             'https://ci.example.com/runs/' || event_id::VARCHAR AS html_url
      FROM events""",
    "ciprs": """
      SELECT user_id AS number, 'Change by user ' || user_id::VARCHAR AS title,
             CASE WHEN user_id % 3 = 0 THEN 'closed' ELSE 'open' END AS state, 'u' || user_id::VARCHAR AS head_ref
      FROM (SELECT DISTINCT user_id FROM events)""",
    "cilogs": """
      SELECT event_id AS run_id, 'https://ci.example.com/logs/' || event_id::VARCHAR AS logs_url
      FROM events WHERE event_type <> 'purchase'""",
}

# Views that depend on other views (ordered after their inputs).
DERIVED: dict[str, tuple[tuple[str, ...], str]] = {
    "state": (("doctable",), "SELECT * FROM doctable WHERE id % 3 <> 0"),
}


def sql(views: list[str] | tuple[str, ...], body: str) -> str:
    """``WITH`` the named views, then ``body``."""
    names: list[str] = []

    def add(n: str) -> None:
        if n in names:
            return
        if n in DERIVED:
            for dep in DERIVED[n][0]:
                add(dep)
        names.append(n)

    for v in views:
        add(v)
    if not names:
        return body
    ctes = ",\n".join(f"{n} AS ({DERIVED[n][1] if n in DERIVED else VIEWS[n]})" for n in names)
    return f"WITH {ctes}\n{body}"


def derived(name: str, deps: tuple[str, ...], text: str) -> None:
    DERIVED[name] = (deps, text)


# L2 and cosine written with explicit left-to-right double arithmetic (not list_distance,
# which returns FLOAT): bit-identical to quarry.functions.vectors.
def l2(a: str, b: str) -> str:
    return (f"sqrt(list_sum(list_transform(range(1, len({a}) + 1), lambda i: "
            f"(({a}[i] - {b}[i])::DOUBLE) * (({a}[i] - {b}[i])::DOUBLE))))")


def dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE))"


def norm(a: str) -> str:
    return f"sqrt(list_sum(list_transform({a}, lambda x: x::DOUBLE * x::DOUBLE)))"


def cosine(a: str, b: str) -> str:
    return f"(1.0 - {dot(a, b)} / nullif({norm(a)} * {norm(b)}, 0))"
