"""The corpus operators as registered queries over whole tables, with DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quarry.llm import conversation_repair, conversation_sql, decontaminate, exact_dedup, html_extract, jaccard_join, line_dedup, mixing, prefix_trie, quality, substring_dedup, suffix_dedup, token_store, toxicity
from quarry.llm.common import table

#: The tokenizer file, the same path on every machine.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("char_from", "char_to")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.report(table(spark, sf_dir, "documents"), TOKENIZER)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link(table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.report(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("copies")


def op11_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages")).drop("n_blocks", "n_content")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.nodes(table(spark, sf_dir, "conversations"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.report(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontaminate, op2_toxicity, op3_token_store, op4_exact_dedup, op5_quality, op6_jaccard_join, op7_suffix_dedup, op8_line_dedup, op9_substring_dedup, op10_mixing,
        op11_html_extract, op12_prefix_trie, op13_conversation_repair,
    )
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLE_SQL: dict[str, str] = {
    "op1_decontaminate": f"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM documents),
b AS (
  SELECT item_id, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM benchmark),
bp AS (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, i, i + 9), ' ') AS s, least(len(w), 10) AS k FROM bp),
ks AS (SELECT DISTINCT k FROM bw),
dp AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k),
h AS (SELECT dw.doc_id, dw.i, dw.k, bw.item_id FROM (SELECT doc_id, i, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS s FROM dp) dw JOIN bw ON dw.s = bw.s AND dw.k = bw.k),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(t, ',' ORDER BY t) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS t FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op4_exact_dedup": f"""
WITH n AS (SELECT doc_id, coalesce(length(text), 0) AS l, translate(coalesce(text, ''), {_BLANKS}, '') AS t FROM documents),
r AS (SELECT *, first_value(doc_id) OVER (PARTITION BY t ORDER BY l DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM n)
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM r""",
    "op6_jaccard_join": f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n + b.n - k)),
l AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT l.y, r.c FROM r JOIN l ON r.doc_id = l.x WHERE r.c < l.y)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, m.c AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m USING (doc_id)""",
    "op8_line_dedup": """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(l) - 1)) AS i, l FROM d WHERE len(l) >= 3),
w AS (SELECT doc_id, i, list_slice(l, i, i + 2) AS s FROM p),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM w),
g AS (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS x FROM r WHERE k > 1),
e AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS x, l FROM d),
k AS (SELECT e.doc_id, string_agg(e.l[e.x], chr(10) ORDER BY e.x) FILTER (g.x IS NULL) AS kept, count(*) AS n, count(g.x) AS gone FROM e LEFT JOIN g ON e.doc_id = g.doc_id AND e.x = g.x GROUP BY e.doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_lines, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)""",
    "op9_substring_dedup": """
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(list_slice(w, i, i + 19), ' ') ORDER BY doc_id, i) AS k FROM p),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS x FROM r WHERE k > 1),
e AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS x FROM d),
k AS (SELECT e.doc_id, count(g.x) AS gone, string_agg(e.w[e.x], ' ' ORDER BY e.x) FILTER (g.x IS NULL) AS kept FROM e LEFT JOIN g ON e.doc_id = g.doc_id AND e.x = g.x GROUP BY e.doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)""",
    "op10_mixing": """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
                  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT + 1] AS w, source_size::DOUBLE * 3 AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
m AS (SELECT max(level) AS level FROM l WHERE level * w <= cap),
t AS (SELECT source, source_size, least(cap, coalesce(m.level * w, cap)) AS target FROM l, m),
c AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::INT ELSE 0 END AS copies FROM t),
b AS (SELECT source, source_size, target, copies, target - copies * source_size AS budget FROM c),
r AS (SELECT d.*, b.source_size, b.target, b.copies, b.budget, sum(size) OVER (PARTITION BY d.source ORDER BY h) AS upto,
             sum(size) OVER (PARTITION BY d.source, h) AS tied FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source),
e AS (SELECT *, CASE WHEN upto <= budget OR (upto - tied <= budget AND upto - budget < budget - (upto - tied)) THEN 1 ELSE 0 END AS extra FROM r)
SELECT doc_id, size, source_size, target, ((copies + extra) * size)::BIGINT AS taken FROM e""",
    "op12_prefix_trie": conversation_sql.PREFIX_TRIE,
    "op13_conversation_repair": conversation_sql.CONVERSATION_REPAIR,
}
