"""DuckDB SQL for the queries that SQL can express, written apart from the operators."""

from __future__ import annotations

from quillvec.llm.quality_rules import STOP_WORDS

_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)

OP6 = rf"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), worded AS (
  SELECT doc_id, t,
         regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM base
), windows AS (
  SELECT doc_id, i, list_slice(w, i, i + 4) AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM worded WHERE len(w) >= 5)
), repeated AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM windows)
  WHERE c > 1
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n
  FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM repeated) GROUP BY doc_id
), counted AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words,
         len(lines) AS n_lines,
         len(list_filter(w, lambda x: lower(x) IN ({_STOPS}))) AS stops
  FROM worded LEFT JOIN covered USING (doc_id)
), judged AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         (n_words < 10 OR word_chars / n_words BETWEEN 2.0 AND 20.0)
         AND n_symbols / greatest(n_words, 1) <= 0.10
         AND (n_words < 100 OR stops / n_words >= 0.005)
         AND (n_words < 50 OR n_dup_lines / greatest(n_lines, 1) <= 0.60) AS passes
  FROM counted
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND passes AS kept
FROM judged
"""

OP8 = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t
  FROM documents
), k AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY t ORDER BY chars DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY t) AS group_size
  FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM k
"""

# The 32-bit cyclic redundancy check of a decimal number, bit by bit.
_CRC = """xor(list_reduce(
  list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT),
  lambda acc, ch: list_reduce(
    [0::BIGINT, 0, 0, 0, 0, 0, 0, 0],
    lambda a, i: xor(a >> 1, 3988292384::BIGINT * (a & 1)), xor(acc, ch)),
  4294967295::BIGINT), 4294967295::BIGINT)"""

OP12 = rf"""
WITH own AS (
  SELECT conv_id, {{'r': coalesce(role, ''), 't': coalesce(text, '')}} AS said,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), listed AS (
  SELECT conv_id, list(said ORDER BY pos) AS turns, {_CRC} % 6 AS h FROM own GROUP BY conv_id
), rebuilt AS (
  SELECT c.conv_id,
         list_concat(coalesce(list_slice(f.turns, 1, c.h), []), coalesce(list_slice(c.turns, c.h + 1, len(c.turns)), [])) AS turns
  FROM listed c LEFT JOIN listed f ON f.conv_id = c.conv_id - c.conv_id % 100
), prefixes AS (
  SELECT conv_id, d AS depth, list_slice(turns, 1, d) AS prefix, d = len(turns) AS ends,
         CASE WHEN d > 0 THEN list_slice(turns, 1, d - 1) END AS up
  FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT prefix, depth, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM prefixes GROUP BY prefix, depth
), kids AS (
  SELECT up, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY up
), counted AS (
  SELECT n.*, coalesce(k.n_children, 0) AS n_children,
         CASE WHEN n.depth > 0 THEN (n.n_convs - 1) * length(n.prefix[n.depth].t) ELSE 0 END AS own_saved
  FROM nodes n LEFT JOIN kids k ON k.up = n.prefix
), above AS (
  SELECT list_slice(prefix, 1, d) AS prefix, n_children = 0 AS leaf, own_saved
  FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM counted)
), subtrees AS (
  SELECT prefix, count(*) FILTER (leaf) AS n_leaves, sum(own_saved)::BIGINT AS saved_tokens
  FROM above GROUP BY prefix
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM counted n JOIN subtrees s ON s.prefix = n.prefix LEFT JOIN nodes p ON p.prefix = n.up
"""

ORACLES = {"op6_quality_rules": OP6, "op8_exact_dedup": OP8, "op12_conversation_trie": OP12}
