"""DuckDB statements of the text queries, written from the rules, not from the code."""

from __future__ import annotations

from quillvec.plans.tables import DIM

_SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def marked(x: str) -> str:
    """Put chr(1) where a sentence ends, then take it back after abbreviations."""
    cut = rf"regexp_replace({x}, '([.?!])({_SPACE})', '\1' || chr(1) || '\2', 'g')"
    cut = rf"regexp_replace({cut}, '([\p{{L}}\p{{N}}_]\.[\p{{L}}\p{{N}}_].)' || chr(1), '\1', 'g')"
    return rf"regexp_replace({cut}, '([A-Z][a-z]\.)' || chr(1), '\1', 'g')"


def stripped_parts(x: str, delimiter: str) -> str:
    return f"list_transform(string_split({x}, {delimiter}), lambda p: {strip('p')})"


BREAK = "chr(10) || chr(10)"
BLOCKS = f"list_filter({stripped_parts('text', BREAK)}, lambda b: length(b) > 20)"
SENTENCE_LIST = (
    f"list_filter(flatten(list_transform({BLOCKS}, "
    f"lambda b: list_transform(string_split({marked('b')}, chr(1)), lambda s: {strip('s')}))), "
    "lambda s: length(s) >= 10)"
)


def exploded(source: str, key: str = "doc_id", items: str = "items") -> str:
    return (
        f"SELECT {key}, unnest({items}) AS text, "
        f"generate_subscripts({items}, 1) - 1 AS pos FROM {source}"
    )


SENTENCES = f"""
sentence_lists AS (SELECT doc_id, {SENTENCE_LIST} AS items FROM documents),
sentences AS ({exploded('sentence_lists')})"""


def wrapped(source: str) -> str:
    """Recursive CTE body: pieces of ``source(doc_id, ord, rest)`` in order ``step``."""
    cut = (
        "CASE WHEN length({r}) <= 1024 THEN length({r}) "
        "WHEN strpos(reverse(substr({r}, 1, 1024)), ' ') BETWEEN 1 AND 1023 "
        "THEN 1024 - strpos(reverse(substr({r}, 1, 1024)), ' ') ELSE 1024 END"
    )
    cut = cut.format(r="rest")
    rest = f"regexp_replace(substr(rest, ({cut}) + 1), '^{_SPACE}+', '')"
    return f"""
  SELECT doc_id, ord, 0 AS step, substr(rest, 1, {cut}) AS piece, {rest} AS rest FROM {source}
  UNION ALL
  SELECT doc_id, ord, step + 1, substr(rest, 1, {cut}), {rest} FROM w WHERE rest <> ''"""


def paragraph_ctes(delimiter: str) -> str:
    parts = f"list_filter({stripped_parts('text', delimiter)}, lambda p: length(p) >= 20)"
    return f"""
base AS (SELECT doc_id, {parts} AS parts, {SENTENCE_LIST} AS sents FROM documents),
triples AS (
  SELECT doc_id, i, sents[i:i + 2] AS trio, array_to_string(sents[i:i + 2], ' ') AS whole
  FROM (SELECT doc_id, sents, unnest(range(1, len(sents) + 1, 3)) AS i
        FROM base WHERE len(parts) <= 1 AND len(sents) > 0)),
halves AS (
  SELECT doc_id, i * 2 AS ord, CASE WHEN length(whole) > 1024 AND len(trio) > 1
           THEN array_to_string(trio[1:len(trio) // 2], ' ') ELSE whole END AS rest FROM triples
  UNION ALL
  SELECT doc_id, i * 2 + 1, array_to_string(trio[len(trio) // 2 + 1:], ' ')
  FROM triples WHERE length(whole) > 1024 AND len(trio) > 1),
w AS ({wrapped('halves')}),
taken AS ({exploded('(SELECT doc_id, parts AS items FROM base WHERE len(parts) > 1 OR len(sents) = 0)')}),
paragraphs AS (
  SELECT doc_id, pos, text FROM taken
  UNION ALL
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord, step) - 1, piece
  FROM w WHERE length(piece) >= 20)"""


PARAGRAPHS = paragraph_ctes(BREAK)


def embedded(chunks: str, dim: int = DIM, name: str = "emb") -> str:
    """CTEs giving ``{name}(doc_id, pos, d, value)``: hashed word counts, unit length."""
    return f"""
{name}_words AS (
  SELECT doc_id, pos, unnest(regexp_split_to_array(lower(text), '[ \\n]+')) AS word FROM {chunks}),
{name}_counts AS (
  SELECT doc_id, pos, CAST('0x' || substr(md5(word), 1, 8) AS BIGINT) % {dim} AS d,
         CAST(count(*) AS DOUBLE) AS n
  FROM {name}_words WHERE word <> '' GROUP BY ALL),
{name} AS (
  SELECT doc_id, pos, d,
         CAST(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id, pos)) AS FLOAT) AS value
  FROM {name}_counts)"""


def numbered(chunks: str) -> str:
    return f"SELECT *, row_number() OVER (ORDER BY doc_id, pos) - 1 AS id FROM {chunks}"


def _set_profile(dim: int, granularity: str) -> str:
    chunks = granularity + "s"
    return f"""
SELECT '{dim}-{granularity}' AS dataset_name, '{granularity}' AS granularity,
       CAST({dim} AS BIGINT) AS dim, CAST(16 AS BIGINT) AS num_shards, n AS num_docs,
       least(n, 5000) AS num_query_vectors, n // 16 AS smallest_shard,
       (n + 15) // 16 AS largest_shard,
       (SELECT count(*) FROM (SELECT DISTINCT doc_id, pos,
          CAST('0x' || substr(md5(word), 1, 8) AS BIGINT) % {dim} AS d
          FROM {granularity}_words WHERE word <> '')) AS filled
FROM (SELECT count(*) AS n FROM {chunks})"""


def _words(granularity: str) -> str:
    return f"""{granularity}_words AS (
  SELECT doc_id, pos, unnest(regexp_split_to_array(lower(text), '[ \\n]+')) AS word
  FROM {granularity}s)"""


NEAREST = f"""
WITH RECURSIVE {PARAGRAPHS}, {embedded('paragraphs')},
chunks AS ({numbered('paragraphs')}),
vecs AS (
  SELECT c.id, c.doc_id, c.text,
         list_transform(range({DIM}), lambda j:
           CAST(coalesce(m[j], 0) AS DOUBLE)) AS v
  FROM chunks c LEFT JOIN (
    SELECT doc_id, pos, map_from_entries(list((d, value))) AS m FROM emb GROUP BY ALL
  ) e USING (doc_id, pos)),
scored AS (
  SELECT q.id AS qid, x.id, list_inner_product(q.v, x.v) AS s
  FROM vecs q, vecs x WHERE q.id < 5000),
ranked AS (
  SELECT qid, id, s, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS rank
  FROM scored QUALIFY rank <= 10)"""

EMBEDDED_CHUNKS = f"""
WITH {SENTENCES}, {embedded('sentences')}
SELECT doc_id, pos, d, round(CAST(value AS DOUBLE), 6) AS value FROM emb"""

ORACLES = {
    "src_jsonl": """
SELECT row_number() OVER (ORDER BY doc_id) - 1 AS doc_id, length(text) AS n_chars, text
FROM documents WHERE text <> ''""",
    "src_jsonl_all": """
SELECT row_number() OVER (ORDER BY doc_id) - 1 AS doc_id, text FROM documents WHERE text <> ''""",
    "src_jsonl_first": """
SELECT row_number() OVER (ORDER BY doc_id) - 1 AS doc_id, text FROM documents WHERE text <> ''
ORDER BY doc_id LIMIT 60""",
    "src_jsonl_strict": """
SELECT row_number() OVER (ORDER BY doc_id) - 1 AS doc_id,
       CASE WHEN doc_id % 8 = 3 THEN '0' ELSE text END AS text
FROM documents WHERE doc_id % 8 IN (3, 6, 7) AND (doc_id % 8 = 3 OR text <> '')""",
    "src_text_dir": f"""
SELECT row_number() OVER (ORDER BY 'doc_id=' || doc_id || '/') - 1 AS doc_id,
       length(text) + 1 AS n_chars, text || chr(10) AS text
FROM documents WHERE {strip('text')} <> ''""",
    "src_messages": f"""
WITH l AS (SELECT conv_id, turn, string_split(text, chr(10)) AS items FROM conversations),
m AS ({exploded('l', 'conv_id, turn')})
SELECT row_number() OVER (ORDER BY conv_id, turn, pos) - 1 AS doc_id, {strip('text')} AS text
FROM m WHERE {strip('text')} <> ''""",
    "message_chunks": f"""
WITH l AS (SELECT conv_id, turn, string_split(text, chr(10)) AS items FROM conversations),
m AS ({exploded('l', 'conv_id, turn')})
SELECT conv_id, turn, pos AS line, {strip('text')} AS text FROM m WHERE {strip('text')} <> ''""",
    "corpus_jsonl": f"""
SELECT CAST(json_object('text', text) AS VARCHAR) AS value
FROM documents WHERE {strip('text')} <> ''""",
    "first_n_docs": f"""
SELECT doc_id, text FROM documents WHERE {strip('text')} <> '' ORDER BY doc_id LIMIT 100""",
    "chunk_sentences": f"WITH {SENTENCES} SELECT doc_id, pos, text FROM sentences",
    "chunk_paragraphs": f"WITH RECURSIVE {PARAGRAPHS} SELECT doc_id, pos, text FROM paragraphs",
    "chunk_paragraphs_delim": f"""
WITH RECURSIVE {paragraph_ctes('chr(10)')} SELECT doc_id, pos, text FROM paragraphs""",
    "chunk_wrap": f"""
WITH RECURSIVE t AS (SELECT doc_id, 0 AS ord, {strip('text')} AS rest FROM documents),
w AS ({wrapped('t')}) SELECT doc_id, CAST(step AS BIGINT) AS pos, piece AS text FROM w""",
    "corpus_profile": f"""
WITH RECURSIVE {SENTENCES}, {PARAGRAPHS},
s AS (SELECT doc_id, count(*) AS n FROM sentences GROUP BY 1),
p AS (SELECT doc_id, count(*) AS n FROM paragraphs GROUP BY 1)
SELECT lang, count(*) AS documents, CAST(sum(coalesce(s.n, 0)) AS BIGINT) AS sentences,
       CAST(sum(coalesce(p.n, 0)) AS BIGINT) AS paragraphs,
       round(avg(length(text)), 6) AS avg_chars
FROM documents LEFT JOIN s USING (doc_id) LEFT JOIN p USING (doc_id) GROUP BY lang""",
    "embed_chunks": EMBEDDED_CHUNKS,
    "embed_retried": EMBEDDED_CHUNKS,
    "doc_vectors": f"""
WITH {SENTENCES}, {embedded('sentences')},
kept AS (SELECT doc_id, count(*) FILTER (length(text) >= 40) AS n FROM sentences GROUP BY 1),
sums AS (
  SELECT doc_id, d, sum(CAST(value AS DOUBLE)) AS total
  FROM emb JOIN sentences USING (doc_id, pos) WHERE length(text) >= 40 GROUP BY ALL)
SELECT doc_id, pos, round(coalesce(total, 0) / greatest(n, 1e-9), 6) + 0.0 AS value
FROM (SELECT doc_id, n, unnest(range({DIM})) AS pos FROM kept)
LEFT JOIN (SELECT doc_id, d AS pos, total FROM sums) USING (doc_id, pos)""",
    "chunk_ids": f"""
WITH {SENTENCES}
SELECT id AS chunk_id, doc_id, pos, length(text) AS n_chars FROM ({numbered('sentences')})""",
    "query_set": f"""
WITH RECURSIVE {PARAGRAPHS}, {embedded('paragraphs')},
ids AS ({numbered('(SELECT doc_id, pos FROM paragraphs)')})
SELECT id AS qid, d, round(CAST(value AS DOUBLE), 6) AS value
FROM emb JOIN ids USING (doc_id, pos) WHERE id < 5000""",
    "embedding_sets": f"""
WITH RECURSIVE {SENTENCES}, {PARAGRAPHS}, {_words('sentence')}, {_words('paragraph')}
{" UNION ALL ".join(_set_profile(d, g) for d in (1024, 384) for g in ("sentence", "paragraph"))}""",
    "knn_corpus": f"{NEAREST} SELECT qid, rank, id, round(s, 9) AS score FROM ranked",
    "knn_with_text": f"""
{NEAREST} SELECT qid, rank, id, doc_id, text FROM ranked JOIN vecs USING (id)""",
    "stream_equals_batch": f"WITH {SENTENCES} SELECT doc_id, pos, text FROM sentences",
    "stream_embed": f"""
WITH RECURSIVE {PARAGRAPHS}, {embedded('paragraphs')}
SELECT doc_id, pos, d, round(CAST(value AS DOUBLE), 6) AS value FROM emb""",
}
