"""DuckDB statements of the vector queries."""

from __future__ import annotations


def elements(source: str, keys: str, value: str = "CAST(value AS DOUBLE)") -> str:
    return f"""
SELECT {keys}, d, {value} + 0.0 AS value FROM (
  SELECT {keys}, unnest(v) AS value, generate_subscripts(v, 1) - 1 AS d FROM {source})"""


NEIGHBOURS = """
FROM (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS a FROM embeddings)
JOIN (SELECT vec_id - 1 AS id, CAST(embedding AS DOUBLE[]) AS b FROM embeddings) USING (id)"""

COPIES = """
copies AS (
  SELECT vec_id AS id, embedding FROM embeddings
  UNION ALL
  SELECT vec_id + 1 + (SELECT max(vec_id) FROM embeddings), embedding
  FROM embeddings WHERE label % 2 = 0)"""


def evenly(shards: int, order: str = "vec_id") -> str:
    return f"ntile({shards}) OVER (ORDER BY {order}) - 1"


SIZES = f"""
sizes AS (
  SELECT shard, size, CAST(coalesce(sum(size) OVER (ORDER BY shard ROWS BETWEEN UNBOUNDED
         PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_id
  FROM (SELECT shard, count(*) AS size FROM (SELECT {evenly(8)} AS shard FROM embeddings)
        GROUP BY shard))"""


def manifest(name: str | None) -> str:
    base = f"data/embeddings/{name}/" if name else (
        "data/embeddings/plain-texts-sentence-given-vectors-64d-"
    )
    return f"""
WITH {SIZES}
SELECT 'text_dir' AS source, 'corpora/plain texts' AS source_path, 'sentence' AS granularity,
       'given vectors' AS model_name, CAST(64 AS BIGINT) AS dim,
       CAST(sum(size) AS BIGINT) AS num_docs,
       least(CAST(sum(size) AS BIGINT), 5000) AS num_query_vectors,
       'docs-shard-{{i}}.vec' AS output_docs_vec, '{base}queries.vec' AS output_queries_vec,
       '2026-01-01T00:00:00Z' AS created_at, count(*) AS num_shards,
       string_agg(CAST(size AS VARCHAR), ',' ORDER BY shard) AS shard_sizes,
       string_agg(CAST(first_id AS VARCHAR), ',' ORDER BY shard) AS shard_doc_offsets,
       {f"'{name}'" if name else 'CAST(NULL AS VARCHAR)'} AS dataset_name
       {'' if name else ', sum(size) = (SELECT count(*) FROM embeddings) AS rows_match'}
FROM sizes"""


STORED_TOTALS = f"""
SELECT vec_id AS id, {evenly(16)} AS shard,
       round(list_sum(CAST(embedding AS DOUBLE[])), 6) + 0.0 AS total FROM embeddings"""

ORACLES = {
    "vec_dot": f"SELECT id, round(list_inner_product(a, b), 6) + 0.0 AS score {NEIGHBOURS}",
    "vec_cosine": f"SELECT id, round(list_cosine_similarity(a, b), 6) + 0.0 AS score {NEIGHBOURS}",
    "vec_normalize": elements(
        """(SELECT id, list_transform(w, lambda x: CAST(CAST(x AS DOUBLE) / n AS FLOAT)) AS v FROM (
          SELECT id, w, sqrt(list_inner_product(CAST(w AS DOUBLE[]), CAST(w AS DOUBLE[]))) AS n
          FROM (SELECT vec_id AS id,
                list_transform(embedding, lambda x: CAST(x * CAST(3 AS FLOAT) AS FLOAT)) AS w
                FROM embeddings)))""",
        "id",
        "round(CAST(value AS DOUBLE), 6)",
    ),
    "vec_fit_dim": elements(
        """(SELECT vec_id AS id, CAST(48 AS BIGINT) AS dim, embedding[1:48] AS v FROM embeddings
          UNION ALL SELECT vec_id, 96, list_resize(embedding, 96, CAST(0 AS FLOAT))
          FROM embeddings)""",
        "id, dim",
    ),
    "vec_parse_json": elements("(SELECT vec_id AS id, embedding AS v FROM embeddings)", "id"),
    "vec_fingerprint": f"""
WITH {COPIES} SELECT id, count(*) OVER (PARTITION BY embedding) AS copies FROM copies""",
    "dim_profile": """
SELECT CAST(len(embedding) AS BIGINT) AS dim, count(*) AS vectors FROM embeddings GROUP BY 1""",
    "mean_pool": """
SELECT CAST(label AS BIGINT) AS label, pos, round(avg(CAST(x AS DOUBLE)), 6) + 0.0 AS value
FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos
      FROM embeddings) GROUP BY ALL""",
    "vec_dedup": f"""
WITH {COPIES}, kept AS (SELECT min(id) AS id FROM copies GROUP BY embedding)
SELECT id, row_number() OVER (ORDER BY id) - 1 AS new_id, {evenly(8, 'id')} AS shard FROM kept""",
    "dedup_counts": f"""
WITH {COPIES}
SELECT count(*) AS total, count(*) - count(DISTINCT embedding) AS duplicates,
       count(DISTINCT embedding) AS unique_vectors FROM copies""",
    "shard_assign": f"SELECT vec_id AS id, {evenly(8)} AS shard FROM embeddings",
    "shard_assign_ceil": """
SELECT vec_id AS id, vec_id // CAST(ceil((SELECT count(*) FROM embeddings) / 8) AS BIGINT) AS shard
FROM embeddings""",
    "shard_sizes": f"WITH {SIZES} SELECT shard, size, first_id FROM sizes",
    "shard_regroup": f"SELECT vec_id AS id, ({evenly(16)}) // 2 AS shard FROM embeddings",
    "shard_ladder": f"""
WITH fine AS (SELECT vec_id AS id, {evenly(16)} AS s FROM embeddings)
SELECT CAST(target AS BIGINT) AS target, s // (16 // target) AS shard, count(*) AS size,
       min(id) AS first_id
FROM fine, (VALUES (8), (4), (2), (1)) AS t(target) GROUP BY ALL""",
    "vec_roundtrip": elements("(SELECT vec_id AS id, embedding AS v FROM embeddings)", "id"),
    "vec_dataset_scan": STORED_TOTALS,
    "vec_publish": STORED_TOTALS,
    "skip_finished": STORED_TOTALS,
    "stream_vec_equals_batch": STORED_TOTALS,
    "vec_pushdown": f"SELECT * FROM ({STORED_TOTALS}) WHERE id BETWEEN 40 AND 399 AND shard IN (3, 9)",
    "vec_places": f"SELECT id, shard FROM ({STORED_TOTALS})",
    "vec_lenient": """
WITH flat AS (
  SELECT vec_id * 64 + generate_subscripts(embedding, 1) - 1 AS place, unnest(embedding) AS value
  FROM embeddings)
SELECT place // 63 AS id, place % 63 AS d, CAST(value AS DOUBLE) + 0.0 AS value FROM flat
WHERE place // 63 < (SELECT count(*) FROM flat) // 63""",
    "manifest": manifest(None),
    "manifest_read": manifest("given"),
    "dataset_dedup": f"""
SELECT vec_id AS id, ({evenly(16)}) // 2 AS shard,
       round(list_sum(CAST(embedding AS DOUBLE[])), 6) + 0.0 AS total FROM embeddings""",
}
