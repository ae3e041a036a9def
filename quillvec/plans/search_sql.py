"""DuckDB statements of the search and report queries."""

from __future__ import annotations

from quillvec.plans.tables import LSH_BITS, LSH_TABLES, MAX_K, PROBES
from quillvec.plans.vector_sql import evenly

QUERY_IDS = "SELECT vec_id AS qid FROM embeddings WHERE vec_id < 5000"

SCORED = f"""
vecs AS (
  SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, {evenly(8)} AS shard FROM embeddings),
scored AS (
  SELECT q.id AS qid, x.id, x.shard, list_inner_product(q.v, x.v) AS s
  FROM vecs q, vecs x WHERE q.id < 5000)"""


def ranked(name: str, source: str, k: int, keys: str = "qid") -> str:
    return f"""
{name} AS (
  SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY s DESC, id) AS rank
  FROM {source} QUALIFY rank <= {k})"""


HASH_CANDIDATES = f"""
planes AS (
  SELECT t, b, d, CASE WHEN substr(md5(t || ':' || b || ':' || d), 1, 1) >= '8'
                       THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sign
  FROM range({LSH_TABLES}) AS r1(t), range({LSH_BITS}) AS r2(b), range(64) AS r3(d)),
parts AS (
  SELECT vec_id AS id, CAST(unnest(embedding) AS DOUBLE) AS x,
         generate_subscripts(embedding, 1) - 1 AS d FROM embeddings),
sides AS (
  SELECT id, t, b, sum(x * sign) >= 0 AS up FROM parts JOIN planes USING (d) GROUP BY ALL),
codes AS (SELECT id, t, sum(CASE WHEN up THEN 1 << b ELSE 0 END) AS code FROM sides GROUP BY ALL),
hash_pairs AS (
  SELECT DISTINCT q.id AS qid, x.id FROM codes q JOIN codes x USING (t, code) WHERE q.id < 5000),
hash_scored AS (SELECT s.* FROM scored s JOIN hash_pairs USING (qid, id))"""

CELL_CANDIDATES = f"""
means AS (
  SELECT label, list(m ORDER BY pos) AS c FROM (
    SELECT label, pos, avg(CAST(x AS DOUBLE)) AS m
    FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos
          FROM embeddings) GROUP BY ALL) GROUP BY label),
near AS (
  SELECT id, label, row_number() OVER (
           PARTITION BY id ORDER BY list_inner_product(v, c) DESC, label) AS place
  FROM vecs, means),
cell_scored AS (
  SELECT s.* FROM scored s
  JOIN near q ON q.id = s.qid AND q.place <= {PROBES}
  JOIN near x ON x.id = s.id AND x.place = 1 AND x.label = q.label)"""

KS_TABLE = "(VALUES (10), (100)) AS t(k)"


def overlap(found: str) -> str:
    """``(k, qid, overlap, retrieved, relevant)`` of ``found`` against ``exact``."""
    return f"""
SELECT CAST(k AS BIGINT) AS k, qid,
  (SELECT count(*) FROM {found} f JOIN exact e USING (qid, id)
   WHERE f.qid = q.qid AND f.rank <= k AND e.rank <= k) AS overlap,
  (SELECT count(*) FROM {found} f WHERE f.qid = q.qid AND f.rank <= k) AS retrieved,
  (SELECT count(*) FROM exact e WHERE e.qid = q.qid AND e.rank <= k) AS relevant
FROM ({QUERY_IDS}) q, {KS_TABLE}"""


def report_ctes(scored: str, name: str) -> str:
    return f"""
{ranked(f'{name}_hits', scored, MAX_K)},
{name}_overlap AS ({overlap(f'{name}_hits')}),
{name}_saved AS (
  SELECT CAST(floor(avg(saved)) AS BIGINT) AS lookups_saved FROM (
    SELECT q.qid, (SELECT count(*) FROM embeddings) - count(s.id) AS saved
    FROM ({QUERY_IDS}) q LEFT JOIN {scored} s USING (qid) GROUP BY q.qid)),
{name}_report AS (
  SELECT k, round(avg(CASE WHEN retrieved = 0 THEN 0 ELSE overlap / retrieved END), 4)
           AS merged_recall,
         round(avg(CASE WHEN relevant = 0 THEN 0 ELSE overlap / relevant END), 4) AS recall_at_k,
         (SELECT lookups_saved FROM {name}_saved) AS lookups_saved,
         (SELECT count(*) FROM embeddings) AS num_docs,
         CAST(8 AS BIGINT) AS num_shards, count(*) AS num_queries
  FROM {name}_overlap GROUP BY k)"""


HASH_REPORT = f"""
WITH {SCORED}, {ranked('exact', 'scored', MAX_K)}, {HASH_CANDIDATES},
{report_ctes('hash_scored', 'hash')}"""


def sweep(shards: int) -> str:
    return f"""
SELECT CAST({shards} AS BIGINT) AS num_shards, k,
  (SELECT count(*) FROM (
     SELECT row_number() OVER (PARTITION BY qid, n.shard ORDER BY s DESC, id) AS rank
     FROM hash_scored JOIN (SELECT vec_id AS id, {evenly(shards)} AS shard FROM embeddings) n
     USING (id)) WHERE rank <= k) AS gathered,
  merged_recall, num_queries FROM hash_report"""


SNAPSHOT_FLOOR = f"""
WITH {SCORED}, {ranked('hits', 'scored', MAX_K, 'qid, shard')},
latest AS (SELECT * EXCLUDE (rank) FROM hits WHERE rank <= CASE WHEN shard % 2 = 0 THEN 100 ELSE 10 END),
{ranked('merged', 'latest', MAX_K)}
SELECT qid, (SELECT count(DISTINCT shard) FROM latest l WHERE l.qid = m.qid) AS shards,
       count(*) AS merged, round(min(s), 9) + 0.0 AS floor
FROM merged m GROUP BY qid"""

PLAIN_TOP = f"""
WITH {SCORED}, {ranked('exact', 'scored', 10)}
SELECT qid, rank, id, round(s, 9) + 0.0 AS score FROM exact"""



def rescaled(factor: str, score: str, unit: str) -> str:
    """The ten best after a change of lengths, by another score."""
    return f"""
WITH vecs AS (
  SELECT vec_id AS id, CAST(list_transform(embedding, lambda x: CAST(CAST(x AS DOUBLE) * {factor} AS FLOAT))
         AS DOUBLE[]) AS v FROM embeddings),
scored AS (SELECT q.id AS qid, x.id, {score} AS s FROM vecs q, vecs x WHERE q.id < 5000),
{ranked('exact', 'scored', 10)}
SELECT qid, rank, id, round(s * {unit}, 9) + 0.0 AS score FROM exact"""


COSINE = (
    "list_inner_product(q.v, x.v)"
    " / (sqrt(list_inner_product(q.v, q.v)) * sqrt(list_inner_product(x.v, x.v)))"
)

# Blocks of 64 in falling order of length; a block counts unless its longest vector stays below the floor.
AB_PRUNED = f"""
WITH scaled AS (
  SELECT vec_id AS id, {evenly(8)} AS shard,
         CAST(list_transform(embedding, lambda x: CAST(CAST(x AS DOUBLE) * pow(vec_id % 7 + 1, 2) AS FLOAT))
         AS DOUBLE[]) AS v FROM embeddings),
vecs AS (SELECT *, sqrt(list_inner_product(v, v)) AS len FROM scaled),
placed AS (SELECT *, (row_number() OVER (ORDER BY len DESC, id) - 1) // 64 AS block FROM vecs),
blocks AS (SELECT *, max(len) OVER (PARTITION BY block) AS reach FROM placed),
scored AS (
  SELECT q.id AS qid, q.len * x.reach * (1 + 1e-6) AS bound, x.id, x.shard, list_inner_product(q.v, x.v) AS s
  FROM vecs q, blocks x WHERE q.id < 5000),
{ranked('per_shard', 'scored', 10, 'qid, shard')},
floors AS (SELECT qid, s AS floor FROM per_shard WHERE shard = 0 AND rank = 10),
floored AS (SELECT * FROM scored LEFT JOIN floors USING (qid) WHERE s >= coalesce(floor, -1e308)),
{ranked('kept', 'floored', 10, 'qid, shard')},
{ranked('best_a', '(SELECT * EXCLUDE (rank) FROM per_shard)', 10)},
{ranked('best_b', '(SELECT * EXCLUDE (rank) FROM kept)', 10)},
recalls AS (
  SELECT q.qid, (SELECT count(*) FROM best_a a JOIN best_b b USING (qid, id) WHERE a.qid = q.qid)
         / (SELECT count(*) FROM best_b b WHERE b.qid = q.qid) AS recall
  FROM ({QUERY_IDS}) q)
SELECT CAST(10 AS BIGINT) AS k, count(*) AS num_queries, CAST(1.0 AS DOUBLE) AS merged_recall_a,
       round(avg(recall), 4) AS merged_recall_b,
       (SELECT count(*) FROM scored) AS scored_a,
       (SELECT count(*) FROM scored LEFT JOIN floors USING (qid) WHERE bound >= coalesce(floor, -1e308))
       + count(*) * (SELECT count(*) FROM vecs WHERE shard = 0) AS scored_b,
       (SELECT count(*) FROM per_shard) AS handed_a, (SELECT count(*) FROM kept) AS handed_b
FROM recalls"""

CELL_TOP = f"""
WITH {SCORED}, {CELL_CANDIDATES}, {ranked('hits', 'cell_scored', 10)}
SELECT qid, rank, id, round(s, 9) + 0.0 AS score FROM hits"""

HASH_TOP = f"""
WITH {SCORED}, {HASH_CANDIDATES}, {ranked('hits', 'hash_scored', 10)}
SELECT qid, rank, id, round(s, 9) + 0.0 AS score FROM hits"""

ORACLES = {
    "knn_exact": PLAIN_TOP,
    "knn_per_shard": f"""
WITH {SCORED}, {ranked('hits', 'scored', 10, 'qid, shard')}
SELECT qid, shard, rank, id, round(s, 9) + 0.0 AS score FROM hits""",
    "knn_merge": PLAIN_TOP,
    "knn_small_norms": rescaled("1e-5", "list_inner_product(q.v, x.v)", "1e10"),
    "knn_cosine": rescaled("(vec_id % 7 + 1)", COSINE, "1.0"),
    "knn_zones": rescaled("pow(vec_id % 7 + 1, 2)", "list_inner_product(q.v, x.v)", "1e-3"),
    "ab_pruned": AB_PRUNED,
    "knn_stored_queries": PLAIN_TOP,
    "knn_multi_k": f"""
WITH {SCORED}, {ranked('exact', 'scored', MAX_K)}
SELECT CAST(k AS BIGINT) AS k, qid, rank, id, round(s, 9) + 0.0 AS score
FROM exact JOIN {KS_TABLE} ON rank <= k""",
    "knn_large_k": f"""
WITH {SCORED}, {ranked('exact', 'scored', 10000)}
SELECT CAST(k AS BIGINT) AS k, qid, count(*) AS hits, round(min(s), 9) + 0.0 AS last,
       CAST(sum(id) AS BIGINT) AS ids
FROM exact JOIN (VALUES (1000), (10000)) AS t(k) ON rank <= k GROUP BY k, qid""",
    "search_report_few": f"""
{HASH_REPORT},
few AS (SELECT * FROM hash_overlap WHERE qid < 120),
few_saved AS (
  SELECT CAST(floor(avg(saved)) AS BIGINT) AS lookups_saved FROM (
    SELECT q.qid, (SELECT count(*) FROM embeddings) - count(s.id) AS saved
    FROM ({QUERY_IDS}) q LEFT JOIN hash_scored s USING (qid) WHERE q.qid < 120 GROUP BY q.qid))
SELECT k, round(avg(CASE WHEN retrieved = 0 THEN 0 ELSE overlap / retrieved END), 4) AS merged_recall,
       round(avg(CASE WHEN relevant = 0 THEN 0 ELSE overlap / relevant END), 4) AS recall_at_k,
       (SELECT lookups_saved FROM few_saved) AS lookups_saved,
       (SELECT count(*) FROM embeddings) AS num_docs, CAST(8 AS BIGINT) AS num_shards,
       count(*) AS num_queries
FROM few GROUP BY k""",
    "knn_lsh": HASH_TOP,
    "knn_lsh_postings": HASH_TOP,
    "knn_ivf": CELL_TOP,
    "knn_ivf_stored": CELL_TOP,
    "knn_floor_pruned": PLAIN_TOP,
    "lookups_saved": f"""
WITH {SCORED}, {HASH_CANDIDATES},
sizes AS (SELECT shard, count(*) AS size FROM vecs GROUP BY shard),
slots AS (SELECT qid, shard, size FROM ({QUERY_IDS}), sizes),
counts AS (SELECT qid, shard, count(*) AS n FROM hash_scored GROUP BY ALL)
SELECT qid, shard, size, coalesce(n, 0) AS scored, greatest(0, size - coalesce(n, 0)) AS saved
FROM slots LEFT JOIN counts USING (qid, shard)""",
    "knn_overlap": f"{HASH_REPORT} SELECT * FROM hash_overlap",
    "knn_recall": f"""
{HASH_REPORT}
SELECT k, qid,
  round(CASE WHEN retrieved = 0 THEN 0 ELSE overlap / retrieved END, 6) + 0.0 AS recall,
  round(CASE WHEN relevant = 0 THEN 0 ELSE overlap / relevant END, 6) + 0.0 AS recall_at_k
FROM hash_overlap""",
    "search_report": f"{HASH_REPORT} SELECT * FROM hash_report",
    "dataset_report": f"{HASH_REPORT} SELECT * FROM hash_report",
    "summary_lines": f"""
{HASH_REPORT}
SELECT k, concat_ws(chr(9), 'SUMMARY', 'embeddings', k, 'N/A', 'N/A', 'N/A',
       format('{{:.4f}}', merged_recall), lookups_saved, num_docs, num_shards, num_queries) AS line
FROM hash_report""",
    "topk_dump": f"""
WITH {SCORED}, {ranked('exact', 'scored', MAX_K)}
SELECT 'K=' || k || chr(9) || 'q=' || qid || chr(9) || 'ids='
       || string_agg(CAST(id AS VARCHAR), ',' ORDER BY rank) AS line
FROM exact JOIN {KS_TABLE} ON rank <= k GROUP BY k, qid""",
    "ab_compare": f"""
{HASH_REPORT}, {CELL_CANDIDATES}, {report_ctes('cell_scored', 'cell')}
SELECT a.k, a.merged_recall AS merged_recall_a, a.lookups_saved AS lookups_saved_a,
       b.merged_recall AS merged_recall_b, b.lookups_saved AS lookups_saved_b,
       round(b.merged_recall - a.merged_recall, 4) + 0.0 AS merged_recall_delta,
       b.lookups_saved - a.lookups_saved AS lookups_saved_delta
FROM hash_report a JOIN cell_report b USING (k)""",
    "shard_sweep": f"{HASH_REPORT} " + " UNION ALL ".join(sweep(n) for n in (1, 2, 4, 8)),
    "snapshot_floor": SNAPSHOT_FLOOR,
    "stream_snapshot_floor": SNAPSHOT_FLOOR,
    "run_log_report": """
WITH log AS (
  SELECT CAST(CASE WHEN event_type IN ('view', 'click') THEN 100 ELSE 10 END AS BIGINT) AS k,
         user_id AS qid, CAST(floor(value) AS BIGINT) AS ms,
         CASE WHEN event_type = 'error' THEN NULL
              ELSE greatest(0, 500 - CAST(floor(value * 7) AS BIGINT)) END AS saved
  FROM events),
per_query AS (
  SELECT k, qid, max(ms) AS high, min(ms) AS low, avg(ms) AS mean, stddev_pop(ms) AS dev,
         sum(saved) AS saved
  FROM log GROUP BY k, qid)
SELECT k, count(*) AS num_queries, CAST(sum(high) // count(*) AS BIGINT) AS latency_ms,
       round(avg(mean), 6) AS avg_shard_ms, round(avg(dev), 6) AS stddev_ms,
       round(avg(low), 6) AS min_shard_ms, round(avg(high), 6) AS max_shard_ms,
       CAST(sum(saved) // count(saved) AS BIGINT) AS lookups_saved
FROM per_query GROUP BY k""",
    "batch_progress": """
WITH sums AS (
  SELECT event_type AS run, event_id AS batch,
         500 * count(*) OVER w AS vectors_done,
         CAST(sum(CAST(floor(value * 10) AS BIGINT)) OVER w AS BIGINT) AS ms_done,
         500 * count(*) OVER (PARTITION BY event_type) AS total
  FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id))
SELECT run, batch, vectors_done, ms_done, 100 * vectors_done / total AS percent,
       CASE WHEN ms_done > 0 THEN 1000 * vectors_done / ms_done ELSE 0 END AS vectors_per_s,
       (total - vectors_done) * ms_done / (1000 * vectors_done) AS eta_s
FROM sums""",
}
