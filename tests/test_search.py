import numpy as np
import pytest
from pyspark.sql import functions as F

from quillvec.operators import search
from quillvec.operators.candidates import HyperplaneHash, NearestCells
from quillvec.operators.sharding import assign_even

DIM, N = 8, 300


@pytest.fixture(scope="module")
def matrix():
    """Unit vectors; a third of them are copies of one, so ties are everywhere."""
    rng = np.random.default_rng(11)
    m = rng.normal(size=(N, DIM))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    m[::3] = m[0]
    return m.astype("float32").astype("float64")


@pytest.fixture(scope="module")
def docs(spark, matrix):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(matrix)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(5)
    return assign_even(df, 4)


@pytest.fixture(scope="module")
def asked(docs):
    return search.query_set(docs, 60)


def brute(matrix, k, queries=60, allowed=None):
    out = {}
    for q in range(queries):
        scored = sorted(
            (-round(float(matrix[q] @ matrix[d]), 9), d)
            for d in range(len(matrix))
            if allowed is None or allowed[q, d]
        )
        out[q] = [d for _, d in scored[:k]]
    return out


def ids(hits):
    out = {}
    for r in hits.orderBy("qid", "rank").collect():
        out.setdefault(r.qid, []).append(r.id)
    return out


@pytest.mark.parametrize("k", [1, 10, 150, 1000])
def test_exact(matrix, docs, asked, k):
    assert ids(search.top_k(docs, asked, k, DIM)) == brute(matrix, k)


def test_query_blocks_beyond_the_broadcast_bound(matrix, docs, asked):
    small = DIM * 8 * 7  # seven queries may be broadcast, sixty are asked
    hits = search.top_k(docs, asked, 10, DIM, max_broadcast_bytes=small)
    assert ids(hits) == brute(matrix, 10)
    hashed = HyperplaneHash(3, 3, DIM)
    assert ids(search.top_k(docs, asked, 10, DIM, hashed, max_broadcast_bytes=small)) == ids(
        search.top_k(docs, asked, 10, DIM, hashed)
    )
    counts = search.scored_counts(docs, asked, DIM, max_broadcast_bytes=small)
    assert counts.agg(F.sum("scored")).first()[0] == 60 * N


def test_small_tiles_and_early_hand_over(spark, matrix, docs, asked, monkeypatch):
    monkeypatch.setattr(search, "TILE_CELLS", 64)
    monkeypatch.setattr(search, "HELD_ROWS", 100)
    assert ids(search.top_k(docs, asked, 10, DIM)) == brute(matrix, 10)


def test_queries_scanned_in_groups(matrix, docs, asked, monkeypatch):
    monkeypatch.setattr(search, "HELD_ROWS", 500)  # 25 queries at K = 10
    hits = search.shard_hits(docs, asked, 10, DIM)
    assert hits._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 3
    assert ids(search.best_k(hits, 10)) == brute(matrix, 10)


def test_merge_of_full_shard_results_is_exact(matrix, docs, asked):
    per_shard = search.per_shard_top_k(docs, asked, 10, DIM)
    assert per_shard.groupBy("qid", "shard").count().where("count <> 10").count() == 0
    assert ids(search.merge_top_k(per_shard, 10)) == brute(matrix, 10)


def test_salted_merge(spark, matrix, docs, asked):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "100")
    try:
        hits = search.top_k(docs, asked, 10, DIM)
        assert "_salt" in hits._jdf.queryExecution().optimizedPlan().toString()
        assert ids(hits) == brute(matrix, 10)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_floor_pruning_changes_nothing_but_the_rows_shuffled(matrix, docs, asked):
    assert ids(search.floor_pruned_top_k(docs, asked, 10, DIM)) == brute(matrix, 10)
    hashed = HyperplaneHash(4, 5, DIM)
    assert ids(search.floor_pruned_top_k(docs, asked, 10, DIM, hashed)) == ids(
        search.top_k(docs, asked, 10, DIM, hashed)
    )
    # A floor shard with fewer than K rows gives no floor.
    assert ids(search.floor_pruned_top_k(docs, asked, 90, DIM)) == brute(matrix, 90)
    floors = search.kth_scores(search.top_k(docs.where("shard = 0"), asked, 10, DIM), 10)
    with_floor = asked.join(floors, "qid")
    assert (
        search.shard_hits(docs, with_floor, 10, DIM).count()
        < search.shard_hits(docs, asked, 10, DIM).count()
    )


def test_each_k_from_one_ranking(matrix, docs, asked):
    swept = search.at_each_k(search.top_k(docs, asked, 50, DIM), (10, 50))
    assert ids(swept.where("k = 10")) == brute(matrix, 10)
    assert ids(swept.where("k = 50")) == brute(matrix, 50)


def test_hash_candidates(matrix, docs, asked):
    rule = HyperplaneHash(4, 5, DIM)
    codes = rule.codes(matrix)
    allowed = (codes[:, :, None] == codes[:, None, :]).any(axis=0)
    assert ids(search.top_k(docs, asked, 10, DIM, rule)) == brute(matrix, 10, allowed=allowed)
    saved = search.lookups_saved(docs, asked, DIM, 4, rule).collect()
    assert len(saved) == 60 * 4
    for r in saved:
        block = allowed[r.qid, r.shard * 75 : (r.shard + 1) * 75]
        assert (r.scored, r.saved) == (block.sum(), 75 - block.sum())


def test_cell_candidates(matrix, docs, asked):
    centroids = matrix[[1, 50, 100, 200]]
    nearest = np.argsort(-np.round(matrix @ centroids.T, 9), axis=1, kind="stable")
    for probes in (1, 2, 4):
        allowed = np.array([[nearest[d, 0] in nearest[q, :probes] for d in range(N)] for q in range(N)])
        rule = NearestCells(centroids, probes)
        assert ids(search.top_k(docs, asked, 10, DIM, rule)) == brute(matrix, 10, allowed=allowed)
    assert ids(search.top_k(docs, asked, 10, DIM, NearestCells(centroids, 4))) == brute(matrix, 10)


def test_stored_cells_are_read_only_where_visited(spark, matrix, docs, tmp_path):
    rule = NearestCells(matrix[[1, 50, 100, 200]], 1)
    path = str(tmp_path / "cells")
    search.write_cells(docs, rule, path, files_per_cell=3)
    stored = spark.read.parquet(path)
    few = search.load_queries(search.query_set(docs, 2), DIM)
    part = search.visited_cells(stored, few, rule)
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell#" in plan.replace("isnotnull(", "")
    assert part.count() < N
    hits = search.top_k(part, few, 10, DIM, rule)
    assert ids(hits) == ids(search.top_k(docs, few, 10, DIM, rule))


def test_full_cells_are_several_files(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(search, "ROWS_PER_TASK", 20)
    rule, path = NearestCells(np.eye(DIM)[:3], 1), str(tmp_path / "cells")
    # Small tasks would be joined again here.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        search.write_cells(docs, rule, path)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    stored = spark.read.parquet(path)
    sizes = stored.groupBy("cell").count().collect()
    assert stored.count() == N and max(r["count"] for r in sizes) > 100
    files = stored.groupBy("cell", F.input_file_name()).count()
    assert files.groupBy("cell").count().agg(F.max("count")).first()[0] > 1


def test_wrong_dimension_fails(docs, asked):
    with pytest.raises(Exception, match="values"):
        search.top_k(docs, asked, 3, DIM + 1).collect()


def test_documents_are_not_shuffled(spark, sf_dir):
    stored = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumnRenamed("vec_id", "id")
    hits = search.top_k(stored, search.query_set(stored), 10, 64)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[plan.index("MapInArrow"):]
    assert plan.count("Exchange") == 1 and plan.count("WindowGroupLimit") == 2
    assert "label" not in plan


def test_snapshot_floor(spark):
    schema = "qid long, shard int, seq int, hits array<struct<id: bigint, score: double>>"
    snapshots = spark.createDataFrame(
        [
            (0, 0, 0, [(1, 0.9), (2, 0.8)]),
            (0, 0, 1, [(3, 0.5)]),  # replaces the earlier push
            (0, 1, 0, [(4, 0.7), (5, 0.6)]),
            (1, 0, 0, [(9, 0.1)]),  # fewer than K
            (2, 0, 0, []),
        ],
        schema,
    )
    floors = {r.qid: (r.merged, r.floor) for r in search.snapshot_floor(snapshots, 2).collect()}
    assert floors == {0: (2, 0.6), 1: (1, 0.1), 2: (0, float("-inf"))}


@pytest.mark.parametrize("factor", [1e-30, 1e-5, 1e4, 1e25])
@pytest.mark.parametrize("k", [10, 150])
def test_lengths_do_not_change_the_neighbours(spark, factor, k):
    rng = np.random.default_rng(5)
    m = (rng.normal(size=(N, DIM)) * factor).astype("float32")
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)]
    docs = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(5)
    wide = m.astype("float64")
    scores = wide[:60] @ wide.T
    want = {q: np.argsort(-scores[q], kind="stable")[:k].tolist() for q in range(60)}
    assert ids(search.top_k(docs, search.query_set(docs, 60), k, DIM)) == want


def test_cosine(spark):
    rng = np.random.default_rng(6)
    m = (rng.normal(size=(N, DIM)) * 10.0 ** rng.integers(-12, 12, size=(N, 1))).astype("float32")
    m[7] = 0
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)]
    docs = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(5)
    unit = m.astype("float64")
    unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-300)
    scores = unit[:60] @ unit.T
    want = {q: np.argsort(-scores[q], kind="stable")[:10].tolist() for q in range(60)}
    found = search.top_k(docs, search.query_set(docs, 60), 10, DIM, metric="cosine")
    assert ids(found) == want  # the vector of zeros included: cosine 0 with all, so by id
    with pytest.raises(ValueError, match="metric"):
        search.top_k(docs, search.query_set(docs, 60), 10, DIM, metric="euclid")


def test_documents_are_not_shuffled_for_stored_queries(docs, asked):
    hits = search.shard_hits(docs, asked, 10, DIM, by_shard=False, max_broadcast_bytes=DIM * 8 * 7)
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 18 and "CoGroup" not in plan


def test_floor_where_it_saves_enough():
    assert not search.floor_repays(100_000, 10)
    assert search.floor_repays(10_000_000, 10) and search.floor_repays(2_144_577, 10_000)
