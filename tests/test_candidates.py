"""Posting lists, learned cells and zones against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillvec.operators import candidates, search
from quillvec.operators.candidates import HyperplaneHash, NearestCells
from quillvec.operators.clustering import cell_sums, learn_cells, nearest, seed_cells
from quillvec.operators.evaluation import compare_probes, compare_pruned, evaluate
from quillvec.operators.postings import listed_candidates, postings_top_k, write_postings
from quillvec.operators.sharding import assign_even, assign_refined, even_starts
from quillvec.plans import search_queries

DIM, N, ASKED, K = 12, 500, 70, 7


@pytest.fixture(scope="module")
def matrix():
    """Vectors round eight centres with lengths from 0.1 to 30; every fifth is a copy of one."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, DIM))
    m = centres[rng.integers(8, size=N)] + 0.4 * rng.normal(size=(N, DIM))
    m *= (rng.uniform(0.1, 30, size=N) / np.linalg.norm(m, axis=1))[:, None]
    m[::5] = m[2]
    return m.astype("float32")


@pytest.fixture(scope="module")
def docs(spark, matrix):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(matrix)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(6)
    return assign_even(df, 4)


@pytest.fixture(scope="module")
def asked(docs):
    return search.load_queries(search.query_set(docs, ASKED), DIM)


def best(matrix, allowed=None):
    wide = matrix.astype("float64")
    scores = wide[:ASKED] @ wide.T
    out = {}
    for q in range(ASKED):
        rows = [d for d in range(N) if allowed is None or allowed[q, d]]
        out[q] = sorted(rows, key=lambda d: (-round(scores[q, d], 6), d))[:K]
    return {q: rows for q, rows in out.items() if rows}


def ids(hits):
    out = {}
    for r in hits.orderBy("qid", "rank").collect():
        out.setdefault(r.qid, []).append(r.id)
    return out


def shares_code(matrix, rule):
    codes = rule.codes(matrix.astype("float64"))
    return (codes[:, :ASKED, None] == codes[:, None, :]).any(axis=0)


@pytest.mark.parametrize(("bits", "small"), [(3, 0), (3, 1 << 60), (9, 2048), (12, 0)])
def test_listed_pairs(matrix, docs, asked, bits, small, monkeypatch):
    """Groups and single pairs give the pairs of the full comparison, each once."""
    monkeypatch.setattr(candidates, "SMALL_GROUP", small)
    rule = HyperplaneHash(4, bits, DIM)
    allowed = shares_code(matrix, rule)
    keys = rule.codes(matrix.astype("float64"))
    lists = rule.query_lists(keys[:, :ASKED])
    met = np.zeros_like(allowed, dtype=int)
    for q, d, new in rule.meetings(keys[:, :ASKED], lists, keys):
        met[np.ix_(q, d)] += 1 if new is None else new
    assert np.array_equal(met, allowed.astype(int))
    single = np.zeros_like(met)
    for q, d in rule.pairs(keys[:, :ASKED], lists, keys):
        np.add.at(single, (q, d), 1)
    assert np.array_equal(single, met)
    assert ids(search.top_k(docs, asked, K, DIM, rule)) == best(matrix, allowed)
    counts = search.scored_counts(docs, asked, DIM, rule).groupBy("qid").agg(F.sum("scored"))
    assert {q: n for q, n in counts.collect()} == dict(enumerate(allowed.sum(axis=1)))


def test_stored_postings(spark, matrix, docs, asked, tmp_path):
    rule, path = HyperplaneHash(4, 8, DIM), str(tmp_path / "lists")
    write_postings(docs, rule, path, files_per_part=2)
    allowed = shares_code(matrix, rule)
    found = listed_candidates(spark, path, asked.frame, rule)
    pairs = {(r.id, q) for r in found.collect() for q in r.qids}
    assert pairs == {(d, q) for q, d in zip(*np.nonzero(allowed))}
    assert ids(postings_top_k(docs, asked, K, rule, path)) == best(matrix, allowed)
    one = search.load_queries(search.query_set(docs, 1), DIM)
    plan = listed_candidates(spark, path, one.frame, rule)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "part" in plan.split("PartitionFilters: [")[1].split("]")[0]
    large = search.load_queries(search.query_set(docs, ASKED), DIM, max_broadcast_bytes=DIM * 8 * 5)
    assert large.shared is None
    assert ids(postings_top_k(docs, large, K, rule, path)) == best(matrix, allowed)


def test_cells_equal_plain_rounds(docs, matrix):
    """Lloyd's rounds over all rows, from the same seeds."""
    unit = matrix / np.linalg.norm(matrix.astype("float64"), axis=1)[:, None]
    cells = seed_cells(matrix, 8, 7)
    found = learn_cells(docs, DIM, 8, rounds=0, seed=7)
    assert found.shape == (8, DIM) and np.allclose(np.linalg.norm(found, axis=1), 1)
    sums = {r["cell"]: r for r in cell_sums(docs, cells).collect()}
    own = nearest(unit.astype("float64"), cells)
    for c in range(8):
        if (own == c).any():
            assert sums[c]["n"] == (own == c).sum()
            got = np.frombuffer(sums[c]["sums"], np.int64) / (1 << 24)
            assert np.allclose(got, unit[own == c].sum(axis=0), atol=1e-4)
        else:
            assert c not in sums
    learned = learn_cells(docs, DIM, 8, rounds=10)
    again = learn_cells(docs.repartition(3), DIM, 8, rounds=10)
    assert np.array_equal(learned, again)
    # A round from the learned centroids improves nothing any more.
    own = nearest(unit.astype("float64"), learned)
    tight = (unit * learned[own]).sum()
    assert tight >= (unit * cells[nearest(unit.astype("float64"), cells)]).sum()


def test_cells_of_few_vectors(spark):
    rows = [(i, [1.0, 0.0]) for i in range(5)] + [(9, [0.0, 0.0])]
    docs = spark.createDataFrame(rows, "id long, embedding array<float>")
    assert learn_cells(docs, 2, 4).shape == (4, 2)
    with pytest.raises(ValueError, match="no vectors"):
        learn_cells(docs.limit(0), 2, 4)
    with pytest.raises(ValueError, match="fewer"):
        learn_cells(docs, 2, 1 << 40)


def test_probes_trade_work_for_recall(docs, asked, matrix):
    centroids = learn_cells(docs, DIM, 8)
    rows = compare_probes(docs, asked, K, centroids, (1, 3, 8)).orderBy("probes").collect()
    allowed = [
        np.array([np.isin(NearestCells(centroids, p).document_keys(matrix.astype("float64"))[0],
                          np.flatnonzero(v)) for v in
                  NearestCells(centroids, p).query_keys(matrix[:ASKED].astype("float64")).T])
        for p in (1, 3, 8)
    ]
    truth = best(matrix)
    for row, mask in zip(rows, allowed):
        found = best(matrix, mask)
        recall = np.mean([len(set(found[q]) & set(truth[q])) / K for q in truth])
        assert row.merged_recall == pytest.approx(recall, abs=1e-4)
        assert row.scored_share == pytest.approx(mask.mean(), abs=1e-4)
    assert rows[-1].merged_recall == 1.0 and rows[-1].scored_share == 1.0
    assert rows[0].scored_share < 0.5


def test_learned_cells_query(spark, sf_dir):
    rows = search_queries.knn_ivf_learned(spark, sf_dir).orderBy("probes").collect()
    recalls, shares = [r.merged_recall for r in rows], [r.scored_share for r in rows]
    assert recalls == sorted(recalls) and shares == sorted(shares)
    assert all(r > s for r, s in zip(recalls, shares))


@pytest.mark.parametrize("stored", [False, True])
@pytest.mark.parametrize("metric", ["dot", "cosine"])
def test_zones_skip_work_and_change_nothing(matrix, docs, asked, stored, metric, monkeypatch):
    monkeypatch.setattr(search, "ZONE_ROWS", 20)
    blocked = search.by_length(docs, 20) if stored else docs
    exact = search.top_k(docs, asked, K, DIM, metric=metric)
    floored = asked.frame.join(search.kth_scores(exact, K), "qid", "left")
    arms = (search.Arm(floor="none", zones=False), search.Arm(), search.Arm(fixed=True))
    scanned = search.scan_arms(blocked, floored, K, DIM, arms, counts=True, metric=metric).cache()
    work = [search.arm_counts(scanned, n).agg(F.sum("scored")).first()[0] for n in range(3)]
    for n in range(3):
        assert ids(search.merge_top_k(search.arm_hits(scanned, n), K)) == ids(exact)
    assert work[0] == ASKED * N and work[1] <= work[2]
    if metric == "dot":
        assert work[2] < work[0]
    sizes = {r.shard: r["size"] for r in search.scanned_sizes(scanned).collect()}
    assert sizes == {s: N // 4 for s in range(4)}


def test_blocks_by_length(docs, matrix):
    rows = search.by_length(docs, 30).select("id", "block", "reach").collect()
    lengths = np.sqrt((matrix.astype("float64") ** 2).sum(axis=1))
    order = sorted(range(N), key=lambda i: (-lengths[i], i))
    place = {i: p // 30 for p, i in enumerate(order)}
    assert {r.id: r.block for r in rows} == place
    assert all(r.reach >= lengths[r.id] - 1e-9 for r in rows)


def test_pruned_against_full(docs, asked):
    row = compare_pruned(search.by_length(docs, 16), asked, K).first()
    assert row.merged_recall_a == row.merged_recall_b == 1.0
    assert row.scored_a == ASKED * N and row.scored_b < row.scored_a
    assert row.handed_a == ASKED * 4 * K and ASKED * K <= row.handed_b < row.handed_a


def test_evaluation_is_one_scan(spark, docs, asked, tmp_path):
    docs.write.parquet(str(tmp_path / "docs"))
    stored = spark.read.parquet(str(tmp_path / "docs"))
    run = evaluate(stored, asked, (3, K), 4, HyperplaneHash(2, 3, DIM), total=N)
    plans = [f._jdf.queryExecution().optimizedPlan().toString() for f in (run.hits, run.report, run.saved)]
    assert not any("Relation" in p and "embedding" in p for p in plans)


@pytest.mark.parametrize("total", [0, 1, 5, 8, 100, 103])
def test_refined_cut(spark, total):
    counts = (1, 2, 3, 8)
    df = spark.range(total)
    cut, owner = assign_refined(df, counts, total)
    pieces = {r.id: r.shard for r in cut.collect()}
    for n in counts:
        even = {r.id: r.shard for r in assign_even(df, n, total=total).collect()}
        assert {i: owner[n][p] for i, p in pieces.items()} == even
        assert all(even[s] == i for i, s in enumerate(even_starts(total, n)) if s < total and i in even.values())


def test_values_beyond_single_precision_fail(spark):
    docs = spark.createDataFrame([(0, [1e39, 1.0])], "id long, embedding array<double>")
    with pytest.raises(Exception, match="finite"):
        search.top_k(docs, search.query_set(docs), 1, 2).collect()
