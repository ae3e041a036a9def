"""What a task holds at a time, and searches with guessed floors."""

import numpy as np
import pyarrow as pa
import pytest

from quillvec.operators import embedding, postings, search
from quillvec.operators.candidates import HyperplaneHash
from quillvec.operators.chunking import chunk
from quillvec.plans import corpus_queries

DIM = 8


def test_candidate_rows_are_scored_in_bounded_runs(monkeypatch):
    monkeypatch.setattr(postings, "PAIRS", 10)
    lists = [[1] * n for n in (4, 4, 4, 0, 25, 1, 10, 3)]
    batch = pa.record_batch({"id": pa.array(range(8)), "qids": pa.array(lists, pa.list_(pa.int64()))})
    runs = [part.column("qids").to_pylist() for part in postings._of_pairs(batch)]
    assert [row for run in runs for row in run] == lists
    assert all(sum(map(len, run)) <= 10 or len(run) == 1 for run in runs)


@pytest.mark.parametrize("rule", [None, HyperplaneHash(4, 2, DIM)])
def test_hits_held_by_a_task_are_cut_early(monkeypatch, rule):
    monkeypatch.setattr(search, "SETTLE_ROWS", 2000, raising=False)
    monkeypatch.setattr(search, "TILE_CELLS", 1000)
    rng = np.random.default_rng(3)
    vecs = rng.normal(size=(600, DIM)).astype(np.float32)
    table = pa.table({"qid": pa.array(range(50)), "embedding": pa.array(list(map(list, vecs[:50])), pa.list_(pa.float32()))})
    block = search.QueryBlock(table, DIM).of(search.Arm(rule))
    held, plain = [0], search._Best.offer_pairs

    def offer(self, *args):
        plain(self, *args)
        held.append(self.rows)

    monkeypatch.setattr(search._Best, "offer_pairs", offer)
    one = search._Search(block, 10)
    one.take(0, search.DocumentBlock(np.arange(600), vecs, False), None)
    assert max(held) <= 2000 + 50 * 600 // 4
    assert max(held) < sum(one.scored[0]) or rule is None


def test_guessed_floors_give_the_exact_search(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=DIM).astype(float).tolist()) for i in range(800)]
    docs = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(5).cache()
    asked = search.query_set(docs, 20)
    want = sorted(search.top_k(docs, asked, 100, DIM).select("qid", "rank", "id").collect())
    assert len(want) == 2000
    for sigmas in (4.0, 0.0, -2.0):  # the last ones guess too high
        monkeypatch.setattr(search, "GUESS_SIGMAS", sigmas)
        found = search.guessed_floor_top_k(docs, asked, 100, DIM)
        assert sorted(found.select("qid", "rank", "id").collect()) == want


def test_words_are_cut_in_bounded_runs(monkeypatch):
    texts = ["a b c", "", "long " * 50, "x", "b a c"]
    want = embedding.hashed_words(16)(texts)
    sizes, plain = [], np.repeat
    monkeypatch.setattr(embedding, "CHARACTERS", 10)
    monkeypatch.setattr(embedding.np, "repeat", lambda a, n: sizes.append(len(a)) or plain(a, n))
    assert (embedding.hashed_words(16)(texts) == want).all()
    assert sizes == [2, 1, 2]


def test_profile_without_moving_vectors(spark, sf_dir):
    docs = corpus_queries.documents(spark, sf_dir).where("doc_id < 20")
    vecs = embedding.embed(chunk(docs, "sentence"), embedding.hashed_words(8), 8)
    numbered = corpus_queries._numbered(spark, vecs, "id", "set")
    narrow = numbered.select("id", embedding.filled_values("embedding").alias("filled"))
    a, b = (embedding.profile_set(v, "n", "sentence", 8, 4, 10).collect() for v in (numbered, narrow))
    assert a == b and a[0].filled > 0
