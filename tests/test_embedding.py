import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillvec.functions import vector as V
from quillvec.operators import embedding as E


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [(i, 0, f"text number {i}") for i in range(50)]
    return spark.createDataFrame(rows, "doc_id long, pos int, text string").repartition(3)


def test_embedder_sees_batches_and_rows_stay_together(chunks):
    def lengths(texts):
        assert len(texts) <= 7
        return np.array([[len(t), int(t.split()[-1])] for t in texts])

    rows = E.embed(chunks, lengths, dim=3, batch_size=7).collect()
    assert len(rows) == 50
    assert all(r.embedding == [len(f"text number {r.doc_id}"), r.doc_id, 0.0] for r in rows)


def test_vectors_are_cut_or_filled(chunks):
    ragged = lambda texts: [[1.0] * (1 + i % 4) for i, _ in enumerate(texts)]
    assert all(len(r.embedding) == 2 for r in E.embed(chunks, ragged, 2).collect())


def test_missing_vectors_are_an_error(chunks):
    with pytest.raises(Exception, match="vectors for"):
        E.embed(chunks, lambda texts: np.zeros((1, 2)), 2, batch_size=5).collect()


def test_retry_only_on_unavailable():
    calls = []

    def flaky(texts):
        calls.append(1)
        if len(calls) < 3:
            raise E.Unavailable
        return np.zeros((len(texts), 1))

    assert len(E.with_retry(flaky, first_wait=0)(["a"])) == 1 and len(calls) == 3

    def refusing(texts):
        calls.append(1)
        raise E.Unavailable

    calls.clear()
    with pytest.raises(E.Unavailable):
        E.with_retry(refusing, max_retries=3, first_wait=0)(["a"])
    assert len(calls) == 4

    def broken(texts):
        calls.append(1)
        raise RuntimeError

    calls.clear()
    with pytest.raises(RuntimeError):
        E.with_retry(broken, first_wait=0)(["a"])
    assert len(calls) == 1


def test_hashed_words():
    a, b, empty = E.hashed_words(32)(["The cat\nsat", "the  CAT sat", ""])
    assert np.array_equal(a, b) and np.isclose(np.linalg.norm(a), 1) and not empty.any()


def test_mean_pooling(spark):
    rows = [("a", [1.0, 2.0], 1), ("a", [3.0, 6.0], 1), ("a", [9.0, 9.0], 0), ("b", [5.0, 5.0], 0)]
    df = spark.createDataFrame(rows, "key string, embedding array<float>, mask int")
    masked = E.as_vectors(E.masked_mean_pool(df, "key"), "key")
    assert {r.key: r.embedding for r in masked.collect()} == {"a": [2.0, 4.0], "b": [0.0, 0.0]}
    plain = E.as_vectors(E.mean_pool(df.where("mask = 1"), "key"), "key")
    assert plain.first().embedding == [2.0, 4.0]


def test_vector_columns(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<float>, b array<float>")
    row = df.select(
        V.dot(F.col("a"), F.col("a")), V.cosine(F.col("a"), F.col("a")),
        V.cosine(F.col("a"), F.col("b")), V.normalize(F.col("a")), V.normalize(F.col("b")),
        V.fit_dim(F.col("a"), 1), V.fit_dim(F.col("a"), 3),
    ).first()
    assert row[0] == 25.0 and row[1] == 1.0 and row[2] is None
    assert np.allclose(row[3], [0.6, 0.8]) and row[4] == [0.0, 0.0]
    assert row[5] == [3.0] and row[6] == [3.0, 4.0, 0.0]


def test_parse_replies(spark):
    replies = ['{"embedding": [1, 2.5]}', "[3]", "nonsense", '{"other": 1}']
    df = spark.createDataFrame([(r,) for r in replies], "reply string")
    parsed = [r[0] for r in df.select(V.parse_embedding(F.col("reply"))).collect()]
    assert parsed == [[1.0, 2.5], [3.0], None, None]


def test_required_dimension(spark):
    df = spark.createDataFrame([([1.0],)], "v array<float>")
    assert df.select(V.require_dim(F.col("v"), 1)).first()[0] == [1.0]
    with pytest.raises(Exception, match="vector length"):
        df.select(V.require_dim(F.col("v"), 2)).collect()


def test_fingerprint_tells_signed_zero_apart(spark):
    df = spark.createDataFrame([([0.0, 1.0],), ([-0.0, 1.0],), ([0.0, 1.0],)], "v array<float>")
    a, b, c = (r[0] for r in df.select(V.fingerprint(F.col("v"))).collect())
    assert a == c != b
    assert bytes(a) == hashlib.md5(np.array([0.0, 1.0], "<f4").tobytes()).digest()


def test_batches_larger_than_those_of_arrow(spark):
    """The embedder's batch is filled from several Arrow batches."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8")
    try:
        texts = spark.range(100).coalesce(1).selectExpr("id", "cast(id as string) text")
        rows = E.embed(texts, lambda t: np.full((len(t), 1), len(t)), 1, batch_size=30).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert [r.embedding[0] for r in sorted(rows, key=lambda r: r.id)] == [30.0] * 90 + [10.0] * 10


def test_hashed_words_equal_a_plain_count():
    import hashlib

    texts = ["One two  two\nthree", "", " \n ", "ÄÖ ß two"]
    for text, found in zip(texts, E.hashed_words(16)(texts)):
        want = np.zeros(16)
        for word in text.lower().replace("\n", " ").split(" "):
            if word:
                want[int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % 16] += 1
        assert np.allclose(found, want / (np.linalg.norm(want) or 1))


def test_small_inputs_are_spread_and_large_ones_are_not(spark, monkeypatch):
    from quillvec.operators import chunking

    one = spark.range(10).withColumnRenamed("id", "doc_id").coalesce(1)
    cores = spark.sparkContext.defaultParallelism
    assert chunking.spread(one, "doc_id").rdd.getNumPartitions() == cores
    monkeypatch.setattr(chunking, "SPREAD_BYTES", 1)
    assert chunking.spread(one, "doc_id").rdd.getNumPartitions() == 1
