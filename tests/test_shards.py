import numpy as np
import pytest
from pyspark.sql import functions as F

from quillvec.operators.dedup import dedup_vectors, duplicate_counts, first_copies
from quillvec.operators.ids import dense_chunk_ids, dense_ids, running_offsets
from quillvec.operators.sharding import assign_ceil, assign_even, regroup, regroup_ladder, shard_sizes


def split_sizes(spark, n, shards):
    return [(r.size, r.first_id) for r in
            shard_sizes(assign_even(spark.range(n), shards), shards).orderBy("shard").collect()]


@pytest.mark.parametrize(("n", "shards"), [(10, 16), (7, 3), (500, 16), (16, 16), (0, 4), (1, 1)])
def test_even_split(spark, n, shards):
    wanted = [len(a) for a in np.array_split(np.arange(n), shards)]
    starts = [0, *np.cumsum(wanted)[:-1]]
    assert split_sizes(spark, n, shards) == list(zip(wanted, starts))


@pytest.mark.parametrize(("n", "shards"), [(10, 4), (5, 4), (16, 4)])
def test_ceil_split(spark, n, shards):
    per = -(-n // shards)
    rows = assign_ceil(spark.range(n), shards).collect()
    assert all(r.shard == r.id // per for r in rows)


def test_regroup_keeps_order(spark):
    fine = assign_even(spark.range(103), 16)
    rows = regroup(fine, 16, 4).orderBy("id").collect()
    assert [r.shard for r in rows] == sorted(r.shard for r in rows)
    for bad in (5, 32, 0):
        with pytest.raises(ValueError):
            regroup(fine, 16, bad)


def test_ladder_adds_up(spark):
    rungs = regroup_ladder(assign_even(spark.range(103), 16), 16, [8, 4, 1]).collect()
    for target in (8, 4, 1):
        sizes = [r["size"] for r in sorted(rungs, key=lambda r: r.shard) if r.target == target]
        assert len(sizes) == target and sum(sizes) == 103


def test_dense_ids_have_no_gaps(spark):
    keys = spark.range(0, 5000, 7).select((F.col("id") * 31 % 5003).alias("k")).repartition(6)
    rows = dense_ids(keys, ["k"]).orderBy("k").collect()
    assert [r.id for r in rows] == list(range(len(rows)))


def test_running_offsets(spark):
    df = spark.range(200).select("id", (F.col("id") % 5).alias("n")).repartition(7)
    rows = running_offsets(df, ["id"], F.col("n"), "at").orderBy("id").collect()
    assert [r["at"] for r in rows] == [0, *np.cumsum([r.n for r in rows])[:-1]]


def test_chunk_ids_follow_documents(spark):
    chunks = spark.createDataFrame([(d, p) for d in (4, 9, 2) for p in range(d)], "doc_id long, pos int")
    rows = dense_chunk_ids(chunks).orderBy("doc_id", "pos").collect()
    assert [r.chunk_id for r in rows] == list(range(15))


@pytest.fixture(scope="module")
def copies(spark):
    """Third of all rows share one vector; 0.0 and -0.0 are different content."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(0, 3, 3)]) for i in range(40)]
    rows += [(40 + i, [1.0, 1.0, 1.0]) for i in range(30)]
    rows += [(70, [0.0, 9.0, 9.0]), (71, [-0.0, 9.0, 9.0]), (72, [0.0, 9.0, 9.0])]
    return rows, spark.createDataFrame(rows, "id long, embedding array<float>").repartition(4)


def test_dedup_keeps_first(copies):
    rows, df = copies
    first = {}
    for i, v in rows:
        first.setdefault(np.array(v, "<f4").tobytes(), i)
    kept = sorted(first.values())
    assert sorted(r.id for r in first_copies(df).collect()) == kept
    assert 71 in kept and 72 not in kept

    out = dedup_vectors(df, 4).orderBy("new_id").collect()
    assert [(r.new_id, r.id) for r in out] == list(enumerate(kept))
    counted = duplicate_counts(df).first()
    assert (counted.total, counted.unique_vectors) == (73, len(kept))
    assert counted.duplicates == 73 - len(kept)


def test_dedup_again_changes_nothing(copies):
    _, df = copies
    once = dedup_vectors(df, 4).select(F.col("new_id").alias("id"), "embedding")
    twice = dedup_vectors(once, 4)
    assert twice.where("id <> new_id").count() == 0 and twice.count() == once.count()


def test_counts_of_nothing(spark):
    empty = spark.createDataFrame([], "id long, embedding array<float>")
    assert tuple(duplicate_counts(empty).first()) == (0, 0, 0)
