import json
import os

import numpy as np
import pytest

from quillvec.operators.sharding import assign_even
from quillvec.sources.dataset import (
    build_shards,
    dedup_dataset,
    evaluate_dataset,
    fitting_shards,
    write_dataset,
)
from quillvec.sources.manifest import (
    is_complete,
    read_manifest,
    resolve_dataset,
    validate_dataset,
)
from quillvec.sources.vecfile import dataset_files, read_vec, write_vec

DIM = 16


@pytest.fixture(scope="module")
def mock(spark):
    """Row i repeats (i mod 10000) / 10000."""
    rows = [(i, [(i % 10000) * 0.0001] * DIM) for i in range(1003)]
    return spark.createDataFrame(rows, "id long, embedding array<float>").repartition(5)


def on_disk(path):
    return np.fromfile(path, "<f4").reshape(-1, DIM)


def expected(n):
    return np.repeat(((np.arange(n) % 10000) * 0.0001).astype("<f4"), DIM).reshape(-1, DIM)


@pytest.mark.parametrize("shards", [1, 7])
def test_bytes_written(spark, mock, tmp_path, shards):
    write_vec(assign_even(mock, shards), str(tmp_path), DIM, shards)
    names = ["docs.vec"] if shards == 1 else [f"docs-shard-{i}.vec" for i in range(shards)]
    assert sorted(os.listdir(tmp_path)) == sorted(names)
    parts = [on_disk(tmp_path / n) for n in names]
    assert np.array_equal(np.concatenate(parts), expected(1003))
    assert max(map(len, parts)) - min(map(len, parts)) <= 1


def test_read_back_in_ranges_and_numeric_order(spark, mock, tmp_path):
    write_vec(assign_even(mock, 12), str(tmp_path), DIM, 12)
    scan = read_vec(spark, str(tmp_path), DIM, rangeBytes=DIM * 4 * 20)
    assert scan.rdd.getNumPartitions() > 12
    rows = scan.orderBy("id").collect()
    assert [r.id for r in rows] == list(range(1003))
    assert [r.shard for r in rows] == sorted(r.shard for r in rows)
    assert np.array_equal(np.array([r.embedding for r in rows], "<f4"), expected(1003))


def test_ragged_file(spark, tmp_path):
    (tmp_path / "docs.vec").write_bytes(b"\0" * (DIM * 4 * 3 + 5))
    with pytest.raises(Exception, match="multiple"):
        read_vec(spark, str(tmp_path), DIM).collect()
    assert read_vec(spark, str(tmp_path), DIM, on_partial="ignore").count() == 3


def test_nothing_to_read(tmp_path):
    with pytest.raises(FileNotFoundError):
        dataset_files(str(tmp_path))
    with pytest.raises(FileNotFoundError):
        dataset_files(str(tmp_path / "missing"))


def test_wrong_dimension_fails_and_leaves_no_files(spark, tmp_path):
    df = spark.createDataFrame([(0, 0, [1.0] * DIM), (1, 0, [1.0])], "id long, shard int, embedding array<float>")
    with pytest.raises(Exception, match="values"):
        write_vec(df, str(tmp_path / "out"), DIM, 1)
    assert os.listdir(tmp_path / "out") == []


def test_failed_rewrite_is_not_complete(spark, mock, tmp_path):
    path = str(tmp_path / "set")
    write_dataset(mock, path, DIM, shards=2, num_queries=10, **FIELDS)
    assert is_complete(path)
    short = mock.selectExpr("id", "slice(embedding, 1, 3) AS embedding")
    with pytest.raises(Exception, match="values"):
        write_dataset(short, path, DIM, shards=2, num_queries=10, skip_complete=False, **FIELDS)
    assert not is_complete(path)
    write_dataset(mock, path, DIM, shards=2, num_queries=10, **FIELDS)
    validate_dataset(spark, path)


def test_overwrite_removes_old_shards(spark, mock, tmp_path):
    write_vec(assign_even(mock, 4), str(tmp_path), DIM, 4)
    write_vec(assign_even(mock, 2), str(tmp_path), DIM, 2)
    assert sorted(os.listdir(tmp_path)) == ["docs-shard-0.vec", "docs-shard-1.vec"]


FIELDS = dict(
    source="messages", source_path="in/chat log.txt", granularity="sentence", model_name="m x",
    created_at="2026-01-01T00:00:00Z",
)


def test_dataset_with_manifest(spark, mock, tmp_path):
    path = str(tmp_path / "embeddings" / "set")
    write_dataset(mock, path, DIM, shards=4, num_queries=10, **FIELDS)
    assert is_complete(path)
    validate_dataset(spark, path)
    found, manifest = resolve_dataset(spark, "set", str(tmp_path))
    row = manifest.first()
    assert found == path and resolve_dataset(spark, path)[1].first() == row
    assert (row.num_docs, row.num_query_vectors, row.dim) == (1003, 10, DIM)
    assert row.shard_sizes == [251, 251, 251, 250]
    assert row.shard_doc_offsets == [0, 251, 502, 753]
    assert row.granularity == "message" and row.dataset_name is None
    assert row.output_queries_vec == f"{path}/queries.vec"
    assert "dataset_name" not in json.load(open(f"{path}/meta.json"))
    assert np.array_equal(on_disk(f"{path}/queries.vec"), expected(10))

    stamp = os.path.getmtime(f"{path}/meta.json")
    write_dataset(mock.limit(5), path, DIM, shards=4, **FIELDS)  # complete, so left alone
    assert os.path.getmtime(f"{path}/meta.json") == stamp

    os.truncate(f"{path}/docs-shard-3.vec", DIM * 4)
    with pytest.raises(ValueError, match="manifest says"):
        validate_dataset(spark, path)


def test_single_file_dataset(spark, mock, tmp_path):
    path = str(tmp_path / "one")
    write_dataset(mock, path, DIM, shards=1, dataset_name=" one ", **FIELDS)
    row = resolve_dataset(spark, "one", str(tmp_path))[1].first()
    assert row.num_shards is None and row.shard_sizes is None and row.dataset_name == "one"
    assert row.output_docs_vec == f"{path}/docs.vec"
    with pytest.raises(ValueError, match="not found"):
        resolve_dataset(spark, "two", str(tmp_path))


def test_shards_for_searching(spark, mock, tmp_path):
    many, one = str(tmp_path / "many"), str(tmp_path / "one")
    write_dataset(mock, many, DIM, shards=4, **FIELDS)
    write_dataset(mock, one, DIM, shards=1, **FIELDS)
    for path, sizes in ((many, [502, 501]), (one, [502, 501])):
        docs = build_shards(spark, path, 2)
        counts = {r.shard: (r["count"], r.first) for r in
                  docs.groupBy("shard").agg({"*": "count", "id": "min"})
                  .toDF("shard", "count", "first").collect()}
        assert counts == {0: (sizes[0], 0), 1: (sizes[1], sizes[0])}
    with pytest.raises(ValueError):
        build_shards(spark, many, 3)


def test_dataset_without_duplicates(spark, mock, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    doubled = mock.union(mock.selectExpr("id + 1003 AS id", "embedding"))
    write_dataset(doubled, path, DIM, shards=3, num_queries=1500, **FIELDS)
    dedup_dataset(spark, path, out)
    row = read_manifest(spark, out).first()
    assert row.num_docs == 1003 and row.shard_sizes == [335, 334, 334]
    assert row.num_query_vectors == 1003
    parts = [on_disk(f"{out}/docs-shard-{i}.vec") for i in range(3)]
    assert np.array_equal(np.concatenate(parts), expected(1003))
    assert read_manifest(spark, path).first().num_docs == 2006


def test_shards_grow_with_the_data():
    assert fitting_shards(1000, 1024) == 16
    assert fitting_shards(25_000_000_000, 1024) % 16 == 0
    assert fitting_shards(25_000_000_000, 1024) >= 25_000_000_000 * 4096 / 2**30


@pytest.mark.parametrize("rows", [0, 3])
def test_empty_shards_are_files(spark, mock, tmp_path, rows):
    path = str(tmp_path / "few")
    write_dataset(mock.where(f"id < {rows}"), path, DIM, shards=8, **FIELDS)
    assert sum(n.startswith("docs-shard-") for n in os.listdir(path)) == 8
    assert is_complete(path)
    assert read_vec(spark, path, DIM).count() == rows


def test_documents_rewritten_alone_are_not_complete(spark, mock, tmp_path):
    path = str(tmp_path / "set")
    write_dataset(mock, path, DIM, shards=2, num_queries=10, **FIELDS)
    write_vec(assign_even(mock.limit(60), 2), path, DIM, 2)
    assert not is_complete(path)


def test_relative_paths(spark, mock, tmp_path):
    path = os.path.relpath(tmp_path / "set")
    write_dataset(mock, path, DIM, shards=2, num_queries=10, **FIELDS)
    assert is_complete(path) and os.path.exists(tmp_path / "set" / "meta.json")
    assert read_vec(spark, path, DIM).count() == 1003


def test_stored_dataset_in_one_call(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(200, DIM)).astype("float32"))]
    path = str(tmp_path / "set")
    vectors = spark.createDataFrame(rows, "id long, embedding array<float>")
    write_dataset(vectors, path, DIM, shards=4, num_queries=20, **FIELDS)
    report = evaluate_dataset(spark, path, 2, (1, 10)).report.collect()
    assert {(r.k, r.merged_recall, r.num_queries, r.num_docs) for r in report} == {
        (1, 1.0, 20, 200), (10, 1.0, 20, 200)
    }
