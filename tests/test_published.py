"""Published lists, pushed conditions, appended streams, and reading the first documents only."""

import json
import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, LessThanOrEqual

from quillvec.operators.embedding import masked_mean_pool, mean_vectors
from quillvec.operators.sharding import assign_even
from quillvec.sources.corpus import read_jsonl, read_messages
from quillvec.sources.dataset import build_shards, write_dataset
from quillvec.sources.listing import listed, publish, remove_unlisted
from quillvec.sources.manifest import is_complete, resolve_dataset, validate_dataset
from quillvec.sources.paths import filesystem
from quillvec.sources.vecfile import VecReader, dataset_files, read_vec, write_vec
from quillvec.streaming.vectors import (
    PartWritten,
    VecStreamWriter,
    append_vectors,
    appended_total,
    epochs,
    finalize,
    read_appended,
)

DIM, N = 4, 203


@pytest.fixture(scope="module")
def vectors(spark):
    rows = [(i, [float(i), -float(i), 0.5, float(i % 7)]) for i in range(N)]
    return spark.createDataFrame(rows, "id long, embedding array<float>").repartition(5).cache()


def rows(df):
    return sorted((r.id, tuple(r.embedding)) for r in df.collect())


@pytest.mark.parametrize("layout", ["plain", "listed"])
def test_layouts_hold_the_same(spark, vectors, tmp_path, layout):
    path = str(tmp_path / "set")
    fields = dict(source="text_dir", source_path="x", granularity="sentence", model_name="m", created_at="now")
    write_dataset(vectors, path, DIM, shards=4, num_queries=9, layout=layout, **fields)
    assert is_complete(path) and resolve_dataset(spark, path)[1].first().num_shards == 4
    validate_dataset(spark, path)
    assert rows(read_vec(spark, path, DIM)) == rows(vectors)
    assert build_shards(spark, path, 2).count() == N
    names = os.listdir(path)
    assert ("docs-shard-0.vec" in names) == (layout == "plain")


def test_a_failed_write_leaves_the_published_one(spark, vectors, tmp_path):
    path = str(tmp_path / "set")
    write_vec(assign_even(vectors, 3), path, DIM, 3, layout="listed")
    short = vectors.withColumn("embedding", F.when(F.col("id") == 150, F.array(F.lit(1.0))).otherwise(F.col("embedding")))
    with pytest.raises(Exception, match="values"):
        write_vec(assign_even(short, 3), path, DIM, 3, layout="listed")
    assert rows(read_vec(spark, path, DIM)) == rows(vectors)
    write_vec(assign_even(vectors.where("id < 50"), 2), path, DIM, 2, layout="listed")
    assert rows(read_vec(spark, path, DIM)) == rows(vectors.where("id < 50"))
    fs, where = filesystem(path)
    assert remove_unlisted(fs, where) >= 3
    assert rows(read_vec(spark, path, DIM)) == rows(vectors.where("id < 50"))


def test_a_torn_entry_does_not_count(tmp_path):
    fs, where = filesystem(str(tmp_path))
    publish(fs, where, {"files": []})
    publish(fs, where, {"files": [["a", 0, 1]]})
    text = json.dumps({"files": [["b", 0, 1]], "whole": True})
    (tmp_path / "_list" / "00000007.json").write_text(text[:-9])
    assert listed(fs, where)["files"] == [["a", 0, 1]]


def test_empty_shards_in_a_list(spark, vectors, tmp_path):
    path = str(tmp_path / "set")
    write_vec(assign_even(vectors.where("id < 2"), 8), path, DIM, 8, layout="listed")
    assert [size for *_, size in dataset_files(path)] == [16, 16, 0, 0, 0, 0, 0, 0]
    assert read_vec(spark, path, DIM).count() == 2
    with pytest.raises(ValueError, match="layout"):
        write_vec(vectors, path, DIM, 1, layout="other")


def planned(path, *filters, **options):
    reader = VecReader({"path": path, "dim": str(DIM), "rangebytes": str(DIM * 4 * 10), **options})
    rest = list(reader.pushFilters(list(filters)))
    return [(p.shard, p.first_id, p.rows) for p in reader.partitions()], rest


def test_conditions_choose_ranges(spark, vectors, tmp_path):
    path = str(tmp_path / "set")
    write_vec(assign_even(vectors, 4), path, DIM, 4)
    assert len(planned(path)[0]) == 23
    found, rest = planned(path, IsNotNull(("id",)), GreaterThan(("id",), 99), LessThanOrEqual(("id",), 121))
    assert found == [(1, 100, 2), (2, 102, 10), (2, 112, 10)] and rest == []
    found, rest = planned(path, In(("shard",), (0, 3)), EqualTo(("id",), 160))
    assert found == [(3, 160, 1)] and rest == []
    some = In(("id",), (5, 60))
    found, rest = planned(path, some)
    assert rest == [some] and found[0][1] == 5 and sum(n for *_, n in found) == 56
    other = EqualTo(("embedding",), None)
    assert planned(path, other)[1] == [other]
    assert planned(path, EqualTo(("id",), 5000))[0] == [(0, 0, 0)]


@pytest.mark.parametrize(
    "condition",
    ["id >= 40 AND id < 130", "id = 7", "id IN (3, 150, 9999)", "shard = 2", "shard IN (0, 3) AND id > 20",
     "id < 0", "id > 5 OR shard = 1", "shard != 1", "id % 2 = 0 AND id <= 90", "embedding[3] = 1"],
)
def test_conditions_change_no_result(spark, vectors, tmp_path, condition):
    path = str(tmp_path / "set")
    docs = assign_even(vectors, 4)
    write_vec(docs, path, DIM, 4)
    assert rows(read_vec(spark, path, DIM).where(condition)) == rows(docs.where(condition))
    places = read_vec(spark, path, DIM, vectors="false")
    if "embedding" not in condition:
        os.truncate(f"{path}/docs-shard-1.vec", os.path.getsize(f"{path}/docs-shard-1.vec"))
        found = places.where(condition)
        assert sorted(map(tuple, found.collect())) == sorted(
            (r.id, r.shard) for r in docs.where(condition).collect()
        )


def test_pushed_conditions_are_not_tested_again(spark, vectors, tmp_path):
    path = str(tmp_path / "set")
    write_vec(assign_even(vectors, 4), path, DIM, 4)
    read = read_vec(spark, path, DIM, rangeBytes=DIM * 4 * 10).where("id >= 100 AND id < 122")
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan
    assert read.rdd.getNumPartitions() == 3


def test_lenient_reading(spark, tmp_path):
    (tmp_path / "docs.vec").write_bytes(np.arange(11, dtype="<f4").tobytes())
    kept = read_vec(spark, str(tmp_path), DIM, on_partial="ignore").collect()
    assert [tuple(r.embedding) for r in kept] == [(0, 1, 2, 3), (4, 5, 6, 7)]


def test_stream_with_tasks_without_rows(spark, vectors, tmp_path):
    inbox, path = (str(tmp_path / n) for n in ("in", "stream"))
    vectors.coalesce(1).write.parquet(inbox)
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for c in before:
            spark.conf.set(c, "512")  # the one row group begins in one of several ranges
        arriving = spark.readStream.schema("id long, embedding array<float>").parquet(inbox)
        append_vectors(arriving, path, DIM, str(tmp_path / "state")).awaitTermination()
    finally:
        for c, value in before.items():
            spark.conf.set(c, value)
    assert [len(e["parts"]) for e in epochs(spark, path)] == [1]
    assert rows(read_appended(spark, path, DIM)) == rows(vectors)


def test_stream_of_vectors(spark, vectors, tmp_path):
    inbox, path, out = (str(tmp_path / n) for n in ("in", "stream", "out"))
    vectors.where("id < 120").repartition(4).write.parquet(inbox)
    arriving = spark.readStream.schema("id long, embedding array<float>").option("maxFilesPerTrigger", 1)

    def run(checkpoint):
        append_vectors(arriving.parquet(inbox), path, DIM, str(tmp_path / checkpoint)).awaitTermination()

    run("state")
    assert appended_total(spark, path) == 120
    vectors.where("id >= 120").write.mode("append").parquet(inbox)
    run("state")
    assert appended_total(spark, path) == N
    totals = [e["total"] for e in epochs(spark, path)]
    assert totals == sorted(totals) and sum(e["rows"] for e in epochs(spark, path)) == N
    parts = sorted(os.listdir(f"{path}/parts"))
    # A stream that starts over sends its epochs again; they are there already.
    run("other-state")
    assert appended_total(spark, path) == N and rows(read_appended(spark, path, DIM)) == rows(vectors)
    assert sorted(os.listdir(f"{path}/parts")) == parts
    assert finalize(spark, path, out, DIM, 4) == N
    batch = str(tmp_path / "batch")
    write_vec(assign_even(vectors, 4), batch, DIM, 4)
    for i in range(4):
        name = f"docs-shard-{i}.vec"
        assert open(f"{out}/{name}", "rb").read() == open(f"{batch}/{name}", "rb").read()


def test_stream_epochs(spark, tmp_path):
    path = str(tmp_path / "stream")
    writer = VecStreamWriter({"path": path, "dim": str(DIM)})

    def batch(*ids):
        values = [[float(i)] * DIM for i in ids]
        return pa.record_batch({"id": pa.array(ids, pa.int64()), "embedding": pa.array(values, pa.list_(pa.float32()))})

    first = writer.write(iter([batch(1, 2), batch(), batch(3)]))
    assert isinstance(first, PartWritten) and first.rows == 3
    assert writer.write(iter([batch()])) is None
    writer.commit([first, None], 0)
    writer.commit([], 1)
    again = writer.write(iter([batch(1, 2, 3)]))
    writer.commit([again], 0)
    assert appended_total(spark, path) == 3 and len(os.listdir(f"{path}/parts")) == 2
    lost = writer.write(iter([batch(8)]))
    writer.abort([lost, None], 2)
    wrong = pa.record_batch({"id": pa.array([9]), "embedding": pa.array([[1.0]], pa.list_(pa.float32()))})
    with pytest.raises(ValueError, match="values"):
        writer.write(iter([batch(7), wrong]))
    assert len(os.listdir(f"{path}/parts")) == 2
    with pytest.raises(ValueError, match="ids"):
        writer.commit([writer.write(iter([batch(3)]))], 2)
        finalize(spark, path, str(tmp_path / "out"), DIM, 2)
    assert epochs(spark, str(tmp_path / "nothing")) == [] and appended_total(spark, str(tmp_path / "no")) == 0


@pytest.mark.parametrize("count", [0, 1, 10, 33, 34, 79, 500])
def test_first_lines_of_many_files(spark, tmp_path, count):
    wanted = []
    for f in range(20):
        texts = [f"text {f} {i}" for i in range(4)]
        lines = [json.dumps({"text": t}) for t in texts] + ["broken {", ""]
        (tmp_path / f"part-{f:02d}.jsonl").write_text("\n".join(lines) + "\n")
        wanted += texts
    found = sorted(map(tuple, read_jsonl(spark, str(tmp_path), max_docs=count).collect()))
    assert found == list(enumerate(wanted))[:count]
    assert sorted(map(tuple, read_jsonl(spark, str(tmp_path)).collect())) == list(enumerate(wanted))


def test_first_lines_read_few_files(spark, tmp_path):
    for f in range(30):
        (tmp_path / f"{f:02d}.txt").write_text(f"a {f}\n\nb {f}\n")
    few = read_messages(spark, str(tmp_path), max_docs=5)
    plan = few._jdf.queryExecution().optimizedPlan()
    assert len(few.inputFiles()) == 3 and "Checkpoint" not in plan.toString()
    assert [r.text for r in few.orderBy("doc_id").collect()] == ["a 0", "b 0", "a 1", "b 1", "a 2"]


def test_one_file_in_several_splits(spark, tmp_path):
    (tmp_path / "all.txt").write_text("".join(f"line {i}\n" for i in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        found = read_messages(spark, str(tmp_path), max_docs=3000).orderBy("doc_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r.doc_id, r.text) for r in found] == [(i, f"line {i}") for i in range(3000)]


def test_means_of_whole_vectors(spark, vectors):
    marked = vectors.withColumn("k", F.col("id") % 3).withColumn(
        "mask", F.when(F.col("k") == 2, 0).when(F.col("id") % 2 == 0, 1).otherwise(F.lit(None)).cast("int")
    )
    data = {r.id: np.array(r.embedding) for r in vectors.collect()}
    for mask in (None, "mask"):
        found = {r.k: r.embedding for r in mean_vectors(marked, "k", mask).collect()}
        for k in range(3):
            own = [v for i, v in data.items() if i % 3 == k and (mask is None or (k != 2 and i % 2 == 0))]
            want = np.sum(own, axis=0) / max(len(own), 1e-9) if own else np.zeros(DIM)
            assert np.allclose(found[k], want)
    plan = mean_vectors(marked, "k", "mask")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan
    assert masked_mean_pool(marked, "k").count() == 3 * DIM
