import math

from pyspark.sql import functions as F

from quillvec.operators import quality, search
from quillvec.operators.candidates import HyperplaneHash
from quillvec.operators.evaluation import evaluate
from quillvec.plans.tables import sharded


def ranking(spark, rows):
    return spark.createDataFrame(rows, "qid long, id long, rank int")


def test_overlap_and_recall(spark):
    exact = ranking(spark, [(q, d, d + 1) for q in (0, 1, 2) for d in range(4)])
    found = ranking(spark, [(0, 0, 1), (0, 9, 2), (0, 1, 3), (1, 3, 1)])
    asked = spark.range(3).withColumnRenamed("id", "qid")
    rows = {(r.k, r.qid): r for r in quality.overlaps(found, exact, asked, (2, 4)).collect()}
    assert len(rows) == 6
    assert (rows[2, 0].overlap, rows[2, 0].retrieved) == (1, 2)
    assert (rows[4, 0].overlap, rows[4, 0].retrieved, rows[4, 0].relevant) == (2, 3, 4)
    assert rows[2, 1].overlap == 0 and rows[4, 1].recall == 1.0 and rows[4, 1].recall_at_k == 0.25
    assert rows[4, 2].recall == 0.0  # nothing retrieved still counts
    means = {r.k: r for r in quality.mean_recall(quality.overlaps(found, exact, asked, (4,))).collect()}
    assert means[4].num_queries == 3
    assert means[4].merged_recall == round((2 / 3 + 1 + 0) / 3, 4)


def test_exact_results_have_full_recall(spark):
    exact = ranking(spark, [(0, d, d + 1) for d in range(3)])
    asked = spark.range(1).withColumnRenamed("id", "qid")
    row = quality.mean_recall(quality.overlaps(exact, exact, asked, (10,))).first()
    assert row.merged_recall == row.recall_at_k == 1.0


LOG = "k long, qid long, shard int, elapsed_ms long, visited long, num_docs long"


def test_run_log(spark):
    log = spark.createDataFrame(
        [
            (10, 0, 0, 1, 40, 50), (10, 0, 1, 4, 60, 50),  # more visits than documents saves 0
            (10, 1, 0, 2, 30, 50), (10, 1, 1, 2, 25, 50),
            (99, 0, 0, 7, -1, 50),
        ],
        LOG,
    )
    rows = {r.k: r for r in quality.run_log_report(log).collect()}
    assert rows[10].latency_ms == 3  # (4 + 2) div 2
    assert rows[10].avg_shard_ms == 2.25
    assert math.isclose(rows[10].stddev_ms, 1.5 / 2)
    assert (rows[10].min_shard_ms, rows[10].max_shard_ms) == (1.5, 3.0)
    assert rows[10].lookups_saved == 27  # (10 + 45) div 2
    assert rows[99].lookups_saved is None and rows[99].num_queries == 1


def test_summary_and_dump_lines(spark):
    report = spark.createDataFrame(
        [(10, 0.5, 7, 100, 4, 20, 3, 1.25, 0.5)],
        "k long, merged_recall double, lookups_saved long, num_docs long, num_shards long, "
        "num_queries long, latency_ms long, avg_shard_ms double, stddev_ms double",
    )
    line = quality.summary_lines(report, "set").first().line
    assert line.split("\t") == [
        "SUMMARY", "set", "10", "3", "1.3", "0.5", "0.5000", "7", "100", "4", "20",
    ]
    bare = quality.summary_lines(report.select("k", F.lit(None).cast("double").alias("merged_recall")), "s")
    assert "N/A" in bare.first().line
    ranked = ranking(spark, [(5, 8, 2), (5, 3, 1)]).withColumn("k", F.lit(10))
    assert quality.top_k_lines(ranked).first().line == "K=10\tq=5\tids=3,8"


def test_compare_keeps_unmatched_k(spark):
    schema = "k long, merged_recall double, lookups_saved long"
    a = spark.createDataFrame([(10, 0.5, 3), (100, 0.6, 4)], schema)
    b = spark.createDataFrame([(10, 0.75, 9), (7, 0.1, 1)], schema)
    rows = {r.k: r for r in quality.compare_runs(a, b).collect()}
    assert set(rows) == {7, 10, 100}
    assert rows[10].merged_recall_delta == 0.25 and rows[10].lookups_saved_delta == 6
    assert rows[7].merged_recall_delta is None


def test_progress(spark):
    batches = spark.createDataFrame(
        [("a", 0, 500, 1000), ("a", 1, 300, 1000), ("b", 0, 10, 0), ("b", 1, 10, 500)],
        "run string, batch long, vectors long, elapsed_ms long",
    )
    rows = {(r.run, r.batch): r for r in quality.batch_progress(batches, "run").collect()}
    assert (rows["a", 0].vectors_done, rows["a", 0].percent) == (500, 62.5)
    assert (rows["a", 0].vectors_per_s, rows["a", 0].eta_s) == (500.0, 0.6)
    assert rows["a", 1].percent == 100.0 and rows["a", 1].eta_s == 0.0
    assert rows["b", 0].vectors_per_s == 0.0 and rows["b", 1].vectors_done == 20


def test_evaluation_with_floors_is_the_same(spark, sf_dir, monkeypatch):
    docs = sharded(spark, sf_dir)
    asked = search.load_queries(search.query_set(docs, 50), 64)
    run = lambda: evaluate(docs, asked, (5, 20), 8, HyperplaneHash(4, 4, 64))
    plain = run()
    monkeypatch.setattr(search, "FLOOR_GAIN", 0)
    monkeypatch.setattr(search, "ROWS_PER_TASK", 30)
    floored = run()
    key = lambda r: (r.qid, r["rank"])
    rows = [[(r.qid, r["rank"], r.id, r.score) for r in sorted(e.hits.collect(), key=key)]
            for e in (plain, floored)]
    assert rows[0] == rows[1]
    assert sorted(plain.report.collect()) == sorted(floored.report.collect())


def test_evaluation_in_one_call(spark, sf_dir):
    docs = sharded(spark, sf_dir)
    asked = search.load_queries(search.query_set(docs), 64)
    exact = evaluate(docs, asked, (5, 1000), 8, max_queries=20)
    rows = {r.k: r for r in exact.report.collect()}
    assert {r.merged_recall for r in rows.values()} == {1.0}  # K beyond the data as well
    assert rows[5].num_queries == 20 and rows[5].lookups_saved == 0
    assert exact.dump((5, 1000)).count() == 40
    log = spark.createDataFrame([(5, q, s, q + s, 1, 50) for q in range(3) for s in range(2)], LOG)
    line = quality.summary_lines(
        evaluate(docs, asked, (5,), 8, HyperplaneHash(2, 4, 64), 20, log).report, "set"
    ).first().line.split("\t")
    assert line[3:6] == ["2", "1.5", "0.5"] and int(line[7]) > 0
