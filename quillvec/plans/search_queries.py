"""Queries on search and its quality, timings and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillvec.operators import quality, search
from quillvec.operators.candidates import HyperplaneHash, NearestCells
from quillvec.operators.clustering import learn_cells
from quillvec.operators.embedding import centroid_matrix, mean_pool
from quillvec.operators.evaluation import compare_probes, compare_pruned, evaluate
from quillvec.operators.postings import postings_top_k, write_postings
from quillvec.operators.sharding import assign_even, assign_refined
from quillvec.plans.tables import (
    DIM,
    KS,
    LSH_BITS,
    LSH_TABLES,
    MAX_K,
    PROBES,
    SHARDS,
    longs,
    queries,
    rounded,
    sharded,
    table,
    vectors,
)
from quillvec.session import pin, scratch_path
from quillvec.streaming.snapshots import keep_latest, latest_snapshots

TOP = 10
SWEEP = (1, 2, 4, 8)
BLOCK_ROWS = 64
LARGE_KS = (1000, 10000)
FEW_QUERIES = 120
LEARNED_CELLS, LEARNED_PROBES = 16, (1, 2, 4, 8)
HIT_STRUCT = "array<struct<id: bigint, score: double>>"


def lsh() -> HyperplaneHash:
    return HyperplaneHash(LSH_TABLES, LSH_BITS, DIM)


def _shown(hits: DataFrame, *columns: str) -> DataFrame:
    out = hits.select(*columns, "rank", "id", rounded("score", 9).alias("score"))
    return longs(out, *(c for c in ("k", "shard", "rank") if c in out.columns))


def _exact(spark: SparkSession, sf_dir: str, k: int = MAX_K) -> DataFrame:
    return search.top_k(vectors(spark, sf_dir), queries(spark, sf_dir), k, DIM)


def _floored(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """The exact search; with documents enough a score floor is guessed first."""
    docs, asked = vectors(spark, sf_dir), queries(spark, sf_dir)
    if docs.count() < search.FLOOR_GAIN * k:
        return search.top_k(docs, asked, k, DIM)
    return search.guessed_floor_top_k(docs, asked, k, DIM)


def _approximate(spark: SparkSession, sf_dir: str, k: int = MAX_K, rule=None) -> DataFrame:
    return search.top_k(vectors(spark, sf_dir), queries(spark, sf_dir), k, DIM, rule or lsh())


def knn_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_exact(spark, sf_dir, TOP), "qid")


def knn_per_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search.per_shard_top_k(sharded(spark, sf_dir), queries(spark, sf_dir), TOP, DIM)
    return _shown(hits, "qid", "shard")


def knn_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_shard = search.per_shard_top_k(sharded(spark, sf_dir), queries(spark, sf_dir), TOP, DIM)
    return _shown(search.merge_top_k(per_shard, TOP), "qid")


def knn_multi_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(search.at_each_k(_exact(spark, sf_dir), KS), "k", "qid")


def knn_large_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Very long hit lists, summed up: how many hits, the last score, the sum of ids."""
    found = search.at_each_k(_floored(spark, sf_dir, max(LARGE_KS)), LARGE_KS)
    lists = found.groupBy("k", "qid").agg(
        F.count(F.lit(1)).alias("hits"), F.min("score").alias("last"), F.sum("id").alias("ids")
    )
    return longs(lists.withColumn("last", rounded("last", 9)), "k")


def knn_small_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors a hundred thousand times shorter have the same neighbours."""
    short = F.transform("embedding", lambda x: (x.cast("double") * 1e-5).cast("float"))
    docs = vectors(spark, sf_dir).withColumn("embedding", short)
    hits = search.top_k(docs, search.query_set(docs), TOP, DIM)
    return _shown(hits.withColumn("score", F.col("score") * 1e10), "qid")


def knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of different lengths, ranked by cosine."""
    docs = _of_lengths(spark, sf_dir)
    return _shown(search.top_k(docs, search.query_set(docs), TOP, DIM, metric="cosine"), "qid")


def knn_stored_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact search with a query set beyond the broadcast bound, set low here."""
    asked = search.load_queries(queries(spark, sf_dir), DIM, max_broadcast_bytes=DIM * 8 * 150)
    return _shown(search.top_k(vectors(spark, sf_dir), asked, TOP, DIM), "qid")


def knn_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_approximate(spark, sf_dir, TOP), "qid")


def knn_lsh_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search from stored posting lists; only listed pairs are scored."""
    path = scratch_path(spark, "postings")
    write_postings(vectors(spark, sf_dir).select("id", "embedding"), lsh(), path)
    found = postings_top_k(vectors(spark, sf_dir), _asked(spark, sf_dir), TOP, lsh(), path)
    return _shown(found, "qid")


def cells(spark: SparkSession, sf_dir: str) -> NearestCells:
    """One cell per label."""
    pooled = mean_pool(vectors(spark, sf_dir), "label")
    return NearestCells(centroid_matrix(pooled, "label", DIM), PROBES)


def knn_ivf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_approximate(spark, sf_dir, TOP, cells(spark, sf_dir)), "qid")


def knn_ivf_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search over documents stored by cell, reading visited cells only."""
    rule, path = cells(spark, sf_dir), scratch_path(spark, "cells")
    search.write_cells(vectors(spark, sf_dir).select("id", "embedding"), rule, path)
    asked = _asked(spark, sf_dir)
    stored = search.visited_cells(spark.read.parquet(path), asked, rule)
    return _shown(search.top_k(stored, asked, TOP, DIM, rule), "qid")


def knn_floor_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = sharded(spark, sf_dir)
    return _shown(search.floor_pruned_top_k(docs, queries(spark, sf_dir), TOP, DIM), "qid")


def lookups_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = sharded(spark, sf_dir)
    return longs(search.lookups_saved(docs, queries(spark, sf_dir), DIM, SHARDS, lsh()), "shard")


def _per_query(spark: SparkSession, sf_dir: str, asked: search.QuerySet, rule=None) -> DataFrame:
    docs = vectors(spark, sf_dir)
    found = search.top_k(docs, asked, MAX_K, DIM, rule or lsh())
    exact = search.top_k(docs, asked, MAX_K, DIM)
    return quality.overlaps(found, exact, asked.frame, KS)


def _asked(spark: SparkSession, sf_dir: str) -> search.QuerySet:
    return search.load_queries(queries(spark, sf_dir), DIM)


def knn_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _per_query(spark, sf_dir, _asked(spark, sf_dir))
    return longs(rows.select("k", "qid", "overlap", "retrieved", "relevant"), "k")


def knn_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _per_query(spark, sf_dir, _asked(spark, sf_dir)).select(
        "k", "qid", rounded("recall").alias("recall"), rounded("recall_at_k").alias("recall_at_k")
    )
    return longs(rows, "k")


def _report(spark: SparkSession, sf_dir: str, asked: search.QuerySet, rule=None) -> DataFrame:
    return evaluate(sharded(spark, sf_dir), asked, KS, SHARDS, rule or lsh()).report


def search_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall, lookups saved and sizes per K: the run summary."""
    return _report(spark, sf_dir, _asked(spark, sf_dir))


def search_report_few(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report over the first queries of the set only."""
    docs, asked = sharded(spark, sf_dir), _asked(spark, sf_dir)
    return evaluate(docs, asked, KS, SHARDS, lsh(), max_queries=FEW_QUERIES).report


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = _report(spark, sf_dir, _asked(spark, sf_dir))
    return longs(quality.summary_lines(report, "embeddings"), "k")


def topk_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "topk")
    ranked = search.at_each_k(_exact(spark, sf_dir), KS)
    quality.top_k_lines(ranked).select("line").write.text(path)
    return spark.read.text(path).withColumnRenamed("value", "line")


def ab_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashing against cells on the same data."""
    asked = _asked(spark, sf_dir)
    hashed = _report(spark, sf_dir, asked)
    by_cell = _report(spark, sf_dir, asked, cells(spark, sf_dir))
    both = quality.compare_runs(hashed, by_cell)
    return both.withColumn("merged_recall_delta", rounded("merged_recall_delta", 4))


def _of_lengths(spark: SparkSession, sf_dir: str, power: int = 1) -> DataFrame:
    """The vectors with lengths of one to seven, or a power of these."""
    factor = F.pow(F.col("id") % 7 + 1, F.lit(power))
    longer = F.transform("embedding", lambda x: (x.cast("double") * factor).cast("float"))
    return vectors(spark, sf_dir).withColumn("embedding", longer)


def _blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of different lengths in shards, stored in blocks of about equal length."""
    path = scratch_path(spark, "blocks")
    docs = assign_even(_of_lengths(spark, sf_dir, 2).drop("label"), SHARDS)
    blocks = search.by_length(docs, BLOCK_ROWS)
    blocks.repartitionByRange("block").sortWithinPartitions("block").write.parquet(path)
    return spark.read.parquet(path)


def knn_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact search of vectors of different lengths, skipping blocks below the floor."""
    docs = _blocked(spark, sf_dir)
    hits = search.floor_pruned_top_k(docs, search.query_set(docs), TOP, DIM)
    return _shown(hits.withColumn("score", F.col("score") * 1e-3), "qid")


def ab_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full search of all shards against the search with a shared floor, work counted."""
    docs = _blocked(spark, sf_dir)
    return compare_pruned(docs, search.load_queries(search.query_set(docs), DIM), TOP)


def knn_ivf_learned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall against the share of pairs scored, over cells learned without labels."""
    docs = vectors(spark, sf_dir)
    centroids = learn_cells(docs, DIM, LEARNED_CELLS)
    return compare_probes(docs, _asked(spark, sf_dir), TOP, centroids, LEARNED_PROBES)


def shard_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per shard count and K: hits gathered from the shards, and recall after merging.

    One scan over the common refinement of all splits, with the exact search as a second
    arm; a shard's hits are those of its pieces.
    """
    asked, docs = _asked(spark, sf_dir), vectors(spark, sf_dir)
    cut, owner = assign_refined(docs, SWEEP, docs.count())
    arms = (search.Arm(lsh()), search.Arm(by_shard=False))
    scanned = pin(search.scan_arms(cut, asked, MAX_K, DIM, arms))
    places = F.array(
        *(
            F.struct(
                F.lit(n).cast("long").alias("num_shards"),
                F.get(F.array(*map(F.lit, of)), F.col("shard")).alias("shard"),
            )
            for n, of in owner.items()
        )
    )
    hits = search.arm_hits(scanned, 0).select("qid", "id", "score", F.inline(places))
    run = ("num_shards", "qid")
    per_shard = search.best_k(hits, MAX_K, (*run, "shard"))
    gathered = F.inline(
        F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"g{k}").alias("gathered")) for k in KS))
    )
    counts = (
        per_shard.groupBy("num_shards")
        .agg(*(F.count_if(F.col("rank") <= k).alias(f"g{k}") for k in KS))
        .select("num_shards", gathered)
    )
    merged = search.best_k(per_shard.drop("rank"), MAX_K, run)
    exact = search.best_k(search.arm_hits(scanned, 1).drop("shard"), MAX_K)
    runs = asked.frame.select(
        "qid", F.explode(F.array(*(F.lit(n).cast("long") for n in SWEEP))).alias("num_shards")
    )
    per_query = quality.overlaps(merged, exact, runs, KS, run)
    recall = quality.mean_recall(per_query, ("num_shards", "k"))
    return recall.join(counts, ["num_shards", "k"]).select(
        "num_shards", F.col("k").cast("long").alias("k"), "gathered", "merged_recall", "num_queries"
    )


def _pushes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard pushes: every shard its top 10 first, even shards their top 100 later."""
    hits = search.per_shard_top_k(sharded(spark, sf_dir), queries(spark, sf_dir), MAX_K, DIM)
    limits = F.array(
        F.struct(F.lit(0).alias("seq"), F.lit(KS[0]).alias("size")),
        F.struct(F.lit(1).alias("seq"), F.lit(KS[1]).alias("size")),
    )
    pushed = hits.select("qid", "shard", "rank", "id", "score", F.inline(limits)).where(
        (F.col("rank") <= F.col("size")) & ((F.col("seq") == 0) | (F.col("shard") % 2 == 0))
    )
    # A snapshot holds at most the K hits of one shard for one query.
    return pushed.groupBy("qid", "shard", "seq").agg(
        F.array_sort(F.collect_list(F.struct("id", "score"))).alias("hits")
    )


def snapshot_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    floors = search.snapshot_floor(_pushes(spark, sf_dir), MAX_K)
    return floors.withColumn("floor", rounded("floor", 9))


def stream_snapshot_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    inbox, slots = scratch_path(spark, "pushes"), scratch_path(spark, "slots")
    _pushes(spark, sf_dir).write.partitionBy("seq").parquet(inbox)
    schema = f"qid bigint, shard int, hits {HIT_STRUCT}, seq int"
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(inbox)
    keep_latest(arriving, slots, scratch_path(spark, "slots-state")).awaitTermination()
    latest = latest_snapshots(spark.read.parquet(slots))
    return search.snapshot_floor(latest, MAX_K).withColumn("floor", rounded("floor", 9))


def _run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table read as a log of shard searches; errors have no visit count."""
    slow = F.col("event_type").isin("view", "click")
    return table(spark, sf_dir, "events").select(
        F.when(slow, 100).otherwise(10).cast("long").alias("k"),
        F.col("user_id").alias("qid"),
        (F.col("event_id") % SHARDS).alias("shard"),
        F.floor("value").alias("elapsed_ms"),
        F.when(F.col("event_type") == "error", -1).otherwise(F.floor(F.col("value") * 7))
        .cast("long").alias("visited"),
        F.lit(500).cast("long").alias("num_docs"),
    )


def run_log_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = quality.run_log_report(_run_log(spark, sf_dir))
    means = ("avg_shard_ms", "stddev_ms", "min_shard_ms", "max_shard_ms")
    return report.withColumns({c: rounded(c) for c in means})


def batch_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table read as a log of embed calls of 500 vectors, one run per type."""
    log = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("run"),
        F.col("event_id").alias("batch"),
        F.lit(500).cast("long").alias("vectors"),
        F.floor(F.col("value") * 10).alias("elapsed_ms"),
    )
    shown = ("vectors_done", "ms_done", "percent", "vectors_per_s", "eta_s")
    return quality.batch_progress(log, "run").select("run", "batch", *shown)


QUERIES = {
    "knn_exact": knn_exact,
    "knn_per_shard": knn_per_shard,
    "knn_merge": knn_merge,
    "knn_multi_k": knn_multi_k,
    "knn_large_k": knn_large_k,
    "knn_small_norms": knn_small_norms,
    "knn_cosine": knn_cosine,
    "knn_stored_queries": knn_stored_queries,
    "knn_lsh": knn_lsh,
    "knn_lsh_postings": knn_lsh_postings,
    "knn_ivf": knn_ivf,
    "knn_ivf_stored": knn_ivf_stored,
    "knn_floor_pruned": knn_floor_pruned,
    "lookups_saved": lookups_saved,
    "knn_overlap": knn_overlap,
    "knn_recall": knn_recall,
    "search_report": search_report,
    "search_report_few": search_report_few,
    "summary_lines": summary,
    "topk_dump": topk_dump,
    "ab_compare": ab_compare,
    "knn_zones": knn_zones,
    "ab_pruned": ab_pruned,
    "shard_sweep": shard_sweep,
    "snapshot_floor": snapshot_floor,
    "stream_snapshot_floor": stream_snapshot_floor,
    "run_log_report": run_log_report,
    "batch_progress": batch_progress,
}

#: Learning is iterative and beyond SQL; the tests have a plain version.
UNCHECKED = {"knn_ivf_learned": knn_ivf_learned}
