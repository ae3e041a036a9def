"""Search quality: overlap with exact results, recall, reports, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillvec.operators.ids import running_sums


def overlaps(
    retrieved: DataFrame,
    exact: DataFrame,
    queries: DataFrame,
    ks: tuple[int, ...],
    by: tuple[str, ...] = ("qid",),
) -> DataFrame:
    """``(k, qid, overlap, retrieved, relevant, recall, recall_at_k)`` per K and query.

    ``retrieved`` and ``exact`` are rankings ``(qid, id, rank)`` at the largest K.
    They meet in one equi-join on ``(qid, id)``; every K is then a condition on
    the two ranks. ``recall`` divides by what was retrieved, ``recall_at_k`` by
    what could have been. A query without hits counts with recall 0. More columns
    in ``by``, present in ``retrieved`` and ``queries``, keep several runs apart.
    """
    truth = exact.select("qid", "id", F.col("rank").alias("e"))
    pairs = retrieved.select(*by, "id", F.col("rank").alias("r")).join(truth, ["qid", "id"], "left")
    # Conditional counts per K in one aggregate: no row is copied per K.
    found = pairs.groupBy(*by).agg(
        *(F.count_if((F.col("r") <= k) & (F.col("e") <= k)).alias(f"o{k}") for k in ks),
        *(F.count_if(F.col("r") <= k).alias(f"r{k}") for k in ks),
    )
    possible = truth.groupBy("qid").agg(*(F.count_if(F.col("e") <= k).alias(f"e{k}") for k in ks))
    per_k = F.array(
        *(
            F.struct(
                F.lit(k).alias("k"),
                *(
                    F.coalesce(F.col(f"{c}{k}"), F.lit(0)).alias(name)
                    for c, name in (("o", "overlap"), ("r", "retrieved"), ("e", "relevant"))
                ),
            )
            for k in ks
        )
    )

    def share(part: str, whole: str) -> Column:
        return F.coalesce(F.try_divide(F.col(part), F.col(whole)), F.lit(0.0))

    return (
        queries.select(*by)
        .join(found, list(by), "left")
        .join(possible, "qid", "left")
        .select(*by, F.inline(per_k))
        .withColumn("recall", share("overlap", "retrieved"))
        .withColumn("recall_at_k", share("overlap", "relevant"))
    )


def mean_recall(per_query: DataFrame, by: tuple[str, ...] = ("k",)) -> DataFrame:
    """``(k, num_queries, merged_recall, recall_at_k)``, rounded to four decimals."""
    return per_query.groupBy(*by).agg(
        F.count(F.lit(1)).alias("num_queries"),
        F.round(F.avg("recall"), 4).alias("merged_recall"),
        F.round(F.avg("recall_at_k"), 4).alias("recall_at_k"),
    )


def mean_lookups_saved(saved: DataFrame) -> DataFrame:
    """One row: lookups saved summed over shards, integer mean over queries."""
    per_query = saved.groupBy("qid").agg(F.sum("saved").alias("saved"))
    return per_query.agg(F.floor(F.sum("saved") / F.count(F.lit(1))).alias("lookups_saved"))


def search_report(
    per_query: DataFrame, saved: DataFrame, num_docs: int, shards: int, run_log=None
) -> DataFrame:
    """One row per K: recall, lookups saved and sizes; timings when a run log is given."""
    report = mean_recall(per_query).select(
        F.col("k").cast("long").alias("k"),
        "merged_recall",
        "recall_at_k",
        mean_lookups_saved(saved).scalar().alias("lookups_saved"),
        F.lit(num_docs).cast("long").alias("num_docs"),
        F.lit(shards).cast("long").alias("num_shards"),
        "num_queries",
    )
    if run_log is not None:
        timing = run_log_report(run_log).select("k", "latency_ms", "avg_shard_ms", "stddev_ms")
        report = report.join(timing, "k", "left")
    return report


def summary_lines(report: DataFrame, dataset: str) -> DataFrame:
    """Tab-separated report lines; a missing recall prints as N/A."""

    def shown(name: str, fmt: str) -> Column:
        if name not in report.columns:
            return F.lit("N/A")
        return F.coalesce(F.format_string(fmt, F.col(name)), F.lit("N/A"))

    fields = [
        F.lit("SUMMARY"),
        F.lit(dataset),
        shown("k", "%d"),
        shown("latency_ms", "%d"),
        shown("avg_shard_ms", "%.1f"),
        shown("stddev_ms", "%.1f"),
        shown("merged_recall", "%.4f"),
        shown("lookups_saved", "%d"),
        shown("num_docs", "%d"),
        shown("num_shards", "%d"),
        shown("num_queries", "%d"),
    ]
    return report.select("k", F.concat_ws("\t", *fields).alias("line"))


def top_k_lines(ranked: DataFrame) -> DataFrame:
    """``K=..<tab>q=..<tab>ids=a,b,c`` per ``(k, qid)``; a list holds at most K ids."""
    ids = F.array_sort(F.collect_list(F.struct("rank", "id")))
    listed = ranked.groupBy("k", "qid").agg(F.transform(ids, lambda s: s["id"]).alias("ids"))
    line = F.format_string(
        "K=%d\tq=%d\tids=%s", "k", "qid", F.array_join(F.col("ids").cast("array<string>"), ",")
    )
    return listed.select("k", "qid", line.alias("line"))


def run_log_report(log: DataFrame) -> DataFrame:
    """Timing per K from ``(k, qid, shard, elapsed_ms, visited, num_docs)``.

    Per query first (latency is the slowest shard), then over queries. Means of
    latency and lookups saved are integer divisions; the standard deviation is
    that of the population. Without any visit count the savings are null.
    """
    saved = F.when(
        F.col("visited") >= 0, F.greatest(F.lit(0), F.col("num_docs") - F.col("visited"))
    )
    per_query = log.groupBy("k", "qid").agg(
        F.max("elapsed_ms").alias("latency"),
        F.avg("elapsed_ms").alias("mean"),
        F.stddev_pop("elapsed_ms").alias("dev"),
        F.min("elapsed_ms").alias("low"),
        F.max("elapsed_ms").alias("high"),
        F.sum(saved).alias("saved"),
    )
    queries = F.count(F.lit(1))
    return per_query.groupBy("k").agg(
        queries.alias("num_queries"),
        F.floor(F.sum("latency") / queries).alias("latency_ms"),
        F.avg("mean").alias("avg_shard_ms"),
        F.avg("dev").alias("stddev_ms"),
        F.avg("low").alias("min_shard_ms"),
        F.avg("high").alias("max_shard_ms"),
        F.floor(F.sum("saved") / F.count("saved")).alias("lookups_saved"),
    )


def compare_runs(base: DataFrame, other: DataFrame) -> DataFrame:
    """Two reports side by side per K, with differences ``other - base``."""
    measures = ("merged_recall", "lookups_saved")

    def side(df: DataFrame, suffix: str) -> DataFrame:
        return df.select("k", *(F.col(m).alias(f"{m}_{suffix}") for m in measures))

    joined = side(base, "a").join(side(other, "b"), "k", "full")
    return joined.withColumns(
        {f"{m}_delta": F.col(f"{m}_b") - F.col(f"{m}_a") for m in measures}
    )


def batch_progress(batches: DataFrame, group: str) -> DataFrame:
    """Running vectors, percent, rate and remaining seconds after each batch of a run.

    ``batches`` is ``(group, batch, vectors, elapsed_ms)``. The running sums are
    taken over all runs in (group, batch) order and shifted to start at zero in
    every run, so a run with very many batches is still spread over tasks.
    """
    sums = running_sums(
        batches, [group, "batch"], {"_v": F.col("vectors"), "_ms": F.col("elapsed_ms")}
    )
    runs = sums.groupBy(group).agg(
        F.min("_v").alias("_v0"), F.min("_ms").alias("_ms0"), F.sum("vectors").alias("_all")
    )
    done, ms = F.col("vectors_done"), F.col("ms_done")
    return (
        sums.join(runs, group)
        .withColumn("vectors_done", F.col("_v") - F.col("_v0") + F.col("vectors"))
        .withColumn("ms_done", F.col("_ms") - F.col("_ms0") + F.col("elapsed_ms"))
        .withColumn("percent", 100 * done / F.col("_all"))
        .withColumn("vectors_per_s", F.when(ms > 0, 1000 * done / ms).otherwise(0.0))
        .withColumn("eta_s", F.when(done > 0, (F.col("_all") - done) * ms / (1000 * done)))
        .drop("_v", "_ms", "_v0", "_ms0", "_all")
    )
