"""The search test as one call: shards and queries in, report and hit lists out."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillvec.operators import quality, search
from quillvec.operators.candidates import NearestCells
from quillvec.session import pin


@dataclass(frozen=True)
class Evaluation:
    """Frames of one run; the scan is done, what is made of its rows is computed when used."""

    hits: DataFrame  # (qid, rank, id, score) at the largest K
    per_query: DataFrame  # overlap and recall per (k, qid)
    saved: DataFrame  # lookups saved per (qid, shard)
    report: DataFrame  # one row per K

    def dump(self, ks: tuple[int, ...]) -> DataFrame:
        """Hit lists as text lines, for comparing runs line by line."""
        return quality.top_k_lines(search.at_each_k(self.hits, ks))


def evaluate(
    docs: DataFrame,
    queries: search.QuerySet,
    ks: tuple[int, ...] = search.DEFAULT_KS,
    shards: int = 1,
    rule=None,
    max_queries: int | None = None,
    run_log: DataFrame | None = None,
    total: int | None = None,
    metric: str = "dot",
) -> Evaluation:
    """Search ``docs(id, shard, embedding)`` and compare with exact results.

    One scan of the documents finds hits and truth and counts the work, whatever
    the number of Ks; its rows, K per query and task, are kept in the shared folder. The
    hits are those of full-K searches of every shard, merged, which needs no ranking
    per shard. Where it saves enough, a score floor is used, which leaves the results as
    they are.
    """
    k, dim = max(ks), queries.dim
    if max_queries is not None:
        some = queries.frame.where(F.col("qid") < max_queries)
        queries = search.load_queries(some, dim, queries.max_broadcast_bytes)
    n = docs.count() if total is None else total
    arms = (search.Arm(rule, "floor_found"), search.Arm(None, "floor_exact"))
    if search.floor_repays(n, k):
        first = pin(search.scan_arms(search.floor_part(docs, n), queries, k, dim, arms, metric=metric))
        frame = queries.frame
        for number, arm in enumerate(arms):
            best = search.best_k(search.arm_hits(first, number).drop("shard"), k)
            floors = search.kth_scores(best, k).withColumnRenamed("floor", arm.floor)
            frame = frame.join(floors, "qid", "left")
        queries = search.load_queries(frame, dim, queries.max_broadcast_bytes)
    scanned = pin(search.scan_arms(docs, queries, k, dim, arms, metric=metric, counts=True))
    hits, exact = (
        search.best_k(search.arm_hits(scanned, number).drop("shard"), k) for number in range(2)
    )
    per_query = quality.overlaps(hits, exact, queries.frame, ks)
    saved = search.saved_lookups(search.arm_counts(scanned, 0), search.scanned_sizes(scanned))
    report = quality.search_report(per_query, saved, n, shards, run_log)
    return Evaluation(hits, per_query, saved, report)


def compare_pruned(docs: DataFrame, queries: search.QuerySet, k: int) -> DataFrame:
    """Full search of every shard against a search that shares its score floor, with the work of both.

    ``docs`` is ``(id, shard, embedding, reach)``, see ``search.by_length``. The second
    search first takes shard 0 alone; its K-th scores then let whole blocks go
    unmultiplied and hits unsent. Both are arms of one scan. One row: ``k, num_queries``
    and per arm (``_a``, ``_b``) the mean recall, the documents scored, that first search
    included, and the hits handed on by the shards, summed over queries.
    """
    dim = queries.dim
    first = search.top_k(docs.where("shard = 0"), queries, k, dim)
    floored = queries.frame.join(search.kth_scores(first, k), "qid", "left")
    arms = (search.Arm(floor="none", zones=False), search.Arm(fixed=True))
    scanned = pin(search.scan_arms(docs, floored, k, dim, arms, counts=True))
    shards = [search.per_shard_best(search.arm_hits(scanned, n), k) for n in range(2)]
    merged = [search.merge_top_k(hits, k) for hits in shards]
    recall = [
        quality.mean_recall(quality.overlaps(hits, merged[0], queries.frame, (k,))).select(
            "k", "num_queries", F.col("merged_recall").alias(f"merged_recall_{arm}")
        )
        for arm, hits in zip("ab", merged)
    ]
    start = F.col("num_queries") * search.scanned_sizes(scanned).where("shard = 0").agg(
        F.coalesce(F.sum("size"), F.lit(0))
    ).scalar()
    scored = [search.arm_counts(scanned, n).agg(F.sum("scored")).scalar() for n in range(2)]
    handed = [hits.agg(F.count(F.lit(1))).scalar() for hits in shards]
    return recall[0].join(recall[1].drop("num_queries"), "k").select(
        F.col("k").cast("long").alias("k"),
        "num_queries",
        "merged_recall_a",
        "merged_recall_b",
        scored[0].alias("scored_a"),
        (scored[1] + start).alias("scored_b"),
        handed[0].alias("handed_a"),
        handed[1].alias("handed_b"),
    )


def compare_probes(
    docs: DataFrame,
    queries: search.QuerySet,
    k: int,
    centroids: np.ndarray,
    probes: tuple[int, ...],
    metric: str = "dot",
) -> DataFrame:
    """Recall against work: ``(probes, k, num_queries, merged_recall, scored_share)``.

    All numbers of probes and the exact search are arms of one scan; ``scored_share`` is
    the part of all query and document pairs that was scored.
    """
    arms = (*(search.Arm(NearestCells(centroids, p)) for p in probes), search.Arm())
    scanned = pin(
        search.scan_arms(
            docs, queries, k, queries.dim, arms, by_shard=False, counts=True, metric=metric
        )
    )
    exact = search.best_k(search.arm_hits(scanned, len(probes)).drop("shard"), k)
    size = search.scanned_sizes(scanned).agg(F.sum("size")).scalar()
    rows = []
    for number, count in enumerate(probes):
        hits = search.best_k(search.arm_hits(scanned, number).drop("shard"), k)
        work = search.arm_counts(scanned, number).agg(F.sum("scored")).scalar()
        share = F.round(work / (size * F.col("num_queries")), 4)
        mean = quality.mean_recall(quality.overlaps(hits, exact, queries.frame, (k,)))
        rows.append(
            mean.select(
                F.lit(count).cast("long").alias("probes"),
                F.col("k").cast("long").alias("k"),
                "num_queries",
                F.col("recall_at_k").alias("merged_recall"),
                share.alias("scored_share"),
            )
        )
    return reduce(DataFrame.unionByName, rows)
