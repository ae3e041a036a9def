"""Times the headline queries; prints one JSON line.

Every query runs once to warm up (worker start, code generation), then
``BENCH_RUNS`` times; the median counts. Results are consumed whole by a
``noop`` write.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from quillvec.plans import registry
from quillvec.session import local_session

HEADLINE = (
    "chunk_sentences",
    "chunk_paragraphs",
    "corpus_profile",
    "embed_chunks",
    "chunk_ids",
    "stream_equals_batch",
    "vec_dedup",
    "vec_roundtrip",
    "vec_dataset_scan",
    "vec_pushdown",
    "vec_publish",
    "stream_vec_equals_batch",
    "src_jsonl",
    "src_jsonl_first",
    "mean_pool",
    "doc_vectors",
    "shard_sizes",
    "knn_exact",
    "knn_per_shard",
    "knn_merge",
    "knn_multi_k",
    "knn_cosine",
    "knn_large_k",
    "knn_stored_queries",
    "knn_lsh",
    "knn_lsh_postings",
    "knn_zones",
    "knn_ivf_learned",
    "ab_pruned",
    "knn_ivf",
    "knn_floor_pruned",
    "lookups_saved",
    "knn_recall",
    "search_report",
    "dataset_report",
    "shard_sweep",
    "snapshot_floor",
    "run_log_report",
    "batch_progress",
    "knn_corpus",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    wanted = os.environ.get("BENCH_QUERIES")
    names = wanted.split(",") if wanted else HEADLINE
    spark = local_session(cpus, "bench", spark__sql__shuffle__partitions=cpus)

    def timed(name: str) -> float:
        start = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in names:
        timed(name)
        seconds[name] = round(statistics.median(timed(name) for _ in range(runs)), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "sum of query times",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
