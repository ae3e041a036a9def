"""Whole vector datasets: writing, cutting into shards, removing duplicates."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillvec.operators.dedup import dedup_vectors
from quillvec.operators.evaluation import Evaluation, evaluate
from quillvec.operators.search import DEFAULT_KS, DEFAULT_QUERIES, load_queries, query_set
from quillvec.operators.sharding import assign_even, regroup, shard_sizes
from quillvec.session import scratch_path
from quillvec.sources.manifest import (
    build_manifest,
    is_complete,
    read_manifest,
    remove_manifest,
    validate_dataset,
    write_manifest,
)
from quillvec.sources.vecfile import read_vec, write_vec

DEFAULT_SHARDS = 16
SHARD_BYTES = 1 << 30


def fitting_shards(rows: int, dim: int) -> int:
    """A multiple of 16, so that regrouping stays possible, with shards of about a gigabyte."""
    files = -(-rows * dim * 4 // SHARD_BYTES)
    return DEFAULT_SHARDS * max(1, -(-files // DEFAULT_SHARDS))


def write_dataset(
    vectors: DataFrame,
    path: str,
    dim: int,
    shards: int | None = None,
    num_queries: int = DEFAULT_QUERIES,
    skip_complete: bool = True,
    layout: str = "plain",
    **manifest_fields,
) -> None:
    """``vectors`` is ``(id, embedding)`` with dense ids, best read from a table.

    One task writes one shard; without a number given, it follows from the size.
    The query file holds the first ``num_queries`` vectors. The manifest comes
    last, so a dataset that has one is whole; such a dataset is left alone. ``layout``
    is how the documents are published, see ``vecfile``.
    """
    if skip_complete and is_complete(path):
        return
    total = vectors.count()
    shards = fitting_shards(total, dim) if shards is None else shards
    docs = assign_even(vectors.select("id", "embedding"), shards, total=total)
    remove_manifest(path)  # from here to the last step the dataset is not whole
    write_vec(docs, path, dim, shards, layout=layout)
    queries = query_set(docs, num_queries).select(
        F.col("qid").alias("id"), F.lit(0).alias("shard"), "embedding"
    )
    write_queries(queries, path, dim)
    manifest = build_manifest(
        shard_sizes(docs, shards),
        dim=dim,
        num_query_vectors=num_queries,
        location=path,
        **manifest_fields,
    )
    write_manifest(manifest, path)


def write_queries(queries: DataFrame, path: str, dim: int) -> None:
    """Write ``queries.vec`` next to the documents."""
    write_vec(queries, path, dim, shards=1, mode="append", file_name="queries.vec")


def queries_path(path: str) -> str:
    return posixpath.join(path, "queries.vec")


def read_queries(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """``(qid, embedding)`` of the query file of a dataset."""
    stored = read_vec(spark, queries_path(path), dim)
    return stored.select(F.col("id").alias("qid"), "embedding")


def evaluate_dataset(
    spark: SparkSession, path: str, shards: int, ks: tuple[int, ...] = DEFAULT_KS, rule=None, **options
) -> Evaluation:
    """Evaluate a stored dataset by its own queries: documents, queries and manifest to report."""
    docs = build_shards(spark, path, shards)
    row = read_manifest(spark, path).select("dim", "num_docs").first()
    asked = load_queries(read_queries(spark, path, row["dim"]), row["dim"])
    return evaluate(docs, asked, ks, shards, rule, total=row["num_docs"], **options)


def build_shards(spark: SparkSession, path: str, shards: int) -> DataFrame:
    """``(id, shard, embedding)`` of a dataset, cut for searching.

    A dataset of several files has neighbouring files joined, so ``shards`` must
    divide their number; a single file is split evenly. The row count must be
    the manifest's. Store the result with ``partitionBy("shard")``.
    """
    validate_dataset(spark, path)
    row = read_manifest(spark, path).select("dim", "num_docs", "num_shards").first()
    docs = read_vec(spark, path, row["dim"])
    if (row["num_shards"] or 1) > 1:
        return regroup(docs, row["num_shards"], shards)
    return assign_even(docs, shards, total=row["num_docs"])


def dedup_dataset(spark: SparkSession, path: str, out: str) -> None:
    """Write the dataset without duplicate vectors to ``out``; the input stays as it is.

    First copies keep their order, are numbered anew and split into as many
    shards as before. Queries are again the first vectors, so that query numbers
    and document ids still agree.
    """
    row = read_manifest(spark, path).first().asDict()
    shards = row["num_shards"] or 1
    unique = scratch_path(spark, "unique")
    kept = dedup_vectors(read_vec(spark, path, row["dim"]).drop("shard"), shards)
    kept.select(F.col("new_id").alias("id"), "embedding").write.parquet(unique)
    fields = ("source", "source_path", "granularity", "model_name", "created_at", "dataset_name")
    write_dataset(
        spark.read.parquet(unique),
        out,
        row["dim"],
        shards,
        row["num_query_vectors"],
        **{f: row[f] for f in fields},
    )
