"""Stored posting lists of a hash: which documents have a code, by table and code.

For a hash so selective that queries meet a small part of the documents, reading
the lists of the queries' codes is cheaper than hashing every document again. Lists
are rows ``(code, id)`` sorted in files by table and leading bits of the code, so a
search opens only the folders of its codes and, inside, the row groups that hold
them. A candidate document becomes one row with the queries that look at it, however
many tables bring them together, and is scored for those alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, LongType

from quillvec.operators.candidates import HyperplaneHash
from quillvec.operators.search import (
    ARMS,
    HELD_ROWS,
    Arm,
    DocumentBlock,
    QueryBlock,
    QuerySet,
    _Best,
    _matrix,
    _rows,
    arm_hits,
    best_k,
    top_k,
)

#: Folders per table: two to this power.
PART_BITS = 6
#: Pairs scored at a time, and so the hits that are new when lists are cut to K.
PAIRS = 1 << 19
POSTINGS = "table int, part int, code long, id long"


def _coded(vectors: DataFrame, rule: HyperplaneHash, key: str) -> DataFrame:
    """``(key, table, part, code)``: a row per vector and table."""

    @arrow_udf(ArrayType(LongType()))
    def codes(column: pa.Array) -> pa.Array:
        found = rule.codes(_matrix(column, rule.dim).astype(np.float64)).T
        offsets = np.arange(len(column) + 1, dtype=np.int32) * rule.tables
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.reshape(-1), pa.int64()))

    listed = vectors.select(key, F.posexplode(codes("embedding")).alias("table", "code"))
    return listed.withColumn("part", F.shiftright("code", max(0, rule.bits - PART_BITS)).cast("int"))


def write_postings(
    docs: DataFrame, rule: HyperplaneHash, path: str, files_per_part: int = 1, mode: str = "error"
) -> None:
    """Store the lists of ``docs (id, embedding)``; a part is spread over ``files_per_part`` tasks by id."""
    spread = F.pmod(F.xxhash64("id"), F.lit(files_per_part))
    (
        _coded(docs, rule, "id")
        .withColumn("_file", spread)
        .repartition("table", "part", "_file")
        .sortWithinPartitions("table", "part", "code", "id")
        .drop("_file")
        .write.mode(mode)
        .partitionBy("table", "part")
        .parquet(path)
    )


def listed_candidates(
    spark: SparkSession, path: str, queries: DataFrame, rule: HyperplaneHash
) -> DataFrame:
    """``(id, qids)``: documents that share a code with a query, and those queries."""
    asked = _coded(queries, rule, "qid")
    lists = asked.groupBy("table", "part", "code").agg(F.collect_list("qid").alias("qids"))
    # At most ``tables << PART_BITS`` rows say which folders are opened.
    wanted = asked.groupBy("table").agg(F.collect_set("part").alias("parts")).collect()
    visited = F.lit(False)
    for row in wanted:
        visited |= (F.col("table") == row["table"]) & F.col("part").isin(row["parts"])
    stored = spark.read.schema(POSTINGS).parquet(path).where(visited)
    return (
        stored.join(lists, ["table", "part", "code"])
        .groupBy("id")
        .agg(F.array_distinct(F.flatten(F.collect_list("qids"))).alias("qids"))
    )


def _of_pairs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in runs of documents that ``PAIRS`` queries look at, or a single document."""
    upto = np.cumsum(np.asarray(batch.column("qids").value_lengths()))
    at = 0
    while at < batch.num_rows:
        before = int(upto[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(upto, before + PAIRS, side="right")))
        yield batch.slice(at, end - at)
        at = end


def postings_top_k(
    docs: DataFrame,
    queries: QuerySet,
    k: int,
    rule: HyperplaneHash,
    path: str,
    metric: str = "dot",
) -> DataFrame:
    """``(qid, rank, id, score)`` as a search with ``rule`` finds them, from stored lists.

    A query set too large to broadcast is searched by the scan instead.
    """
    if queries.shared is None:
        return top_k(docs, queries, k, queries.dim, rule, metric=metric)
    spark, shared, dim = docs.sparkSession, queries.shared, queries.dim
    found = listed_candidates(spark, path, queries.frame, rule)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = QueryBlock(shared.value, dim, metric).of(Arm())
        order = np.argsort(block.ids)
        best = _Best(k, block.floors)
        for batch in (part for whole in batches for part in _of_pairs(whole)):
            some = DocumentBlock(
                np.asarray(batch.column("id")), _matrix(batch.column("embedding"), dim), block.cosine
            )
            lists = batch.column("qids")
            d = np.repeat(np.arange(len(some)), np.asarray(lists.value_lengths()))
            qids = np.asarray(lists.flatten())
            best.offer_pairs(block, some, order[np.searchsorted(block.ids, qids, sorter=order)], d)
            if best.rows > max(1 << 16, min(HELD_ROWS, 2 * k * len(block))):
                best.settle()
            if best.rows > HELD_ROWS:
                q, ids, scores = best.settle()
                yield _rows(0, 0, qid=block.ids[q], id=ids, score=scores)
                best = _Best(k, best.floors)
        q, ids, scores = best.settle()
        yield _rows(0, 0, qid=block.ids[q], id=ids, score=scores)

    pairs = docs.select("id", "embedding").join(found, "id")
    return best_k(arm_hits(pairs.mapInArrow(score, ARMS), 0).drop("shard"), k)
