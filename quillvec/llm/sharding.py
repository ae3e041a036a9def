"""Shards by proportional stratified interleaving.

Rows of one source are put in a seeded random order and get the fractional rank
``(rank + 1/2) / rows of the source``. Sorted by that fraction, the sources are
interleaved in proportion, so every stretch of the order has nearly the mixture
of the whole; it is cut into shards whose row counts differ by one at most.

Both rankings run over thin rows, range by range (no window sees the table). A
source of any size spreads over many ranges.

Defined results: a null source is a source of its own; a null text has size 1;
repeated rows each get a slot; an empty table gives an empty result. Columns of
the input that are not among the results are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillvec.llm.common import whole
from quillvec.operators.ids import dense_ids
from quillvec.session import pin

SEED = 17
SHARDS = 8


def stratified_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """One row per document: ``doc_id, source, size, text_crc32, shard, slot``."""
    thin = docs.select(
        "doc_id",
        "source",
        (F.octet_length(whole()) + 1).cast("long").alias("size"),
        F.crc32(whole().cast("binary")).alias("text_crc32"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string"))).alias("_key"),
    )
    payload = ["doc_id", "size", "text_crc32"]
    ranked = dense_ids(thin, ["source", "_key", *payload], "_rank")
    ranked = pin(ranked)
    # The rows of a source are neighbours, so its first rank and its count place each of them.
    sources = ranked.groupBy(F.col("source").alias("_source")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_rank").alias("_first")
    )
    fractions = (
        ranked.join(sources, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn(
            "_fraction",
            (2 * (F.col("_rank") - F.col("_first")) + 1).cast("double")
            / (2 * F.col("_n")).cast("double"),
        )
        .select("source", *payload, "_key", "_fraction")
    )
    placed = dense_ids(fractions, ["_fraction", "source", "_key", *payload], "_place")
    total = max(ranked.count(), 1)
    # Whole numbers only: shard s starts at ceil(s * total / shards).
    return (
        placed.withColumn("shard", F.expr(f"(_place * {shards}) div {total}").cast("int"))
        .withColumn(
            "slot",
            F.col("_place")
            - F.expr(f"(cast(shard as long) * {total} + {shards - 1}) div {shards}"),
        )
        .select("doc_id", "source", "size", "text_crc32", "shard", "slot")
    )
