"""Dense positions and running totals without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quillvec.session import pin


def running_sums(df: DataFrame, order: list[str], sizes: dict[str, Column]) -> DataFrame:
    """``df`` plus, per entry of ``sizes``, its sum over all rows that come before.

    Rows are range-partitioned by ``order`` and pinned, so the partition number
    is stable data. Each range is then summed on its own, and one small row per
    range carries the totals of the ranges before it. Pass a frame of keys and
    sizes only; join wide columns back afterwards. ``order`` must be unique.
    """
    spark = df.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = {name: f"_own_{name}" for name in sizes}
    ranged = (
        df.withColumns({own[name]: size for name, size in sizes.items()})
        .repartitionByRange(ranges, *order)
        .withColumn("_range", F.spark_partition_id())
    )
    pinned = pin(ranged)

    def before(column: str, window: WindowSpec) -> Column:
        earlier = window.rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(column).over(earlier), F.lit(0))

    # One row per range: at most spark.sql.shuffle.partitions rows, so the
    # single-task window and the broadcast below are bounded by that setting.
    totals = pinned.groupBy("_range").agg(*(F.sum(c).alias(c) for c in own.values()))
    bases = totals.select(
        "_range", *(before(c, Window.orderBy("_range")).alias(f"{c}_base") for c in own.values())
    )
    inside = Window.partitionBy("_range").orderBy(*order)
    return (
        pinned.withColumns({f"{c}_in": before(c, inside) for c in own.values()})
        .join(F.broadcast(bases), "_range")
        .withColumns({n: F.col(f"{c}_base") + F.col(f"{c}_in") for n, c in own.items()})
        .drop("_range", *(c + s for c in own.values() for s in ("", "_base", "_in")))
    )


def running_offsets(df: DataFrame, order: list[str], size: Column, name: str) -> DataFrame:
    """``df`` plus the whole-numbered start position of each row."""
    return running_sums(df, order, {name: size.cast("long")})


def dense_ids(keys: DataFrame, order: list[str], name: str = "id") -> DataFrame:
    """Number the rows of ``keys`` 0..n-1 in ``order``."""
    return running_offsets(keys, order, F.lit(1), name)


def dense_chunk_ids(chunks: DataFrame, name: str = "chunk_id") -> DataFrame:
    """Number chunks keyed ``(doc_id, pos)`` by position in the whole corpus.

    Only one ``(doc_id, count)`` row per document takes part in the ranking;
    the chunk texts move once, in the join back on ``doc_id``.
    """
    per_doc = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"))
    offsets = running_offsets(per_doc, ["doc_id"], F.col("_n"), "_first").drop("_n")
    return (
        chunks.join(offsets, "doc_id")
        .withColumn(name, F.col("_first") + F.col("pos"))
        .drop("_first")
    )
