"""Contiguous shards over dense ids: assignment, sizes, regrouping.

Shard numbers are arithmetic on the id, so none of this needs a sort or a
shuffle of the vectors; only the size report aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def even_shard(position: Column, total: int, shards: int) -> Column:
    """Shard of a position when ``total`` rows are cut as evenly as possible.

    The first ``total % shards`` shards hold one row more than the others.
    """
    base, longer = divmod(total, shards)
    in_longer = longer * (base + 1)
    return F.when(position < in_longer, F.floor(position / (base + 1))).otherwise(
        longer + F.floor((position - in_longer) / max(base, 1))
    ).cast("int")


def assign_even(
    df: DataFrame, shards: int, id_col: str = "id", total: int | None = None
) -> DataFrame:
    """Add ``shard`` for an even contiguous split; ids must be dense from 0.

    Rows are counted unless ``total`` is given; on a stored table that reads
    file footers only. The shard itself is arithmetic on the id.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    n = df.count() if total is None else total
    return df.withColumn("shard", even_shard(F.col(id_col), n, shards))


def assign_ceil(
    df: DataFrame, shards: int, id_col: str = "id", total: int | None = None
) -> DataFrame:
    """Add ``shard`` for slices of ``ceil(n / shards)``; the last may be short or absent."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    n = df.count() if total is None else total
    per_shard = max(1, -(-n // shards))
    return df.withColumn("shard", F.floor(F.col(id_col) / per_shard).cast("int"))


def even_starts(total: int, shards: int) -> list[int]:
    """First positions of the shards of an even cut."""
    base, longer = divmod(total, shards)
    return [s * base + min(s, longer) for s in range(shards)]


def assign_refined(df: DataFrame, counts: tuple[int, ...], total: int, id_col: str = "id"):
    """``df`` with ``shard`` cut wherever one of several even splits cuts, and the way back.

    Returns the frame and, per count, the even shard that each of its pieces lies in.
    There are at most ``sum(counts)`` pieces.
    """
    starts = sorted({s for n in counts for s in even_starts(total, n) if s < total} | {0})
    cuts = F.array(*(F.lit(s).cast("long") for s in starts))
    piece = F.size(F.filter(cuts, lambda c: c <= F.col(id_col))) - 1
    owner = {}
    for n in counts:
        own = even_starts(total, n)
        # Of shards that begin at one place only the last has rows.
        owner[n] = [max(i for i, first in enumerate(own) if first <= s) for s in starts]
    return df.withColumn("shard", piece.cast("int")), owner


def regroup(df: DataFrame, from_shards: int, to_shards: int) -> DataFrame:
    """Join neighbouring shards so that ``to_shards`` remain; order is kept."""
    if to_shards < 1 or to_shards > from_shards or from_shards % to_shards:
        raise ValueError(f"{to_shards} must divide {from_shards}")
    per_group = from_shards // to_shards
    return df.withColumn("shard", F.floor(F.col("shard") / per_group).cast("int"))


def shard_sizes(df: DataFrame, shards: int) -> DataFrame:
    """``(shard, size, first_id)`` for every shard, empty ones included.

    Aggregates to ``shards`` rows first; the running sum runs over those.
    """
    spark = df.sparkSession
    counts = df.groupBy("shard").agg(F.count(F.lit(1)).alias("size"))
    every = spark.range(shards).select(F.col("id").cast("int").alias("shard"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return (
        every.join(counts, "shard", "left")
        .withColumn("size", F.coalesce("size", F.lit(0)).cast("long"))
        .withColumn("first_id", F.coalesce(F.sum("size").over(before), F.lit(0)).cast("long"))
    )


def regroup_ladder(df: DataFrame, from_shards: int, targets: list[int]) -> DataFrame:
    """Sizes after regrouping to each of ``targets``: ``(target, shard, size, first_id)``.

    The data are counted once at the finest level; every rung is an aggregate
    of those few rows.
    """
    for target in targets:
        regroup(df, from_shards, target)  # same checks
    return (
        shard_sizes(df, from_shards)
        .withColumn("target", F.explode(F.array(*(F.lit(t) for t in targets))))
        .withColumn("shard", F.floor(F.col("shard") * F.col("target") / from_shards).cast("int"))
        .groupBy("target", "shard")
        .agg(F.sum("size").alias("size"), F.min("first_id").alias("first_id"))
    )
