"""Exact duplicate removal on vector content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillvec.functions.vector import fingerprint
from quillvec.operators.ids import dense_ids
from quillvec.operators.sharding import assign_even


def first_copies(df: DataFrame, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """The smallest id of every distinct vector, as a one-column frame.

    Grouping works on a 128-bit hash and combines on the map side, so a vector
    with very many copies costs one row per input partition, not one hot group.
    """
    return (
        df.groupBy(fingerprint(F.col(vector_col)).alias("_fp"))
        .agg(F.min(id_col).alias(id_col))
        .select(id_col)
    )


def dedup_vectors(
    df: DataFrame, shards: int, id_col: str = "id", vector_col: str = "embedding"
) -> DataFrame:
    """Keep first copies, renumber densely and split evenly again.

    Adds ``new_id`` and ``shard``. The ranking sees ids only; vectors are moved
    once, in the join on the (unique, hence evenly spread) id.
    """
    renumbered = dense_ids(first_copies(df, id_col, vector_col), [id_col], "new_id")
    kept = assign_even(renumbered, shards, "new_id")
    return df.join(kept, id_col)


def duplicate_counts(df: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """One row: ``total, duplicates, unique_vectors``. Nothing is rewritten."""
    per_vector = df.groupBy(fingerprint(F.col(vector_col)).alias("_fp")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    total: Column = F.coalesce(F.sum("_n"), F.lit(0))
    unique = F.count(F.lit(1))
    return per_vector.agg(
        total.cast("long").alias("total"),
        (total - unique).cast("long").alias("duplicates"),
        unique.cast("long").alias("unique_vectors"),
    )
