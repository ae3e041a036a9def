"""The given tables in the roles the engine knows, and the parameters of all queries."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillvec.operators.chunking import spread
from quillvec.operators.search import DEFAULT_QUERIES, query_set
from quillvec.operators.sharding import assign_even

DIM = 64
SHARDS = 8
VEC_SHARDS = 16
KS = (10, 100)
MAX_K = max(KS)
LSH_TABLES, LSH_BITS = 8, 6
PROBES = 3
CREATED_AT = "2026-01-01T00:00:00Z"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")


def sharded(spark: SparkSession, sf_dir: str, shards: int = SHARDS) -> DataFrame:
    return assign_even(vectors(spark, sf_dir), shards)


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_set(vectors(spark, sf_dir), DEFAULT_QUERIES)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return spread(docs, "doc_id")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def rounded(column: str, digits: int = 6):
    """Rounded for comparison; adding zero turns -0.0 into 0.0."""
    return F.round(F.col(column).cast("double"), digits) + F.lit(0.0)


def longs(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})
