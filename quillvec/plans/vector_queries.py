"""Queries on vectors: functions, files, shards, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillvec.functions import vector as V
from quillvec.operators.candidates import HyperplaneHash
from quillvec.operators.dedup import dedup_vectors, duplicate_counts
from quillvec.operators.embedding import mean_pool
from quillvec.operators.sharding import (
    assign_ceil,
    assign_even,
    regroup,
    regroup_ladder,
    shard_sizes,
)
from quillvec.plans.tables import (
    CREATED_AT,
    DIM,
    KS,
    LSH_BITS,
    LSH_TABLES,
    SHARDS,
    VEC_SHARDS,
    longs,
    rounded,
    sharded,
    vectors,
)
from quillvec.session import scratch_path
from quillvec.sources.dataset import build_shards, dedup_dataset, evaluate_dataset, write_dataset
from quillvec.sources.manifest import build_manifest, resolve_dataset, validate_dataset
from quillvec.sources.vecfile import read_vec, write_vec
from quillvec.streaming.vectors import append_vectors, finalize

MANIFEST_FIELDS = {
    "source": "text_dir",
    "source_path": "corpora/plain texts",
    "granularity": "sentence",
    "model_name": "given vectors",
    "created_at": CREATED_AT,
}
FIT_DIMS = (48, 96)
LADDER = (8, 4, 2, 1)


def values(df: DataFrame, *keys: str) -> DataFrame:
    """One row per vector element, to the last bit."""
    flat = df.select(*keys, F.posexplode("embedding").alias("d", "value"))
    return longs(flat.withColumn("value", F.col("value").cast("double") + 0.0), "d")


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector next to the one with the following id."""
    a = vectors(spark, sf_dir).select("id", F.col("embedding").alias("a"))
    b = vectors(spark, sf_dir).select((F.col("id") - 1).alias("id"), F.col("embedding").alias("b"))
    return a.join(b, "id")


def vec_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _neighbours(spark, sf_dir).select("id", V.dot(F.col("a"), F.col("b")).alias("score"))
    return pairs.withColumn("score", rounded("score"))


def vec_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    doubled = F.transform("b", lambda x: x * F.lit(2.0).cast("float"))
    pairs = _neighbours(spark, sf_dir).select("id", V.cosine(F.col("a"), doubled).alias("score"))
    return pairs.withColumn("score", rounded("score"))


def vec_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    tripled = F.transform("embedding", lambda x: x * F.lit(3.0).cast("float"))
    unit = vectors(spark, sf_dir).select("id", V.normalize(tripled).alias("embedding"))
    return values(unit, "id").withColumn("value", rounded("value"))


def vec_fit_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = F.array(*(
        F.struct(F.lit(d).cast("long").alias("dim"), V.fit_dim(F.col("embedding"), d).alias("embedding"))
        for d in FIT_DIMS
    ))
    return values(vectors(spark, sf_dir).select("id", F.inline(both)), "id", "dim")


def vec_parse_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrapped = F.to_json(F.struct("embedding"))
    bare = F.to_json(F.col("embedding"))
    reply = F.when(F.col("id") % 2 == 0, wrapped).otherwise(bare)
    parsed = vectors(spark, sf_dir).select("id", V.parse_embedding(reply).alias("embedding"))
    return values(parsed, "id")


def dim_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = vectors(spark, sf_dir).select(V.require_dim(F.col("embedding"), DIM).alias("v"))
    return checked.groupBy(F.size("v").cast("long").alias("dim")).agg(
        F.count(F.lit(1)).alias("vectors")
    )


def mean_pool_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    pooled = mean_pool(vectors(spark, sf_dir), "label")
    return longs(pooled.withColumn("value", rounded("value")), "label", "pos")


def vec_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per vector of the doubled table: how many rows carry the same content."""
    prints = _with_copies(spark, sf_dir).select("id", V.fingerprint(F.col("embedding")).alias("fp"))
    copies = prints.groupBy("fp").agg(F.count(F.lit(1)).alias("copies"))
    return prints.join(copies, "fp").select("id", "copies")


def _with_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors, then a copy of those whose label is even, under new ids."""
    own = vectors(spark, sf_dir).select("id", "embedding", "label")
    first_copy_id = own.agg(F.max("id") + 1).scalar()
    copies = own.where(F.col("label") % 2 == 0).withColumn("id", F.col("id") + first_copy_id)
    return own.unionByName(copies).drop("label")


def vec_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_vectors(_with_copies(spark, sf_dir), SHARDS)
    return longs(kept.select("id", "new_id", "shard"), "shard")


def dedup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_counts(_with_copies(spark, sf_dir))


def shard_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(sharded(spark, sf_dir).select("id", "shard"), "shard")


def shard_assign_ceil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(assign_ceil(vectors(spark, sf_dir), SHARDS).select("id", "shard"), "shard")


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(shard_sizes(sharded(spark, sf_dir), SHARDS), "shard")


def shard_regroup(spark: SparkSession, sf_dir: str) -> DataFrame:
    fine = sharded(spark, sf_dir, VEC_SHARDS)
    return longs(regroup(fine, VEC_SHARDS, SHARDS).select("id", "shard"), "shard")


def shard_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    fine = sharded(spark, sf_dir, VEC_SHARDS)
    return longs(regroup_ladder(fine, VEC_SHARDS, list(LADDER)), "target", "shard", "size", "first_id")


def vec_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "written")
    write_vec(sharded(spark, sf_dir), path, DIM, shards=SHARDS)
    return values(read_vec(spark, path, DIM), "id")


def vec_dataset_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "shards")
    write_vec(sharded(spark, sf_dir, VEC_SHARDS), path, DIM, shards=VEC_SHARDS)
    scanned = longs(read_vec(spark, path, DIM), "shard")
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x)
    return scanned.select("id", "shard", total.alias("total")).withColumn("total", rounded("total"))


def _totals(df: DataFrame) -> DataFrame:
    """``(id, shard, total)`` of stored vectors."""
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x)
    kept = longs(df, "shard").select("id", "shard", total.alias("total"))
    return kept.withColumn("total", rounded("total"))


def vec_pushdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of ids of two shards; other byte ranges are not opened."""
    path = scratch_path(spark, "ranges")
    write_vec(sharded(spark, sf_dir, VEC_SHARDS), path, DIM, shards=VEC_SHARDS)
    return _totals(read_vec(spark, path, DIM).where("id >= 40 and id < 400 and shard in (3, 9)"))


def vec_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and shards from the sizes of the files alone."""
    path = scratch_path(spark, "places")
    write_vec(sharded(spark, sf_dir, VEC_SHARDS), path, DIM, shards=VEC_SHARDS)
    return longs(read_vec(spark, path, DIM, vectors="false"), "shard")


def vec_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file that ends in the middle of a vector, read without that vector.

    It is made by reading vectors of 63 values from a file of vectors of 64.
    """
    path = scratch_path(spark, "partial")
    write_vec(assign_even(vectors(spark, sf_dir), 1), path, DIM, shards=1)
    return values(read_vec(spark, path, DIM - 1, on_partial="ignore"), "id")


def vec_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dataset published by its list, written over by other vectors, then by the given ones again."""
    path = scratch_path(spark, "published")
    docs = sharded(spark, sf_dir, VEC_SHARDS)
    write_vec(docs.where("id < 100"), path, DIM, VEC_SHARDS, layout="listed")
    write_vec(docs, path, DIM, VEC_SHARDS, layout="listed")
    return _totals(read_vec(spark, path, DIM))


def skip_finished(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A finished dataset is left alone by a second write of other vectors."""
    path, given = scratch_path(spark, "finished"), vectors(spark, sf_dir)
    write_dataset(given, path, DIM, shards=VEC_SHARDS, **MANIFEST_FIELDS)
    write_dataset(given.where("id < 10"), path, DIM, shards=VEC_SHARDS, **MANIFEST_FIELDS)
    return _totals(read_vec(spark, path, DIM))


def stream_vec_equals_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors appended by a stream in several epochs, then cut into shards."""
    inbox, appended, out = (scratch_path(spark, n) for n in ("inbox", "appended", "finalized"))
    vectors(spark, sf_dir).select("id", "embedding").repartition(6).write.parquet(inbox)
    arriving = spark.readStream.schema("id long, embedding array<float>").option("maxFilesPerTrigger", 2)
    state = scratch_path(spark, "appended-state")
    append_vectors(arriving.parquet(inbox), appended, DIM, state).awaitTermination()
    finalize(spark, appended, out, DIM, VEC_SHARDS)
    return _totals(read_vec(spark, out, DIM))


def _flat_manifest(df: DataFrame) -> DataFrame:
    listed = ("shard_sizes", "shard_doc_offsets")
    return df.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in listed})


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = sharded(spark, sf_dir)
    row = build_manifest(shard_sizes(docs, SHARDS), dim=DIM, num_query_vectors=5000, **MANIFEST_FIELDS)
    # Checks the count as an index build does: rows read must be rows declared.
    checked = row.withColumn("rows_match", F.col("num_docs") == docs.count())
    return _flat_manifest(checked)


def manifest_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = scratch_path(spark, "datasets")
    path = f"{base}/embeddings/given"
    fields = {**MANIFEST_FIELDS, "dataset_name": "given"}
    write_dataset(vectors(spark, sf_dir), path, DIM, shards=SHARDS, **fields)
    validate_dataset(spark, path)
    found = _flat_manifest(resolve_dataset(spark, "given", base)[1])
    # The manifest names its files by the scratch folder, which differs from run to run.
    named = F.replace("output_queries_vec", F.lit(f"{base}/"), F.lit("data/"))
    return found.withColumn("output_queries_vec", named)


def dataset_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored dataset in which every third vector has a copy, without the copies."""
    given, path = vectors(spark, sf_dir), scratch_path(spark, "copied")
    count = given.count()
    copies = given.where("id % 3 = 0").withColumn("id", (F.col("id") / 3 + count).cast("long"))
    both = given.select("id", "embedding").union(copies.select("id", "embedding"))
    write_dataset(both, path, DIM, shards=VEC_SHARDS, **MANIFEST_FIELDS)
    out = scratch_path(spark, "unique-set")
    dedup_dataset(spark, path, out)
    kept = longs(build_shards(spark, out, SHARDS), "shard")
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x)
    return kept.select("id", "shard", total.alias("total")).withColumn("total", rounded("total"))


def dataset_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored dataset evaluated by its own query file, regrouped into fewer shards."""
    path = scratch_path(spark, "evaluated")
    write_dataset(vectors(spark, sf_dir), path, DIM, shards=VEC_SHARDS, **MANIFEST_FIELDS)
    rule = HyperplaneHash(LSH_TABLES, LSH_BITS, DIM)
    return evaluate_dataset(spark, path, SHARDS, KS, rule).report


QUERIES = {
    "vec_dot": vec_dot,
    "vec_cosine": vec_cosine,
    "vec_normalize": vec_normalize,
    "vec_fit_dim": vec_fit_dim,
    "vec_parse_json": vec_parse_json,
    "vec_fingerprint": vec_fingerprint,
    "dim_profile": dim_profile,
    "mean_pool": mean_pool_labels,
    "vec_dedup": vec_dedup,
    "dedup_counts": dedup_counts,
    "shard_assign": shard_assign,
    "shard_assign_ceil": shard_assign_ceil,
    "shard_sizes": sizes,
    "shard_regroup": shard_regroup,
    "shard_ladder": shard_ladder,
    "vec_roundtrip": vec_roundtrip,
    "vec_dataset_scan": vec_dataset_scan,
    "vec_pushdown": vec_pushdown,
    "vec_places": vec_places,
    "vec_lenient": vec_lenient,
    "vec_publish": vec_publish,
    "skip_finished": skip_finished,
    "stream_vec_equals_batch": stream_vec_equals_batch,
    "manifest": manifest,
    "manifest_read": manifest_read,
    "dataset_dedup": dataset_dedup,
    "dataset_report": dataset_report,
}
