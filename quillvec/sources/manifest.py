"""Dataset manifests (``meta.json``): content, naming, writing, resolving, checking."""

from __future__ import annotations

import json
import posixpath
import re

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillvec.sources.paths import filesystem, qualified
from quillvec.sources.vecfile import FLOAT, dataset_files

# Manifest fields, in file order.
MANIFEST_SCHEMA = (
    "source string, source_path string, granularity string, model_name string, "
    "dim long, num_docs long, num_query_vectors long, output_docs_vec string, "
    "output_queries_vec string, created_at string, num_shards long, "
    "shard_sizes array<long>, shard_doc_offsets array<long>, dataset_name string"
)
MANIFEST_FILE = "meta.json"
SHARD_PATTERN_NAME = "docs-shard-{i}.vec"
DEFAULT_OUTPUT_DIR = "data/embeddings"


def source_id(source: Column, path: Column) -> Column:
    """File stem for file sources, last directory name for text directories."""
    last = F.regexp_extract(path, r"([^/]+)/*$", 1)
    stem = F.regexp_replace(last, r"(?<=.)\.[^.]*$", "")
    return F.when(source == "text_dir", last).otherwise(stem)


def output_stem(source: Column, path: Column, granularity: Column, model: Column, dim: Column):
    """``{source id}-{granularity}-{model}-{dim}d`` with spaces turned into dashes."""
    joined = F.concat_ws("-", source_id(source, path), granularity, model, F.concat(dim, F.lit("d")))
    return F.replace(joined, F.lit(" "), F.lit("-"))


def build_manifest(
    sizes: DataFrame,
    *,
    source: str,
    source_path: str,
    granularity: str,
    model_name: str,
    dim: int,
    num_query_vectors: int,
    created_at: str,
    dataset_name: str | None = None,
    output_dir: str = DEFAULT_OUTPUT_DIR,
    location: str | None = None,
) -> DataFrame:
    """One manifest row from ``(shard, size, first_id)``, which has a row per shard.

    ``location`` is the folder the files are in; without it they are named as they
    would be below ``output_dir``.
    """
    per_shard = F.array_sort(F.collect_list(F.struct("shard", "size", "first_id")))
    row = sizes.agg(
        F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("num_docs"),
        F.count(F.lit(1)).cast("long").alias("num_shards"),
        per_shard.alias("s"),
    )
    text = {
        "source": source,
        "source_path": source_path,
        "granularity": "message" if source == "messages" else granularity,
        "model_name": model_name,
    }
    row = row.withColumns({name: F.lit(value) for name, value in text.items()})
    row = row.withColumn("dim", F.lit(dim).cast("long"))
    if location is not None:
        base = F.lit(location.rstrip("/") + "/")
    elif dataset_name:
        base = F.lit(f"{output_dir}/{dataset_name.strip()}/")
    else:
        stem = output_stem(*(F.col(c) for c in ("source", "source_path", "granularity",
                                                 "model_name", "dim")))
        base = F.concat(F.lit(f"{output_dir}/"), stem, F.lit("-"))
    sharded = F.col("num_shards") > 1
    return row.select(
        "source",
        "source_path",
        "granularity",
        "model_name",
        "dim",
        "num_docs",
        F.least(F.lit(num_query_vectors).cast("long"), F.col("num_docs")).alias("num_query_vectors"),
        F.when(sharded, F.lit(SHARD_PATTERN_NAME))
        .otherwise(F.concat(base, F.lit("docs.vec")))
        .alias("output_docs_vec"),
        F.concat(base, F.lit("queries.vec")).alias("output_queries_vec"),
        F.lit(created_at).alias("created_at"),
        F.when(sharded, F.col("num_shards")).alias("num_shards"),
        F.when(sharded, F.col("s.size")).alias("shard_sizes"),
        F.when(sharded, F.col("s.first_id")).alias("shard_doc_offsets"),
        F.lit(dataset_name.strip() if dataset_name else None).cast("string").alias("dataset_name"),
    )


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return filesystem(qualified(SparkSession.active(), path))


def write_manifest(manifest: DataFrame, dataset_dir: str) -> None:
    """Write the one manifest row as ``meta.json``; absent optional fields are left out."""
    (line,) = manifest.toJSON().collect()
    fs, where = _opened(dataset_dir)
    fs.create_dir(where, recursive=True)
    with fs.open_output_stream(posixpath.join(where, MANIFEST_FILE)) as sink:
        sink.write(line.encode("utf-8"))


def remove_manifest(dataset_dir: str) -> None:
    """Delete ``meta.json`` if there is one, so that the dataset no longer counts as complete."""
    path = posixpath.join(dataset_dir, MANIFEST_FILE)
    if _is(path, pafs.FileType.File):
        fs, where = _opened(path)
        fs.delete_file(where)


def read_manifest(spark: SparkSession, dataset_dir: str) -> DataFrame:
    path = posixpath.join(dataset_dir, MANIFEST_FILE)
    return spark.read.schema(MANIFEST_SCHEMA).json(path, multiLine=True)


def _is(path: str, kind: pafs.FileType) -> bool:
    fs, where = _opened(path)
    return fs.get_file_info(where).type == kind


def is_complete(dataset_dir: str) -> bool:
    """Queries and manifest are there, and the document files are as long as it says."""
    if not all(
        _is(posixpath.join(dataset_dir, n), pafs.FileType.File) for n in ("queries.vec", MANIFEST_FILE)
    ):
        return False
    fs, where = _opened(dataset_dir)
    with fs.open_input_stream(posixpath.join(where, MANIFEST_FILE)) as source:
        manifest = json.loads(source.read())
    try:
        files = dataset_files(qualified(SparkSession.active(), dataset_dir))
    except FileNotFoundError:
        return False
    record = manifest["dim"] * FLOAT.itemsize
    counted = [manifest["num_docs"]] if manifest.get("shard_sizes") is None else manifest["shard_sizes"]
    return [size for _, _, size in files] == [rows * record for rows in counted]


def resolve_dataset(spark: SparkSession, ref: str, base: str | None = None) -> tuple[str, DataFrame]:
    """Directory and manifest of a dataset given by absolute path or by name below ``base``."""
    absolute = ref.startswith("/") or re.match(r"[a-z0-9]+:/", ref)
    tried = [ref] if absolute else []
    if base is not None:
        tried += [posixpath.join(base, "embeddings", ref), posixpath.join(base, ref)]
    found = next((d for d in tried if _is(d, pafs.FileType.Directory)), None)
    if found is None:
        raise ValueError(f"dataset not found: {ref}")
    if not _is(posixpath.join(found, MANIFEST_FILE), pafs.FileType.File):
        raise ValueError(f"{found} has no manifest ({MANIFEST_FILE})")
    manifest = read_manifest(spark, found)
    shards = manifest.select("num_shards").first()[0] or 1
    try:
        held = {shard for _, shard, _ in dataset_files(qualified(spark, found))}
    except FileNotFoundError:
        held = set()
    if shards > 1 and max(held, default=0) == 0 or 0 not in held:
        raise ValueError(f"{found} holds no vectors of the first shard")
    return found, manifest


def validate_dataset(spark: SparkSession, dataset_dir: str) -> None:
    """File sizes must agree with the manifest's row count, sharded or not."""
    row = read_manifest(spark, dataset_dir).select("dim", "num_docs").first()
    record = row["dim"] * 4
    held = 0
    for file, _, size in dataset_files(qualified(spark, dataset_dir)):
        if size % record:
            raise ValueError(f"{file}: {size} bytes is not a multiple of {record}")
        held += size // record
    if held != row["num_docs"]:
        raise ValueError(f"{dataset_dir} holds {held} vectors, manifest says {row['num_docs']}")
