"""Vector columns (``array<float>``): products, norms, shaping, parsing, fingerprints."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import BinaryType


def dot(a: Column, b: Column) -> Column:
    """Inner product, accumulated in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(v: Column) -> Column:
    squares = F.aggregate(
        v, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")
    )
    return F.sqrt(squares)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null when either vector has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def normalize(v: Column) -> Column:
    """Scale to unit length; a zero vector stays zero."""
    return F.element_at(
        F.transform(
            F.array(norm(v)),
            lambda n: F.transform(
                v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(0.0).cast("float")
            ),
        ),
        1,
    )


def fit_dim(v: Column, dim: int) -> Column:
    """Cut to ``dim`` values, or fill up with zeros."""
    zeros = F.array_repeat(F.lit(0.0).cast("float"), dim)
    return F.slice(F.concat(v, zeros), 1, dim)


def parse_embedding(json: Column) -> Column:
    """Read ``{"embedding": [...]}`` or a bare ``[...]``; null if neither."""
    return F.coalesce(
        F.from_json(json, "embedding array<float>")["embedding"],
        F.from_json(json, "array<float>"),
    )


def require_dim(v: Column, dim: int) -> Column:
    """``v`` itself; the job fails on a vector of another length."""
    return F.when(F.size(v) == dim, v).otherwise(
        F.raise_error(F.concat(F.lit(f"vector length is not {dim}: "), F.size(v).cast("string")))
        .cast("array<float>")
    )


@arrow_udf(BinaryType())
def _md5_of_bytes(vectors: pa.Array) -> pa.Array:
    raw = memoryview(vectors.flatten().to_numpy(zero_copy_only=False).view("uint8"))
    ends = (vectors.offsets.to_numpy() - vectors.offsets[0].as_py()) * 4
    digests = [hashlib.md5(raw[a:b]).digest() for a, b in zip(ends[:-1], ends[1:])]
    return pa.array(digests, pa.binary())


def fingerprint(v: Column) -> Column:
    """MD5 of the little-endian float32 bytes, so 0.0 and -0.0 differ.

    Spark has no function from floats to bytes, and going through text inside
    the JVM takes more than twice as long at 1024 dimensions. Other numbers are
    read as float32 first; a null vector has a null fingerprint.
    """
    return F.when(v.isNotNull(), _md5_of_bytes(v.cast("array<float>")))
