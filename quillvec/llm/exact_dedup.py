"""Exact duplicates through an extendible-hash index on shared files.

The index maps a 64-bit key of the normalised text to the row that stays. Its
directory starts with one slot; a bucket that holds more bytes than its capacity
splits on one more bit of the key, and the directory doubles when that bucket
was as deep as the directory. What the splits need is a histogram over key
prefixes, so the directory is built from counts before any text moves. A bucket
is then a key range with one owner task: it reads its range in key order, chains
texts whose keys collide, compares their bytes, and writes the entries to the
shared folder. Tasks combine equal texts before the shuffle, so a text that
fills a third of the table reaches its owner once per input batch.

Defined results: null text equals empty text; texts equal up to white space form
one group; of a group the longest original stays, then the smallest doc_id (null
last); repeated rows are members like any other; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillvec.llm.common import SPACE, partitions, whole
from quillvec.session import scratch_path

KEY_BITS = 64
#: Buckets per shuffle partition, about, and the least capacity in bytes.
BUCKETS_PER_PARTITION = 4
LEAST_CAPACITY = 1 << 18
#: Key bits by which full buckets may be deeper than the first histogram.
MORE_BITS = 6

ENTRY = "key long, norm binary, n_chars long, doc_id long, members long"
INDEX = "bucket int, key long, chain int, text_sha256 string, keep_id long, group_size long"


def normalised(text: str | Column = "text") -> Column:
    return F.translate(whole(text), SPACE, "")


def _prefix(key: str, bits: int) -> Column:
    return F.shiftrightunsigned(key, KEY_BITS - bits) if bits else F.lit(0).cast("long")


def _better(a: tuple, b: tuple) -> bool:
    """Whether row ``(n_chars, doc_id)`` a stays rather than b."""
    if a[0] != b[0]:
        return a[0] > b[0]
    return a[1] is not None and (b[1] is None or a[1] < b[1])


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal texts of a batch as one entry."""
    for batch in batches:
        found: dict[bytes, list] = {}
        columns = (batch.column(n).to_pylist() for n in ("key", "norm", "n_chars", "doc_id"))
        for key, norm, chars, doc in zip(*columns, strict=True):
            seen = found.get(norm)
            if seen is None:
                found[norm] = [key, (chars, doc), 1]
            else:
                seen[2] += 1
                if _better((chars, doc), seen[1]):
                    seen[1] = (chars, doc)
        rows = [(k, t, best[0], best[1], n) for t, (k, best, n) in found.items()]
        yield _batch(rows, ENTRY)


_TYPES = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.record_batch(
        [pa.array(c, _TYPES[t]) for c, (_, t) in zip(columns, fields, strict=True)],
        names=[n for n, _ in fields],
    )


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index entries of the buckets of a task; rows come in the order of bucket and key.

    Only the chain of the current key is held: as many texts as differ under one key.
    """
    here: tuple[int, int] | None = None
    chain: list[list] = []  # [bytes, (n_chars, doc_id), members]
    done: list[tuple] = []

    def close() -> None:
        for place, (norm, best, members) in enumerate(chain):
            digest = hashlib.sha256(norm).hexdigest()
            done.append((here[0], here[1], place, digest, best[1], members))

    for batch in batches:
        names = ("bucket", "key", "norm", "n_chars", "doc_id", "members")
        columns = (batch.column(n).to_pylist() for n in names)
        for bucket, key, norm, chars, doc, members in zip(*columns, strict=True):
            if here != (bucket, key):
                if here is not None:
                    close()
                here, chain = (bucket, key), []
            for link in chain:
                if link[0] == norm:
                    link[2] += members
                    if _better((chars, doc), link[1]):
                        link[1] = (chars, doc)
                    break
            else:
                chain.append([norm, (chars, doc), members])
        yield _batch(done, INDEX)
        done = []
    if here is not None:
        close()
    yield _batch(done, INDEX)


def directory(sizes: DataFrame, capacity: int, start_bits: int) -> tuple[int, list[tuple[int, int]]]:
    """Global depth and ``(slot, bucket)`` pairs, from rows ``(key, bytes)`` of distinct keys.

    A bucket is full if it is over the capacity without its largest key, as no
    split makes a key smaller: a bucket of one key is never full, nor is a long
    text among short ones. The histogram is counted ``start_bits`` deep and refined
    only below full buckets, ``MORE_BITS`` deeper at most, which bounds it and the
    directory by ``2 ** (start_bits + MORE_BITS)`` entries whatever the rows. Depth
    decides on balance alone: a bucket that is full down there has one owner too.
    """
    depth, deepest = start_bits, min(start_bits + MORE_BITS, KEY_BITS)

    def histogram(rows: DataFrame, bits: int) -> dict[tuple[int, int], tuple[int, int]]:
        counted = rows.groupBy(_prefix("key", bits).alias("p")).agg(
            F.sum("bytes").alias("b"), F.max("bytes").alias("m")
        )
        return {(bits, r["p"]): (r["b"], r["m"]) for r in counted.collect()}

    def full(inside: list[tuple[int, int]]) -> bool:
        return sum(b for b, _ in inside) - max((m for _, m in inside), default=0) > capacity

    weights = histogram(sizes, depth)
    while depth < deepest:
        over = [p for (d, p), weight in weights.items() if d == depth and full([weight])]
        if not over:
            break
        deeper = min(depth + 4, deepest)
        weights |= histogram(sizes.where(_prefix("key", depth).isin(over)), deeper)
        for p in over:
            del weights[(depth, p)]
        depth = deeper
    # Doubling: split a bucket only while it is full.
    buckets: list[tuple[int, int]] = []
    pending = [(0, 0, weights)]
    while pending:
        bits, prefix, inside = pending.pop()
        if not full(list(inside.values())) or all(d <= bits for d, _ in inside):
            buckets.append((bits, prefix))
            continue
        halves: tuple[dict, dict] = ({}, {})
        for (d, p), weight in inside.items():
            halves[(p >> (d - bits - 1)) & 1][(d, p)] = weight
        pending += [(bits + 1, prefix * 2 + side, halves[side]) for side in (0, 1)]
    deepest = max(bits for bits, _ in buckets)
    slots = []
    for number, (bits, prefix) in enumerate(sorted(buckets, key=lambda b: b[1] << (KEY_BITS - b[0]))):
        first = prefix << (deepest - bits)
        slots += [(first + k, number) for k in range(1 << (deepest - bits))]
    return deepest, slots


def build_index(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Writes the index of ``docs`` to ``path``, a shared folder, and returns its entries."""
    spark = docs.sparkSession
    keyed = docs.select(
        F.xxhash64(normalised(text)).alias("key"),
        normalised(text).cast("binary").alias("norm"),
        F.char_length(whole(text)).cast("long").alias("n_chars"),
        F.col(doc_id).cast("long").alias("doc_id"),
    )
    parts = partitions(docs)
    sizes = keyed.groupBy("key").agg((F.max(F.octet_length("norm")) + 64).alias("bytes"))
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    capacity = max(LEAST_CAPACITY, total // (BUCKETS_PER_PARTITION * parts))
    bits, slots = directory(sizes, capacity, max(6, (BUCKETS_PER_PARTITION * parts).bit_length()))
    # One row per slot: bounded by the number of partitions, not by the rows.
    lookup = F.broadcast(spark.createDataFrame(slots, "slot long, bucket int"))
    entries = keyed.mapInArrow(_combine, ENTRY).withColumn("slot", _prefix("key", bits))
    owned = (
        entries.join(lookup, "slot")
        .drop("slot")
        .repartition(parts, "bucket")
        .sortWithinPartitions("bucket", "key")
        .mapInArrow(_own, INDEX)
    )
    owned.write.parquet(path)
    return spark.read.schema(INDEX).parquet(path)


def exact_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    index = build_index(docs, scratch_path(docs.sparkSession, "hash-index"), text, doc_id)
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.sha2(normalised(text), 256).alias("text_sha256")
    )
    return rows.join(index.select("text_sha256", "keep_id", "group_size"), "text_sha256").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )
