"""A stream of vectors into a dataset: append by epoch, running total, then cut into shards.

Each task of an epoch writes one file of vectors, with the ids beside it. The epoch
is published by one entry in the folder's list, under the epoch's own number: the
files of the epoch, its rows and the rows so far. An epoch that comes again finds
its entry and adds nothing, whatever the tasks have written meanwhile.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery

from quillvec.operators.ids import dense_ids
from quillvec.operators.sharding import assign_even
from quillvec.session import pin
from quillvec.sources.listing import entry_at, listed, publish
from quillvec.sources.paths import filesystem, qualified
from quillvec.sources.vecfile import BATCH_ROWS, FLOAT, matrix, register, write_vec

PARTS = "parts"
IDS = np.dtype("<i8")


@dataclass
class PartWritten(WriterCommitMessage):
    name: str
    rows: int


class VecStreamWriter(DataSourceStreamArrowWriter):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.dim = int(options["dim"])

    def write(self, batches: Iterator[pa.RecordBatch]) -> PartWritten | None:
        fs, where = filesystem(self.path)
        name, rows, sinks = posixpath.join(PARTS, uuid.uuid4().hex), 0, []
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                values = matrix(batch.column("embedding"), self.dim)
                if not sinks:
                    fs.create_dir(posixpath.join(where, PARTS), recursive=True)
                    sinks = [fs.open_output_stream(posixpath.join(where, name + end)) for end in (".vec", ".ids")]
                sinks[0].write(values.astype(FLOAT).tobytes())
                sinks[1].write(np.asarray(batch.column("id")).astype(IDS).tobytes())
                rows += batch.num_rows
            for sink in sinks:
                sink.close()
        except BaseException:
            for sink in sinks:
                if not sink.closed:
                    sink.close()
            self._drop([PartWritten(name, rows)])
            raise
        return PartWritten(name, rows) if rows else None

    def _drop(self, parts: list[PartWritten | None]) -> None:
        fs, where = filesystem(self.path)
        for part in parts:
            for end in (".vec", ".ids") if part else ():
                path = posixpath.join(where, part.name + end)
                if fs.get_file_info(path).type == pafs.FileType.File:
                    fs.delete_file(path)

    def commit(self, messages: list[PartWritten | None], batchId: int) -> None:  # noqa: N803
        fs, where = filesystem(self.path)
        if entry_at(fs, where, batchId) is not None:
            self._drop(messages)
            return
        before = listed(fs, where)
        parts = [[m.name, m.rows] for m in messages if m and m.rows]
        rows = sum(n for _, n in parts)
        total = rows + (before["total"] if before else 0)
        publish(fs, where, {"epoch": batchId, "parts": parts, "rows": rows, "total": total}, batchId)

    def abort(self, messages: list[PartWritten | None], batchId: int) -> None:  # noqa: N803
        self._drop(messages)


class VecStreamSink(VecStreamWriter):
    """The writer as Spark runs it: a task without rows has a message too.

    Such tasks read byte ranges in which no row group begins, so large files have them.
    """

    def write(self, batches: Iterator[pa.RecordBatch]) -> PartWritten:
        return super().write(batches) or PartWritten(posixpath.join(PARTS, uuid.uuid4().hex), 0)


def append_vectors(
    vectors: DataFrame, path: str, dim: int, checkpoint: str, **trigger
) -> StreamingQuery:
    """Start appending a stream of ``(id, embedding)`` to the folder ``path``.

    By default it takes what is there and stops; run it again for more.
    """
    spark = vectors.sparkSession
    register(spark)
    return (
        vectors.select(F.col("id").cast("long").alias("id"), "embedding")
        .writeStream.format("vec")
        .option("path", qualified(spark, path))
        .option("dim", dim)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def epochs(spark: SparkSession, path: str) -> list[dict]:
    """The entries of all epochs: ``epoch, parts, rows, total``."""
    fs, where = filesystem(qualified(spark, path))
    last = listed(fs, where)
    if last is None:
        return []
    found = (entry_at(fs, where, n) for n in range(last["epoch"] + 1))
    return [entry for entry in found if entry is not None]


def appended_total(spark: SparkSession, path: str) -> int:
    """Vectors appended so far."""
    fs, where = filesystem(qualified(spark, path))
    last = listed(fs, where)
    return last["total"] if last else 0


def read_appended(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """``(id, embedding)`` of all published epochs, a task per part."""
    where = qualified(spark, path)
    parts = [tuple(p) for entry in epochs(spark, path) for p in entry["parts"]]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = filesystem(where)
        for batch in batches:
            for row in batch.to_pylist():
                name = posixpath.join(folder, row["name"])
                with fs.open_input_stream(name + ".ids") as ids, fs.open_input_stream(name + ".vec") as vecs:
                    for done in range(0, row["rows"], BATCH_ROWS):
                        want = min(BATCH_ROWS, row["rows"] - done)
                        key = np.frombuffer(ids.read(want * IDS.itemsize), IDS)
                        values = np.frombuffer(vecs.read(want * dim * FLOAT.itemsize), FLOAT)
                        if len(key) != want or len(values) != want * dim:
                            raise EOFError(f"{name} ended early")
                        offsets = np.arange(want + 1, dtype=np.int32) * dim
                        yield pa.record_batch(
                            {
                                "id": pa.array(key, pa.int64()),
                                "embedding": pa.ListArray.from_arrays(
                                    pa.array(offsets), pa.array(values, pa.float32())
                                ),
                            }
                        )

    named = spark.createDataFrame(parts, "name string, rows long")
    tasks = max(1, min(len(parts), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return named.repartition(tasks, "name").mapInArrow(read, "id long, embedding array<float>")


def finalize(
    spark: SparkSession, path: str, out: str, dim: int, shards: int, layout: str = "plain"
) -> int:
    """Write everything appended to ``path`` as a dataset of ``shards`` at ``out``; returns its rows.

    Vectors are numbered in the order of their ids, which must be different. The
    rows read must be the running total.
    """
    total = appended_total(spark, path)
    read = read_appended(spark, path, dim)
    numbered = pin(dense_ids(read.select("id"), ["id"], "place"))
    rows, different = numbered.agg(F.count(F.lit(1)), F.countDistinct("id")).first()
    if rows != total or different != total:
        raise ValueError(f"{rows} rows with {different} ids, but {total} were appended")
    placed = read.join(numbered, "id").select(F.col("place").alias("id"), "embedding")
    write_vec(assign_even(placed, shards, total=total), out, dim, shards, layout=layout)
    return total
