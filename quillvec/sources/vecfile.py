"""Raw float32 vector files as a Spark data source, ``format("vec")``.

A file is little-endian float32, row after row, without header or ids: the id of
a vector is its position. A dataset is ``docs.vec``, or ``docs-shard-{i}.vec``
read in numeric order and numbered through.

Reading cuts files into byte ranges, so one large file feeds many tasks; conditions
on ``id`` and ``shard`` choose ranges and files before anything is read. Writing
puts each shard into one file, because the format has no other way to keep its
order; choose enough shards that one of them suits one task.

A dataset is published in one of two layouts. ``plain`` has the files under their
names in the folder, as other tools expect them; its commit renames what the tasks
wrote. ``listed`` leaves them where the tasks wrote them, in a folder per write, and
publishes their list (see ``listing``); it suits stores where a rename is a copy,
and a write that fails leaves the dataset before it readable.
"""

from __future__ import annotations

import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamArrowWriter,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from quillvec.sources.listing import LIST_DIR, listed, publish
from quillvec.sources.paths import filesystem, qualified

# The file format.
FLOAT = np.dtype("<f4")
SINGLE_FILE = "docs.vec"
SHARD_FILE = re.compile(r"docs-shard-(\d+)\.vec")
SCHEMA = "id long, shard int, embedding array<float>"
PLACES = "id long, shard int"
LAYOUTS = ("plain", "listed")

RANGE_BYTES = 64 << 20
BATCH_ROWS = 4096


def dataset_files(path: str) -> list[tuple[str, int, int]]:
    """``(file, shard, bytes)`` of a vector file or dataset directory, in id order."""
    fs, where = filesystem(path)
    info = fs.get_file_info(where)
    if info.type == pafs.FileType.File:
        return [(info.path, 0, info.size)]
    if info.type != pafs.FileType.Directory:
        raise FileNotFoundError(f"no vector file or dataset at {path}")
    if (entry := listed(fs, where)) is not None and "files" in entry:
        return [(posixpath.join(where, name), shard, size) for name, shard, size in entry["files"]]
    entries = {posixpath.basename(e.path): e for e in fs.get_file_info(pafs.FileSelector(where))}
    if SINGLE_FILE in entries:
        single = entries[SINGLE_FILE]
        return [(single.path, 0, single.size)]
    shards = sorted(
        (int(found[1]), entry.path, entry.size)
        for name, entry in entries.items()
        if (found := SHARD_FILE.fullmatch(name))
    )
    if not shards:
        raise FileNotFoundError(f"neither {SINGLE_FILE} nor shard files in {path}")
    return [(file, shard, size) for shard, file, size in shards]


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors of an Arrow list column as rows; wrong lengths fail."""
    if column.null_count or not (np.asarray(column.value_lengths()) == dim).all():
        raise ValueError(f"every vector must have {dim} values")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


@dataclass
class VecRange(InputPartition):
    file: str
    shard: int
    first_row: int
    rows: int
    first_id: int


class VecReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.dim = int(options["dim"])
        self.lenient = options.get("onpartial", "fail") == "ignore"
        self.range_rows = max(1, int(options.get("rangebytes", RANGE_BYTES)) // (self.dim * 4))
        self.with_vectors = options.get("vectors", "true") == "true"
        self.first, self.last = 0, None  # ids asked for
        self.shards: set[int] | None = None  # shards asked for

    def _asked(self, wanted: Filter) -> bool:
        """Take a condition on ids or shards into account; false if Spark still has to test it."""
        if getattr(wanted, "attribute", None) not in (("id",), ("shard",)):
            return False
        if isinstance(wanted, IsNotNull):
            return True
        values = wanted.value if isinstance(wanted, In) else (getattr(wanted, "value", None),)
        if not all(isinstance(v, int) and not isinstance(v, bool) for v in values):
            return False
        if wanted.attribute == ("shard",):
            if not isinstance(wanted, EqualTo | In):
                return False
            self.shards = set(values) if self.shards is None else self.shards & set(values)
            return True
        if isinstance(wanted, EqualTo | In):
            first, last = min(values, default=0), max(values, default=-1)
        elif isinstance(wanted, GreaterThan | GreaterThanOrEqual):
            first, last = values[0] + isinstance(wanted, GreaterThan), None
        elif isinstance(wanted, LessThan | LessThanOrEqual):
            first, last = 0, values[0] - isinstance(wanted, LessThan)
        else:
            return False
        self.first = max(self.first, first)
        if last is not None:
            self.last = last if self.last is None else min(self.last, last)
        return not isinstance(wanted, In)  # a list of ids leaves gaps

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for wanted in filters:
            if not self._asked(wanted):
                yield wanted

    def partitions(self) -> list[VecRange]:
        ranges, base, record = [], 0, self.dim * FLOAT.itemsize
        for file, shard, size in dataset_files(self.path):
            if size % record and not self.lenient:
                raise ValueError(f"{file}: {size} bytes is not a multiple of {record}")
            rows = size // record
            start = max(0, self.first - base)
            end = rows if self.last is None else min(rows, self.last + 1 - base)
            if self.shards is None or shard in self.shards:
                for first in range(start, end, self.range_rows):
                    count = min(self.range_rows, end - first)
                    ranges.append(VecRange(file, shard, first, count, base + first))
            base += rows
        return ranges or [VecRange("", 0, 0, 0, 0)]

    def _places(self, part: VecRange) -> Iterator[pa.RecordBatch]:
        """Ids and shards alone, which follow from the sizes of the files."""
        for done in range(0, part.rows, BATCH_ROWS):
            want = min(BATCH_ROWS, part.rows - done)
            yield pa.record_batch(
                {
                    "id": pa.array(np.arange(want) + part.first_id + done, pa.int64()),
                    "shard": pa.array(np.full(want, part.shard), pa.int32()),
                }
            )

    def read(self, part: VecRange) -> Iterator[pa.RecordBatch]:
        if part.rows == 0:
            return
        if not self.with_vectors:
            yield from self._places(part)
            return
        fs, _ = filesystem(self.path)
        with fs.open_input_file(part.file) as source:
            source.seek(part.first_row * self.dim * FLOAT.itemsize)
            done = 0
            while done < part.rows:
                want = min(BATCH_ROWS, part.rows - done)
                values = np.frombuffer(source.read(want * self.dim * FLOAT.itemsize), FLOAT)
                if len(values) != want * self.dim:
                    raise EOFError(f"{part.file} ended early")
                ids = np.arange(want) + part.first_id + done
                offsets = np.arange(want + 1, dtype=np.int32) * self.dim
                yield pa.record_batch(
                    {
                        "id": pa.array(ids, pa.int64()),
                        "shard": pa.array(np.full(want, part.shard), pa.int32()),
                        "embedding": pa.ListArray.from_arrays(
                            pa.array(offsets), pa.array(values, pa.float32())
                        ),
                    }
                )
                done += want


@dataclass
class ShardsWritten(WriterCommitMessage):
    files: list[tuple[str, str, int, int]]  # written name, final name, shard, bytes


class VecWriter(DataSourceArrowWriter):
    """Writes rows that arrive ordered by (shard, id), one file per shard.

    Every attempt of a task writes under names of its own. On commit they are moved
    into place or, in the listed layout, named in the folder's list; failed or
    repeated attempts leave nothing behind that counts.
    """

    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.path = options["path"]
        self.dim = int(options["dim"])
        self.file_name = options.get("filename", "")
        self.shards = int(options.get("shards", 0))
        self.layout = options.get("layout", "plain")
        self.folder = f"v-{uuid.uuid4().hex}" if self.layout == "listed" else ""
        self.overwrite = overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> ShardsWritten:
        fs, where = filesystem(self.path)
        fs.create_dir(posixpath.join(where, self.folder), recursive=True)
        files, sink, current = [], None, None
        try:
            for batch in batches:
                shards = np.asarray(batch.column("shard"))
                values = matrix(batch.column("embedding"), self.dim)
                cuts = np.flatnonzero(np.diff(shards)) + 1
                for rows in np.split(np.arange(len(shards)), cuts):
                    if len(rows) == 0:
                        continue
                    shard = int(shards[rows[0]])
                    if shard != current:
                        if sink is not None:
                            sink.close()
                        final = self.file_name or f"docs-shard-{shard}.vec"
                        written = posixpath.join(self.folder, f"_{final}.{uuid.uuid4().hex}.tmp")
                        if self.folder:
                            written = written.replace("/_", "/").removesuffix(".tmp")
                        sink = fs.open_output_stream(posixpath.join(where, written))
                        files.append([written, final, shard, 0])
                        current = shard
                    sink.write(values[rows].astype(FLOAT).tobytes())
                    files[-1][3] += len(rows) * self.dim * FLOAT.itemsize
            if sink is not None:
                sink.close()
        except BaseException:
            # A failed task sends no message, so nobody else knows these names.
            if sink is not None and not sink.closed:
                sink.close()
            for written, *_ in files:
                fs.delete_file(posixpath.join(where, written))
            raise
        return ShardsWritten([tuple(f) for f in files])

    def commit(self, messages: list[ShardsWritten | None]) -> None:
        written = [f for message in messages if message for f in message.files]
        if self.layout == "listed":
            self._list(written)
        else:
            self._move(written)

    def _list(self, written: list[tuple[str, str, int, int]]) -> None:
        fs, where = filesystem(self.path)
        before = None if self.overwrite else listed(fs, where)
        files = {shard: [name, shard, size] for name, _, shard, size in written}
        for name, shard, size in before["files"] if before else ():
            if shard in files:
                raise ValueError(f"shard {shard} is there already")
            files[shard] = [name, shard, size]
        for shard in range(self.shards):
            files.setdefault(shard, ["", shard, 0])  # a shard without rows needs no file
        publish(fs, where, {"files": [files[shard] for shard in sorted(files)]})

    def _move(self, written: list[tuple[str, str, int, int]]) -> None:
        fs, where = filesystem(self.path)
        if self.overwrite:
            old = fs.get_file_info(pafs.FileSelector(where, allow_not_found=True))
            for entry in old:
                name = posixpath.basename(entry.path)
                if name == SINGLE_FILE or SHARD_FILE.fullmatch(name):
                    fs.delete_file(entry.path)
            if listed(fs, where) is not None:
                fs.delete_dir(posixpath.join(where, LIST_DIR))
        for temporary, final, *_ in written:
            fs.move(posixpath.join(where, temporary), posixpath.join(where, final))
        # A shard without rows had no task output, but is a file all the same.
        there = {final for _, final, *_ in written}
        names = [self.file_name] if self.file_name else map("docs-shard-{}.vec".format, range(self.shards))
        for name in names:
            path = posixpath.join(where, name)
            if name not in there and fs.get_file_info(path).type == pafs.FileType.NotFound:
                fs.create_dir(where, recursive=True)
                fs.open_output_stream(path).close()

    def abort(self, messages: list[ShardsWritten | None]) -> None:
        fs, where = filesystem(self.path)
        for message in messages:
            for written, *_ in message.files if message else ():
                fs.delete_file(posixpath.join(where, written))


class VecDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vec"

    def schema(self) -> str:
        return SCHEMA if self.options.get("vectors", "true") == "true" else PLACES

    def reader(self, schema: StructType) -> VecReader:
        return VecReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> VecWriter:
        return VecWriter(self.options, schema, overwrite)

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamArrowWriter:  # noqa: N802
        from quillvec.streaming.vectors import VecStreamSink

        return VecStreamSink(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(VecDataSource)


def read_vec(
    spark: SparkSession, path: str, dim: int, on_partial: str = "fail", **options
) -> DataFrame:
    """``(id, shard, embedding)`` of a file or dataset directory.

    ``on_partial="ignore"`` leaves out an incomplete last record instead of failing.
    ``vectors="false"`` gives ids and shards alone and opens no file. Conditions on
    ids and shards decide which byte ranges are read; that needs Spark's pushdown
    into Python sources, which is turned on here.
    """
    register(spark)
    reader = spark.read.format("vec").option("dim", dim).option("onPartial", on_partial)
    return reader.options(**options).load(qualified(spark, path))


def write_vec(
    df: DataFrame,
    path: str,
    dim: int,
    shards: int,
    mode: str = "overwrite",
    file_name: str = SINGLE_FILE,
    layout: str = "plain",
) -> None:
    """Write ``(id, shard, embedding)``; with one shard the file is ``file_name``.

    Each shard goes to the task of its own number, sorted by id. ``layout`` says how
    the result is published.
    """
    if layout not in LAYOUTS:
        raise ValueError(f"layout must be one of {LAYOUTS}, not {layout!r}")
    spark = df.sparkSession
    register(spark)
    placed = (
        df.select("id", F.col("shard").cast("int").alias("shard"), "embedding")
        .repartitionById(shards, "shard")
        .sortWithinPartitions("shard", "id")
    )
    writer = placed.write.format("vec").option("dim", dim).option("shards", shards)
    writer = writer.option("layout", layout)
    if shards == 1:
        writer = writer.option("fileName", file_name)
    writer.mode(mode).save(qualified(spark, path))
