"""Top-K vector search as a scan of the documents.

The query set is small by design (5000 vectors unless the caller says more), the
documents are not. So documents stay where they are: every task multiplies its
Arrow batches with the query matrix, keeps the best K per query and shard, and
only those rows are shuffled for the final ranking. A query set too large to
broadcast is stored in groups of that size in the shared folder, and the documents
are scanned once per group, each task reading the group from there.

Scores are inner products or cosines in double precision, summed in the order of
the dimensions and not rounded; a vector without length has cosine 0 with all.
Equal scores rank by ascending id. Blocks are first scored in single precision on
vectors scaled to length 1 at most, so that neither very small nor very large ones
leave its range; whatever could be among the best K within the error bound of that
is scored again in double, so the shortcut never shows in the result.

A scan may have several arms, for example a rule, the exact search that it is
measured by, and the counts of both; they share the reading and the documents'
side of the work. Where a query has a score floor, documents are looked at zone by zone: no
document of a zone can score above the query's length times the largest length in
it, nor above the score of its centroid plus the query's length times its radius. A
zone below the floor is not multiplied.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from copy import copy
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import LongType

from quillvec.operators.candidates import HyperplaneHash, NearestCells
from quillvec.operators.ids import dense_ids
from quillvec.operators.sharding import shard_sizes
from quillvec.session import pin, scratch_path
from quillvec.sources.paths import filesystem, qualified

METRICS = ("dot", "cosine")
ARMS = "arm int, qid long, shard int, id long, score double, scored long"
SIZES_ARM = -1  # rows of a scan that say how many documents a shard has
DEFAULT_QUERIES = 5000
DEFAULT_KS = (10, 100, 1000, 10000)

MAX_BROADCAST_BYTES = 256 << 20  # query matrix held by driver and executors
TILE_CELLS = 4 << 20  # scores computed at a time inside a task
PAIR_CELLS = 1 << 18  # vector values gathered at a time; fits a core's cache
HELD_ROWS = 8 << 20  # hits a task may hold before it hands them on
SETTLE_ROWS = 1 << 20  # hits of a shard from which it is cut to K per query
SENT_ROWS = 1 << 16  # hits handed on in one batch
SALT_FROM_PARTITIONS = 64
ZONE_ROWS = 512  # documents that a score bound is taken over
ZONE_SLACK = 1e-6  # of the largest possible score, added to a bound
ROWS_PER_TASK = 32_768  # about 128 MB of vectors at 1024 dimensions
GUESS_SHARE = 16  # one in so many documents is searched to guess a floor
GUESS_SIGMAS = 4.0  # by which a guessed floor lies below the expected K-th score
FLOOR_GAIN = 4  # a floor repays its own search if it divides the hits shuffled by this

_LOWEST = -np.finfo(np.float64).max
_HUGE = 1e300


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Vectors of an Arrow list column as a float32 matrix; wrong lengths and values that are not finite fail."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != len(column) * dim or not (
        column.value_lengths().to_numpy(zero_copy_only=False) == dim
    ).all():
        raise ValueError(f"every vector must have {dim} values")
    with np.errstate(over="ignore"):
        flat = flat.astype(np.float32, copy=False)
    if not np.isfinite(flat).all():
        raise ValueError("vectors must be finite in single precision; one has a NaN or too large a value")
    return flat.reshape(-1, dim)


def _lengths(vectors: np.ndarray) -> np.ndarray:
    wide = vectors.astype(np.float64)
    return np.sqrt(np.einsum("ij,ij->i", wide, wide))


def _powers(lengths: np.ndarray) -> np.ndarray:
    """Powers of two that bring vectors of these lengths to length 1 at most, without rounding."""
    return np.ldexp(1.0, -np.frexp(lengths)[1])


def _inverse(lengths: np.ndarray) -> np.ndarray:
    return np.divide(1.0, lengths, out=np.zeros_like(lengths), where=lengths > 0)


@dataclass(frozen=True)
class Arm:
    """One way of searching in a scan.

    ``rule`` says which documents a query looks at, none means all. ``floor`` names a
    column of the queries with scores below which nothing counts; a query without one
    has no floor. Without ``zones`` every document is multiplied, without
    ``hits`` they are only counted. ``fixed`` skips zones by the given floors alone
    and not by what has been found since, so that counts depend on the zones only.
    Without ``by_shard`` the arm searches all shards as one.
    """

    rule: HyperplaneHash | NearestCells | None = None
    floor: str = "floor"
    zones: bool = True
    hits: bool = True
    fixed: bool = False
    by_shard: bool = True


class QueryBlock:
    """Query ids and matrix, and for one arm score floors and candidate keys, as numpy arrays."""

    def __init__(self, table: pa.Table, dim: int, metric: str = "dot"):
        self.table = table
        self.ids = table["qid"].to_numpy()
        self.vectors = _matrix(table["embedding"], dim)
        self.cosine = metric == "cosine"
        self.lengths = _lengths(self.vectors)
        self.scale = _inverse(self.lengths) if self.cosine else _powers(self.lengths)
        self.scaled = (self.vectors * self.scale[:, None]).astype(np.float32)

    def of(self, arm: Arm) -> QueryBlock:
        """The same queries with the floors and keys of an arm."""
        mine = copy(self)
        mine.arm, mine.rule = arm, arm.rule
        mine.floors = np.full(len(self.ids), _LOWEST)
        if arm.floor in self.table.column_names:
            given = self.table[arm.floor].to_numpy()
            mine.floors = np.where(np.isnan(given), _LOWEST, given)
        if arm.rule is not None:
            mine.keys = arm.rule.query_keys(self.vectors.astype(np.float64))
            mine.lists = arm.rule.query_lists(mine.keys)
        return mine

    def __len__(self) -> int:
        return len(self.ids)


class DocumentBlock:
    """Documents of one shard in a batch, with a scaled copy for the first look.

    ``reach`` is the largest length in the stored block of each document, if
    documents are stored so.
    """

    def __init__(
        self, ids: np.ndarray, vectors: np.ndarray, cosine: bool, reach: np.ndarray | None = None
    ):
        self.ids, self.vectors, self.reach, self.cosine = ids, vectors, reach, cosine
        self.lengths = _lengths(vectors)
        # One factor for all inner products, so that they stay comparable.
        self.scale = (
            _inverse(self.lengths) if cosine else _powers(self.lengths.max(initial=0.0, keepdims=True))
        )
        self.scaled = (vectors * self.scale[:, None]).astype(np.float32)

    def __len__(self) -> int:
        return len(self.ids)

    def part(self, rows: np.ndarray) -> DocumentBlock:
        mine = copy(self)
        mine.ids, mine.vectors, mine.lengths = self.ids[rows], self.vectors[rows], self.lengths[rows]
        mine.scaled = self.scaled[rows]
        mine.scale = self.scale[rows] if self.cosine else self.scale
        mine.reach = None if self.reach is None else self.reach[rows]
        return mine

    def zones(self) -> list[np.ndarray]:
        """Stored blocks, or else documents of about the same length."""
        if self.reach is not None:
            order = np.argsort(self.reach, kind="stable")
            return np.split(order, np.flatnonzero(np.diff(self.reach[order])) + 1)
        order = np.argsort(-self.lengths, kind="stable")
        return [order[at : at + ZONE_ROWS] for at in range(0, len(order), ZONE_ROWS)]

    def bounds(self, zones: list[np.ndarray], block: QueryBlock) -> np.ndarray:
        """``(queries, zones)``: no document of the zone scores higher."""
        lengths = np.ones(len(block)) if block.cosine else block.lengths
        if self.reach is not None and not self.cosine:
            reach = np.array([self.reach[rows[0]] for rows in zones])
            return np.outer(lengths, reach) * (1 + ZONE_SLACK)
        wide = (self.scaled if self.cosine else self.vectors).astype(np.float64)
        asked = (block.scaled if self.cosine else block.vectors).astype(np.float64)
        centres = np.array([wide[rows].mean(axis=0) for rows in zones])
        radius = np.array([_lengths(wide[rows] - c).max() for rows, c in zip(zones, centres)])
        reach = np.array([_lengths(wide[rows]).max() for rows in zones])
        largest = np.outer(lengths, reach)
        return np.minimum(largest, asked @ centres.T + np.outer(lengths, radius)) + ZONE_SLACK * largest


def _tiles(queries: int, documents: int) -> Iterator[slice]:
    step = max(1, TILE_CELLS // max(1, documents))
    for start in range(0, queries, step):
        yield slice(start, min(start + step, queries))


def _pair_scores(block: QueryBlock, docs: DocumentBlock, q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Double-precision scores of single (query, document) pairs, summed dimension by dimension."""
    out = np.empty(len(q))
    step = max(1, PAIR_CELLS // block.vectors.shape[1])
    for at in range(0, len(q), step):
        some = slice(at, at + step)
        # Products of two float32 are exact in double; only the order of the sum matters.
        products = block.vectors[q[some]].astype(np.float64) * docs.vectors[d[some]]
        out[some] = np.add.reduce(np.ascontiguousarray(products.T), axis=0)
    if block.cosine:
        lengths = block.lengths[q] * docs.lengths[d]
        out = np.divide(out, lengths, out=np.zeros_like(out), where=lengths > 0)
    return out


def _above(scores: np.ndarray, floor: np.ndarray, k: int, slack: float):
    """Cells that reach the floor and can be among the row's best ``k``; ties included."""
    reach = scores >= (floor - slack)[:, None]
    if scores.shape[1] > k and np.count_nonzero(reach) > 2 * k * len(scores):
        kth = scores.shape[1] - k
        best = np.partition(scores, kth, axis=1)[:, kth]
        reach &= scores >= (best - slack)[:, None]
    return np.nonzero(reach)


class _Best:
    """Running best K per query for one shard, inside one task."""

    def __init__(self, k: int, floors: np.ndarray):
        self.k = k
        self.floors = floors.copy()
        # At least half of what a full list holds is new when it is cut.
        self.most = min(HELD_ROWS, max(SETTLE_ROWS, 2 * k * len(floors)))
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.rows = 0

    def offer(
        self, block: QueryBlock, rows: np.ndarray, docs: DocumentBlock, wanted: np.ndarray | None
    ) -> None:
        """Score the queries numbered ``rows`` against one block of documents."""
        if wanted is not None and np.count_nonzero(wanted) * 4 <= wanted.size:
            q, d = np.nonzero(wanted)  # few candidates: score just those
        else:
            rough = block.scaled[rows] @ docs.scaled.T
            if wanted is not None:
                rough[~wanted] = -np.inf
            # Twice the float32 error bound of an inner product of vectors of length 1.
            slack = 2 * (block.vectors.shape[1] + 8) * 2.0**-23
            floor = self.floors[rows]
            if not block.cosine:
                floor = np.maximum(floor, -_HUGE) * block.scale[rows] * docs.scale
            q, d = _above(rough, np.where(self.floors[rows] > _LOWEST, floor, -_HUGE), self.k, slack)
        self.offer_pairs(block, docs, rows[q], d)

    def offer_pairs(self, block: QueryBlock, docs: DocumentBlock, q: np.ndarray, d: np.ndarray) -> None:
        """Score single pairs of query and document rows."""
        score = _pair_scores(block, docs, q, d)
        reach = score >= self.floors[q]
        self.parts.append((q[reach], docs.ids[d[reach]], score[reach]))
        self.rows += int(np.count_nonzero(reach))

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cut to K per query and raise the floors accordingly."""
        if not self.parts:
            empty = np.empty(0, dtype=np.int64)
            return empty, empty, empty.astype(np.float64)
        q, ids, score = (np.concatenate(c) for c in zip(*self.parts))
        order = np.lexsort((ids, -score, q))
        q, ids, score = q[order], ids[order], score[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q, side="left")
        keep = rank < self.k
        last = rank == self.k - 1
        self.floors[q[last]] = np.maximum(self.floors[q[last]], score[last])
        q, ids, score = q[keep], ids[keep], score[keep]
        self.parts, self.rows = [(q, ids, score)], len(q)
        return q, ids, score


def _per_shard(batch: pa.RecordBatch | pa.Table, dim: int, cosine: bool):
    """The batch cut by shard: ``(shard, documents, stored cells or none)``."""
    vectors = _matrix(batch.column("embedding"), dim)
    ids = np.asarray(batch.column("id"))
    shards = np.asarray(batch.column("shard"))
    cells, reach = (
        np.asarray(batch.column(c)) if c in batch.schema.names else None for c in ("cell", "reach")
    )
    for shard in np.unique(shards):
        rows = shards == shard
        docs = DocumentBlock(ids[rows], vectors[rows], cosine, None if reach is None else reach[rows])
        yield int(shard), docs, None if cells is None else cells[rows]


class _Search:
    """One arm inside one task: the best hits and the documents scored, by shard."""

    def __init__(self, block: QueryBlock, k: int):
        self.block, self.k = block, k
        self.best: dict[int, _Best] = {}
        self.scored: dict[int, np.ndarray] = {}

    def take(self, shard: int, docs: DocumentBlock, cells: np.ndarray | None) -> None:
        block, arm = self.block, self.block.arm
        shard = shard if arm.by_shard else 0
        best = self.best.setdefault(shard, _Best(self.k, block.floors))
        scored = self.scored.setdefault(shard, np.zeros(len(block), dtype=np.int64))
        if block.rule is not None and block.rule.sparse(block.lists, len(docs)):
            keys = block.rule.document_keys(docs.vectors.astype(np.float64))
            for q, d in block.rule.pairs(block.keys, block.lists, keys):
                scored += np.bincount(q, minlength=len(block))
                for at in range(0, len(q) if arm.hits else 0, TILE_CELLS):
                    best.offer_pairs(block, docs, q[at : at + TILE_CELLS], d[at : at + TILE_CELLS])
                    if best.rows > best.most:
                        best.settle()
        else:
            self._take_groups(docs, cells, best, scored)
        if best.rows > max(1 << 16, 2 * self.k * len(block)):
            best.settle()

    def _take_groups(
        self, docs: DocumentBlock, cells: np.ndarray | None, best: _Best, scored: np.ndarray
    ) -> None:
        block, arm = self.block, self.block.arm
        floors = block.floors if arm.fixed else best.floors
        for rows, some, new in self._meetings(docs, cells, floors):
            scored[rows] += len(some) if new is None else np.count_nonzero(new, axis=1)
            if arm.hits:
                for tile in _tiles(len(rows), len(some)):
                    best.offer(block, rows[tile], some, None if new is None else new[tile])
                    if best.rows > best.most:
                        best.settle()

    def _meetings(self, docs: DocumentBlock, cells: np.ndarray | None, floors: np.ndarray):
        """Queries, documents and the pairs among them that this arm scores."""
        block, everyone = self.block, np.arange(len(self.block))
        if block.rule is not None:
            stored = cells is not None and isinstance(block.rule, NearestCells)
            keys = cells[None, :] if stored else block.rule.document_keys(docs.vectors.astype(np.float64))
            for rows, d, new in block.rule.meetings(block.keys, block.lists, keys):
                yield rows, docs.part(d), new
            return
        if not block.arm.zones or not (floors > _LOWEST).any():
            yield everyone, docs, None
            return
        zones = docs.zones()
        needed = docs.bounds(zones, block) >= floors[:, None]
        if needed.all():
            yield everyone, docs, None
            return
        for zone, wanted in zip(zones, needed.T):
            if wanted.any():
                yield np.flatnonzero(wanted), docs.part(zone), None

    def hits(self) -> Iterator[tuple[int, tuple]]:
        for shard, best in self.best.items():
            yield shard, best.settle()


def _rows(arm: int, shard: int, **columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    types = {"qid": pa.int64(), "id": pa.int64(), "score": pa.float64(), "scored": pa.int64()}
    given = {
        c: pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in types.items()
    }
    return pa.record_batch(
        {
            "arm": pa.array(np.full(n, arm), pa.int32()),
            "qid": given["qid"],
            "shard": pa.array(np.full(n, shard), pa.int32()),
            "id": given["id"],
            "score": given["score"],
            "scored": given["scored"],
        }
    )


def _search(
    batches: Iterable, asked: QueryBlock, arms: tuple[Arm, ...], k: int, counts: bool, sizes: bool
) -> Iterator[pa.RecordBatch]:
    """All arms over the batches of a task: hits, and if wanted counts and shard sizes."""
    searches = [_Search(asked.of(arm), k) for arm in arms]
    held: dict[int, int] = {}

    def taken() -> Iterator[pa.RecordBatch]:
        for number, one in enumerate(searches):
            for shard, (q, ids, score) in one.hits():
                for at in range(0, len(q), SENT_ROWS):
                    some = slice(at, at + SENT_ROWS)
                    yield _rows(number, shard, qid=asked.ids[q[some]], id=ids[some], score=score[some])
            one.best = {}

    for batch in batches:
        for shard, docs, cells in _per_shard(batch, asked.vectors.shape[1], asked.cosine):
            held[shard] = held.get(shard, 0) + len(docs)
            for one in searches:
                one.take(shard, docs, cells)
        if sum(b.rows for one in searches for b in one.best.values()) > HELD_ROWS:
            for one in searches:
                for best in one.best.values():
                    best.settle()
            # One shard's best K always fit, see _scan; only several may not.
            if sum(b.rows for one in searches for b in one.best.values()) > HELD_ROWS:
                yield from taken()
    yield from taken()
    if counts:
        for number, one in enumerate(searches):
            for shard, scored in one.scored.items():
                yield _rows(number, shard, qid=asked.ids, scored=scored)
    if sizes:
        for shard, n in held.items():
            yield _rows(SIZES_ARM, shard, scored=[n])


@dataclass(frozen=True)
class QuerySet:
    """Queries ready for scanning: broadcast once if small, else stored in ``groups`` folders."""

    frame: DataFrame
    dim: int
    shared: Broadcast | None
    max_broadcast_bytes: int
    stored: str = ""
    groups: int = 0


def load_queries(
    queries: DataFrame, dim: int, max_broadcast_bytes: int = MAX_BROADCAST_BYTES
) -> QuerySet:
    """Prepare ``(qid, embedding[, floor...])``; reads at most one row more than may be broadcast.

    A larger set is stored by a hash of its ids, in groups of about half that size.
    """
    spark = queries.sparkSession
    floors = (c for c in queries.columns if c.startswith("floor"))
    frame = queries.select("qid", "embedding", *floors)
    fits = max(1, max_broadcast_bytes // (dim * 8))
    table = frame.limit(fits + 1).toArrow()
    if table.num_rows <= fits:
        return QuerySet(frame, dim, spark.sparkContext.broadcast(table), max_broadcast_bytes)
    groups = -(-2 * frame.count() // fits)
    path = qualified(spark, scratch_path(spark, "queries"))
    grouped = frame.withColumn("_group", F.pmod(F.xxhash64("qid"), F.lit(groups)))
    grouped.repartition("_group").write.partitionBy("_group").parquet(path)
    return QuerySet(frame, dim, None, max_broadcast_bytes, path, groups)


def _stored_group(path: str) -> pa.Table | None:
    """A group of stored queries; none if no query has its hash."""
    fs, where = filesystem(path)
    if fs.get_file_info(where).type == pafs.FileType.NotFound:
        return None
    return pads.dataset(where, filesystem=fs, format="parquet").to_table()


def _doc_columns(docs: DataFrame, by_shard: bool, arms: tuple[Arm, ...]) -> DataFrame:
    shard = F.col("shard") if by_shard and "shard" in docs.columns else F.lit(0)
    used = {"cell"} if any(isinstance(a.rule, NearestCells) for a in arms) else set()
    used |= {"reach"} if any(a.rule is None and a.zones for a in arms) else set()
    more = [c for c in ("cell", "reach") if c in used and c in docs.columns]
    return docs.select("id", shard.cast("int").alias("shard"), "embedding", *more)


def scan_arms(
    docs: DataFrame,
    queries: DataFrame | QuerySet,
    k: int,
    dim: int,
    arms: tuple[Arm, ...],
    by_shard: bool = True,
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
    metric: str = "dot",
    counts: bool = False,
) -> DataFrame:
    """One scan of the documents for all ``arms``: ``(arm, qid, shard, id, score, scored)``.

    Rows with an ``id`` are hits, at least the best K per arm, query and shard. With
    ``counts``, rows without one say how many documents of a shard a query was
    compared with, and rows of ``SIZES_ARM`` how many it has; add them up.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}, not {metric!r}")
    docs = _doc_columns(docs, by_shard, arms)
    if not isinstance(queries, QuerySet):
        queries = load_queries(queries, dim, max_broadcast_bytes)
    shared, stored = queries.shared, queries.stored

    def scan_for(find, first: bool) -> DataFrame:
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked = find()
            if asked is not None:
                block = QueryBlock(asked, dim, metric)
                yield from _search(batches, block, arms, k, counts, counts and first)

        return docs.mapInArrow(scan, ARMS)

    def some(start: int, count: int):
        return lambda: shared.value.slice(start, count)

    def group(number: int):
        return lambda: _stored_group(f"{stored}/_group={number}")

    # Documents stay where they are, whatever the number of queries. A task holds
    # K hits per query and arm; where that is too much for all queries at once, the
    # documents are scanned once per group of queries. Reading again costs little
    # next to the arithmetic, which stays the same.
    if shared is None:
        finds = [group(n) for n in range(queries.groups)]
    else:
        count = max(1, HELD_ROWS // (2 * k * len(arms)))
        finds = [some(start, count) for start in range(0, max(1, shared.value.num_rows), count)]
    scans = [scan_for(find, n == 0) for n, find in enumerate(finds)]
    return reduce(DataFrame.unionByName, scans)


def arm_hits(scanned: DataFrame, arm: int) -> DataFrame:
    """``(qid, shard, id, score)`` that one arm of a scan found."""
    found = scanned.where((F.col("arm") == arm) & F.col("id").isNotNull())
    return found.select("qid", "shard", "id", "score")


def arm_counts(scanned: DataFrame, arm: int) -> DataFrame:
    """``(qid, shard, scored)``: documents each query was compared with."""
    rows = scanned.where((F.col("arm") == arm) & F.col("id").isNull())
    return rows.groupBy("qid", "shard").agg(F.sum("scored").alias("scored"))


def scanned_sizes(scanned: DataFrame) -> DataFrame:
    """``(shard, size)`` of the documents a scan has read."""
    rows = scanned.where(F.col("arm") == SIZES_ARM)
    return rows.groupBy("shard").agg(F.sum("scored").alias("size"))


def query_set(vectors: DataFrame, n: int = DEFAULT_QUERIES, id_col: str = "id") -> DataFrame:
    """The first ``n`` vectors as ``(qid, embedding)``; they stay in the corpus too."""
    return vectors.where(F.col(id_col) < n).select(F.col(id_col).alias("qid"), "embedding")


def best_k(hits: DataFrame, k: int, keys: tuple[str, ...] = ("qid",)) -> DataFrame:
    """The K best hits per key with their ``rank``.

    On a large cluster a first cut runs per (key, salt), so even a single query
    with hits from every task never ends up whole in one place.
    """

    def cut(df: DataFrame, columns: list[str]) -> DataFrame:
        w = Window.partitionBy(*columns).orderBy(F.desc("score"), F.asc("id"))
        return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    partitions = int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if partitions > SALT_FROM_PARTITIONS:
        salt = F.pmod(F.xxhash64("id"), F.lit(math.isqrt(partitions)))
        hits = cut(hits.withColumn("_salt", salt), [*keys, "_salt"]).drop("_salt", "rank")
    return cut(hits, list(keys))


def shard_hits(
    docs: DataFrame, queries: DataFrame | QuerySet, k: int, dim: int, rule=None, **options
) -> DataFrame:
    """Hits found by the scan: at least the best K per query and shard, unranked."""
    return arm_hits(scan_arms(docs, queries, k, dim, (Arm(rule),), **options), 0)


def per_shard_top_k(
    docs: DataFrame, queries: DataFrame | QuerySet, k: int, dim: int, rule=None, **options
) -> DataFrame:
    """``(qid, shard, rank, id, score)``: the full K on every shard."""
    return per_shard_best(shard_hits(docs, queries, k, dim, rule, **options), k)


def per_shard_best(hits: DataFrame, k: int) -> DataFrame:
    """The K best hits of every query on every shard, with their ``rank``."""
    return best_k(hits, k, ("qid", "shard"))


def merge_top_k(per_shard: DataFrame, k: int) -> DataFrame:
    """Global top K from shard results."""
    return best_k(per_shard.select("qid", "shard", "id", "score"), k)


def top_k(
    docs: DataFrame, queries: DataFrame | QuerySet, k: int, dim: int, rule=None, **options
) -> DataFrame:
    """``(qid, rank, id, score)``: exact, or approximate when a rule is given."""
    hits = shard_hits(docs, queries, k, dim, rule, by_shard=False, **options)
    return best_k(hits.drop("shard"), k)


def at_each_k(ranked: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """One copy of a hit for every K that includes it, from one ranking at the largest K."""
    wanted = F.filter(F.array(*(F.lit(k) for k in ks)), lambda k: k >= F.col("rank"))
    return ranked.withColumn("k", F.explode(wanted))


def kth_scores(ranked: DataFrame, k: int) -> DataFrame:
    """``(qid, floor)`` for queries that have K hits; others have no floor yet."""
    return ranked.where(F.col("rank") == k).select("qid", F.col("score").alias("floor"))


def floor_pruned_top_k(
    docs: DataFrame,
    queries: DataFrame | QuerySet,
    k: int,
    dim: int,
    rule=None,
    floor_docs: DataFrame | None = None,
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
    metric: str = "dot",
) -> DataFrame:
    """Same answer as :func:`top_k`, with a shared score floor.

    A part of the documents, by default shard 0, is searched first. No final hit
    can score below the K-th score found there, so that score travels with the
    queries and the scan of everything drops what is lower before any shuffle.
    """
    if isinstance(queries, QuerySet):
        queries, max_broadcast_bytes = queries.frame, queries.max_broadcast_bytes
    part = docs.where(F.col("shard") == 0) if floor_docs is None else floor_docs
    options = {"max_broadcast_bytes": max_broadcast_bytes, "metric": metric}
    first = top_k(part, queries, k, dim, rule, **options)
    with_floor = queries.join(kth_scores(first, k), "qid", "left")
    return top_k(docs, with_floor, k, dim, rule, **options)


def guessed_floor_top_k(
    docs: DataFrame, queries: DataFrame, k: int, dim: int, **options
) -> DataFrame:
    """Same answer as :func:`top_k` for a K so large that a floor known for sure saves little.

    A sample of the documents, drawn by a hash of the id, says about where the K-th
    score of all lies. All documents are searched with that floor; a query that then has
    fewer than K hits was guessed too high and is searched again without one. So tasks
    hand on little more than K hits per query together, not each.
    """
    some = docs.where(F.pmod(F.xxhash64("id"), F.lit(GUESS_SHARE)) == 0)
    expected = k / GUESS_SHARE
    place = max(1, math.ceil(expected + GUESS_SIGMAS * math.sqrt(expected)))
    floors = pin(kth_scores(top_k(some, queries, place, dim, **options), place))
    hits = pin(top_k(docs, queries.join(floors, "qid", "left"), k, dim, **options))
    whole = hits.where(F.col("rank") == k).select("qid")
    short = pin(queries.join(floors.join(whole, "qid", "left_anti").select("qid"), "qid"))
    if short.isEmpty():
        return hits
    again = top_k(docs, short, k, dim, **options)
    return hits.join(short.select("qid"), "qid", "left_anti").unionByName(again)


def floor_repays(total: int, k: int) -> bool:
    """Whether a floor saves enough of the hits that tasks hand on to pay for finding it.

    Without one every task hands on K hits per query. With the floor of
    :func:`floor_part` both searches hand on about K per square root of the tasks.
    """
    tasks = max(1.0, total / ROWS_PER_TASK)
    return min(total, k * tasks) > FLOOR_GAIN * 2 * k * math.sqrt(tasks)


def floor_part(docs: DataFrame, total: int) -> DataFrame:
    """A part of densely numbered documents whose K-th scores make good floors.

    Its size balances the hits this part hands on against those the floor lets
    through afterwards: the square root of documents times documents per task.
    """
    return docs.where(F.col("id") < math.isqrt(total * ROWS_PER_TASK))


def scored_counts(
    docs: DataFrame, queries: DataFrame | QuerySet, dim: int, rule=None, **options
) -> DataFrame:
    """``(qid, shard, scored)``: documents each query is compared with, without scoring them."""
    arms = (Arm(rule, zones=False, hits=False),)
    return arm_counts(scan_arms(docs, queries, 1, dim, arms, counts=True, **options), 0)


def saved_lookups(counts: DataFrame, sizes: DataFrame) -> DataFrame:
    """``(qid, shard, size, scored, saved)`` with ``saved = max(0, size - scored)``.

    ``sizes`` has a row per shard.
    """
    return counts.join(sizes, "shard").select(
        "shard",
        "qid",
        "scored",
        "size",
        F.greatest(F.lit(0), F.col("size") - F.col("scored")).alias("saved"),
    )


def lookups_saved(
    docs: DataFrame, queries: DataFrame | QuerySet, dim: int, shards: int, rule=None, **options
) -> DataFrame:
    """``(qid, shard, size, scored, saved)`` of a scan that only counts."""
    sizes = shard_sizes(docs, shards).select("shard", "size")
    return saved_lookups(scored_counts(docs, queries, dim, rule, **options), F.broadcast(sizes))


def assign_cells(docs: DataFrame, rule: NearestCells) -> DataFrame:
    """Add ``cell``, the number of the nearest centroid."""

    @arrow_udf(LongType())
    def nearest(column: pa.Array) -> pa.Array:
        vectors = _matrix(column, rule.centroids.shape[1]).astype(np.float64)
        return pa.array(rule.document_keys(vectors)[0], pa.int64())

    return docs.withColumn("cell", nearest("embedding"))


def write_cells(
    docs: DataFrame,
    rule: NearestCells,
    path: str,
    files_per_cell: int | None = None,
    mode: str = "error",
) -> None:
    """Store documents by cell, so that a search reads only the cells it visits.

    A cell is spread by id over ``files_per_cell`` tasks, or else over as many as give
    each about ``ROWS_PER_TASK`` rows, however large the cell is.
    """
    assigned = assign_cells(docs, rule)
    if files_per_cell is None:
        # One row per cell; the centroids are on the driver anyway.
        sizes = assigned.groupBy("cell").agg(
            F.ceil(F.count(F.lit(1)) / ROWS_PER_TASK).cast("int").alias("_files")
        )
        assigned = assigned.join(F.broadcast(sizes), "cell")
    else:
        assigned = assigned.withColumn("_files", F.lit(files_per_cell))
    salted = assigned.withColumn("_file", F.pmod(F.xxhash64("id"), F.col("_files")))
    placed = salted.repartition("cell", "_file").drop("_file", "_files")
    placed.write.mode(mode).partitionBy("cell").parquet(path)


def visited_cells(stored: DataFrame, queries: QuerySet, rule: NearestCells) -> DataFrame:
    """The part of a cell table that at least one query visits; pruned by directory."""
    if queries.shared is None:
        return stored
    block = QueryBlock(queries.shared.value, queries.dim).of(Arm(rule))
    visited = np.flatnonzero(block.keys.any(axis=1))
    return stored.where(F.col("cell").isin([int(c) for c in visited]))


def by_length(docs: DataFrame, rows: int = ZONE_ROWS) -> DataFrame:
    """Documents with ``block`` and ``reach``: runs of ``rows`` in falling order of length.

    ``reach`` is the largest length in a block, which bounds every inner product with
    it. Store the result by ``block`` so that a task reads whole blocks.
    """
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    measured = docs.withColumn("_length", F.sqrt(square))
    keys = measured.select("id", (-F.col("_length")).alias("_down"))
    placed = dense_ids(keys, ["_down", "id"], "_place").select(
        "id", F.floor(F.col("_place") / rows).alias("block"), "_down"
    )
    reach = placed.groupBy("block").agg((-F.min("_down")).alias("reach"))
    return docs.join(placed.drop("_down").join(reach, "block"), "id")


def with_text(hits: DataFrame, chunks: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """Hits with the text of the document they point to."""
    return hits.join(chunks.withColumnRenamed(id_col, "id"), "id")


def snapshot_floor(snapshots: DataFrame, k: int) -> DataFrame:
    """Global K-th score from the shards' latest snapshots.

    ``snapshots`` is ``(qid, shard, seq, hits array<struct<id, score>>)``. The
    last ``seq`` of a shard replaces the earlier ones. With fewer than K hits the
    lowest present counts; with none the floor is minus infinity.
    """
    latest = snapshots.groupBy("qid", "shard").agg(F.max_by("hits", "seq").alias("hits"))
    hits = latest.select("qid", "shard", F.explode("hits").alias("h")).select(
        "qid", "shard", "h.id", "h.score"
    )
    floors = best_k(hits, k).groupBy("qid").agg(
        F.min("score").alias("floor"), F.count(F.lit(1)).alias("merged")
    )
    asked = snapshots.groupBy("qid").agg(F.countDistinct("shard").alias("shards"))
    return asked.join(floors, "qid", "left").select(
        "qid",
        "shards",
        F.coalesce("merged", F.lit(0)).cast("long").alias("merged"),
        F.coalesce("floor", F.lit(float("-inf"))).alias("floor"),
    )
