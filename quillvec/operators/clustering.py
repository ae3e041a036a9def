"""Search cells learned from the vectors: k-means on the sphere, by Lloyd's rounds.

Seeds come from a bounded sample by k-means++; every round then reads all vectors.
A task adds up its vectors per cell and hands on one row per cell; those rows are
added up in two steps, so what one task meets does not grow with the number of
tasks, and the driver receives the cells alone. Sums are whole numbers (vectors in
steps of ``1 / STEPS``), so neither the order of rows nor of tasks shows in a centroid.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillvec.operators.embedding import MAX_CENTROID_VALUES
from quillvec.operators.search import _inverse, _lengths, _matrix

STEPS = 1 << 24
SAMPLE_ROWS = 20_000
SUMS = "cell int, n long, sums binary"


def _unit(vectors: np.ndarray) -> np.ndarray:
    wide = vectors.astype(np.float64)
    return wide * _inverse(_lengths(wide))[:, None]


def seed_cells(sample: np.ndarray, cells: int, seed: int) -> np.ndarray:
    """First centroids by k-means++: each next one with a chance that grows with its distance."""
    rng = np.random.default_rng(seed)
    unit = _unit(sample)
    chosen = [int(rng.integers(len(unit)))]
    far = np.full(len(unit), np.inf)
    while len(chosen) < cells:
        far = np.minimum(far, np.maximum(0.0, 2 - 2 * (unit @ unit[chosen[-1]])))
        total = far.sum()
        # With fewer different vectors than cells the rest repeat; such cells stay empty.
        chance = far / total if total > 0 else np.full(len(unit), 1 / len(unit))
        chosen.append(int(rng.choice(len(unit), p=chance)))
    return unit[chosen]


def nearest(unit: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The cell of each vector; the lower number of equals."""
    return np.argmax(unit @ centroids.T, axis=1)


def _sum_rows(sums: dict[int, list]) -> pa.RecordBatch:
    cells = sorted(sums)
    return pa.record_batch(
        {
            "cell": pa.array(cells, pa.int32()),
            "n": pa.array([sums[c][0] for c in cells], pa.int64()),
            "sums": pa.array([sums[c][1].tobytes() for c in cells], pa.binary()),
        }
    )


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, list] = {}
    for batch in batches:
        for row in batch.to_pylist():
            own = sums.setdefault(row["cell"], [0, 0])
            own[0] += row["n"]
            own[1] = own[1] + np.frombuffer(row["sums"], np.int64)
    yield _sum_rows(sums)


def cell_sums(docs: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``(cell, n, sums)``: how many vectors are nearest to each centroid, and their sum in steps."""
    cells, dim = centroids.shape

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((cells, dim), dtype=np.int64)
        counts = np.zeros(cells, dtype=np.int64)
        for batch in batches:
            unit = _unit(_matrix(batch.column(0), dim))
            cell = nearest(unit, centroids)
            order = np.argsort(cell, kind="stable")
            found, first = np.unique(cell[order], return_index=True)
            if len(found):
                whole = np.rint(unit[order] * STEPS).astype(np.int64)
                sums[found] += np.add.reduceat(whole, first, axis=0)
                counts += np.bincount(cell, minlength=cells)
        yield _sum_rows({c: [int(counts[c]), sums[c]] for c in np.flatnonzero(counts).tolist()})

    partial = docs.select("embedding").mapInArrow(assign, SUMS)
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = partial.withColumn("salt", F.floor(F.rand(0) * math.isqrt(tasks)))
    once = salted.repartition(tasks, "cell", "salt").drop("salt").mapInArrow(_merged, SUMS)
    return once.repartition(tasks, "cell").mapInArrow(_merged, SUMS)


def learn_cells(
    docs: DataFrame,
    dim: int,
    cells: int,
    rounds: int = 6,
    sample_rows: int = SAMPLE_ROWS,
    seed: int = 7,
) -> np.ndarray:
    """``(cells, dim)`` centroids of length 1 of ``docs (id, embedding)``.

    Stops early once no centroid moves. A cell that loses all vectors keeps its place.
    """
    if cells * dim > MAX_CENTROID_VALUES:
        raise ValueError(f"more than {MAX_CENTROID_VALUES // dim} cells; use fewer")
    picked = docs.select("id", "embedding").orderBy(F.xxhash64("id", F.lit(seed)), "id")
    sample = _matrix(picked.limit(sample_rows).toArrow()["embedding"], dim)
    if not len(sample):
        raise ValueError("no vectors to learn cells from")
    centroids = seed_cells(sample, cells, seed)
    for _ in range(rounds):
        moved = centroids.copy()
        for row in cell_sums(docs, centroids).collect():
            mean = np.frombuffer(row["sums"], np.int64) / (row["n"] * STEPS)
            length = np.linalg.norm(mean)
            if length > 0:
                moved[row["cell"]] = mean / length
        if np.array_equal(moved, centroids):
            break
        centroids = moved
    return centroids
