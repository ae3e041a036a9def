"""Which documents a query looks at in approximate search.

A rule gives queries and documents keys, and brings those with a common key
together: ``meetings`` yields, for a block of documents, groups of query rows and
document rows that are scored as one small product. Nothing is computed for pairs
without a common key, candidate pairs never become rows, and no bucket, however
full, is gathered anywhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

#: Pairs of a group from which one product of matrices pays.
SMALL_GROUP = 2048

#: Rows of queries, rows of documents, and which of these pairs count (all if None).
Meeting = tuple[np.ndarray, np.ndarray, np.ndarray | None]


def _lists(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows ordered by key, the keys that occur, and where the rows of each begin and end."""
    order = np.argsort(keys, kind="stable")
    found, first = np.unique(keys[order], return_index=True)
    return order, found, np.append(first, len(keys))


def md5_planes(tables: int, bits: int, dim: int) -> np.ndarray:
    """``(tables, bits, dim)`` array of +1/-1, from the first hex digit of an MD5."""

    def sign(t: int, b: int, d: int) -> float:
        return 1.0 if hashlib.md5(f"{t}:{b}:{d}".encode()).hexdigest()[0] >= "8" else -1.0

    return np.array(
        [[[sign(t, b, d) for d in range(dim)] for b in range(bits)] for t in range(tables)]
    )


@dataclass
class HyperplaneHash:
    """Documents sharing a sign pattern with the query in at least one table."""

    tables: int
    bits: int
    dim: int
    planes: np.ndarray = field(init=False, repr=False)

    def __post_init__(self) -> None:
        self.planes = md5_planes(self.tables, self.bits, self.dim)

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """``(tables, rows)`` bucket numbers, in the narrowest type that holds them."""
        weights = 1 << np.arange(self.bits)
        flat = self.planes.reshape(-1, self.dim)
        side = vectors @ flat.T >= 0
        codes = side.reshape(len(vectors), self.tables, self.bits) @ weights
        return np.ascontiguousarray(codes.T.astype(np.min_scalar_type((1 << self.bits) - 1)))

    query_keys = codes
    document_keys = codes

    def query_lists(self, query_keys: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        """Per table, query rows listed by code; made once for all blocks."""
        return [_lists(codes) for codes in query_keys]

    def meetings(
        self, query_keys: np.ndarray, lists: list, document_keys: np.ndarray
    ) -> Iterator[Meeting]:
        """Groups with a common code; a pair counts in the first table that brings it together."""
        for t, (mine, codes, begins) in enumerate(lists):
            rows, theirs, starts = _lists(document_keys[t])
            at = np.searchsorted(codes, theirs)
            known = at < len(codes)
            known[known] = codes[at[known]] == theirs[known]
            for i in np.flatnonzero(known).tolist():
                q = mine[begins[at[i]] : begins[at[i] + 1]]
                d = rows[starts[i] : starts[i + 1]]
                new = None
                for before in range(t):
                    met = query_keys[before][q][:, None] != document_keys[before][d][None, :]
                    new = met if new is None else new & met
                yield q, d, new

    def sparse(self, lists: list, documents: int) -> bool:
        """Whether lists meet in groups so small that single pairs are the better unit."""
        groups = sum(len(codes) for _, codes, _ in lists)
        pairs = sum(len(mine) for mine, _, _ in lists) * documents / (1 << self.bits)
        return pairs < SMALL_GROUP * groups

    def pairs(
        self, query_keys: np.ndarray, lists: list, document_keys: np.ndarray
    ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The pairs of all meetings as two arrays per table, each pair once."""
        for t, (mine, codes, begins) in enumerate(lists):
            at = np.searchsorted(codes, document_keys[t])
            at[at == len(codes)] = 0
            met = codes[at] == document_keys[t] if len(codes) else np.zeros(len(at), dtype=bool)
            n = np.where(met, begins[at + 1] - begins[at], 0) if len(codes) else np.zeros(len(at), int)
            d = np.repeat(np.arange(len(at)), n)
            within = np.arange(len(d)) - np.repeat(np.cumsum(n) - n, n)
            q = mine[np.repeat(begins[at], n) + within] if len(d) else d
            new = np.ones(len(d), dtype=bool)
            for before in range(t):
                new &= query_keys[before][q] != document_keys[before][d]
            yield q[new], d[new]


@dataclass
class NearestCells:
    """Documents whose nearest centroid is among the query's ``probes`` nearest.

    ``centroids`` has one row per cell; ties go to the lower row number.
    """

    centroids: np.ndarray
    probes: int

    def _ranked(self, vectors: np.ndarray, count: int) -> np.ndarray:
        scores = vectors @ self.centroids.T
        return np.argsort(-scores, axis=1, kind="stable")[:, :count]

    def query_keys(self, vectors: np.ndarray) -> np.ndarray:
        """``(cells, rows)`` flags: does the query visit the cell."""
        visits = np.zeros((len(vectors), len(self.centroids)), dtype=bool)
        np.put_along_axis(visits, self._ranked(vectors, self.probes), True, axis=1)
        return visits.T

    def document_keys(self, vectors: np.ndarray) -> np.ndarray:
        return self._ranked(vectors, 1).T

    def query_lists(self, query_keys: np.ndarray) -> list[np.ndarray]:
        """Per cell, the queries that visit it."""
        return [np.flatnonzero(visits) for visits in query_keys]

    def sparse(self, lists: list, documents: int) -> bool:
        return False

    def meetings(
        self, query_keys: np.ndarray, lists: list, document_keys: np.ndarray
    ) -> Iterator[Meeting]:
        rows, cells, starts = _lists(document_keys[0])
        for i, cell in enumerate(cells.tolist()):
            if len(lists[cell]):
                yield lists[cell], rows[starts[i] : starts[i + 1]], None
