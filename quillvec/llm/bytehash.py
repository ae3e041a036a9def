"""Rolling hashes over the bytes of many texts at once, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)
_POWERS: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all bits."""
    x = (x ^ (x >> _S)) * _M1
    x = (x ^ (x >> _S)) * _M2
    return x ^ (x >> _S)


def _powers(base: int, n: int) -> np.ndarray:
    """``base ** i`` modulo 2**64 for i below n, kept for the next call."""
    held = _POWERS.get(base)
    if held is None or len(held) < n:
        size = 1 << max(20, int(n - 1).bit_length())
        held = np.ones(size, dtype=np.uint64)
        step = 1
        while step < size:
            held[step : 2 * step] = held[:step] * np.uint64(pow(base, step, 1 << 64))
            step *= 2
        if size <= 1 << 21:
            _POWERS[base] = held
    return held[:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums of ``byte * base ** place`` over every prefix, modulo 2**64."""
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data)), out=sums[1:])
    return sums


def spans(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each ``data[start:end]``; equal bytes give equal hashes wherever they stand."""
    return (sums[ends] - sums[starts]) * _powers(_INVERSE, len(sums))[starts]


def windows(sums: np.ndarray, width: int) -> np.ndarray:
    """Hash of every stretch of ``width`` bytes."""
    n = len(sums) - width
    return (sums[width:] - sums[:n]) * _powers(_INVERSE, n) if n > 0 else sums[:0]


def chunks(items: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of ``items`` of about ``most`` bytes; a longer item stands alone."""
    start, held = 0, 0
    for i, item in enumerate(items):
        if held and held + len(item) > most:
            yield start, i
            start, held = i, 0
        held += len(item) + 1
    if start < len(items):
        yield start, len(items)
