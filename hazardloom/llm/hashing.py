"""Vectorised 64-bit hashing for Arrow tasks."""

from __future__ import annotations

import numpy as np

#: Fixed constants of a public 64-bit hash (xxHash64).
_P1, _P2, _P3 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_P4, _P5 = (np.uint64(x) for x in (0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def mix(value: np.ndarray, seed) -> np.ndarray:
    """64-bit hash of ``value`` under ``seed`` (uint64, wraps around)."""
    with np.errstate(over="ignore"):
        h = (np.asarray(seed, np.uint64) + _P5 + np.uint64(8)) ^ (_rotl(value * _P2, 31) * _P1)
        h = _rotl(h, 27) * _P1 + _P4
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        return h ^ (h >> np.uint64(32))


def lists(batch, column: int) -> tuple[np.ndarray, np.ndarray]:
    """(values as uint64, offsets from 0) of a list<long> column."""
    found = batch.column(column)
    offsets = np.asarray(found.offsets, np.int64)
    values = found.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    return values.astype(np.int64, copy=False).view(np.uint64), offsets - offsets[0]


def pieces(batch, column: int, most: int):
    """Slices of a batch that hold about ``most`` list values each."""
    ends = np.asarray(batch.column(column).offsets, np.int64)[1:]
    cut = np.flatnonzero(np.diff((ends - ends[0]) // most, prepend=0)) if len(ends) else []
    bounds = [0, *[int(c) for c in cut], batch.num_rows]
    for a, b in zip(bounds, bounds[1:]):
        if b > a:
            yield batch.slice(a, b - a)
