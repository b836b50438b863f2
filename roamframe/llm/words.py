"""Hashes of words and word shingles, worked out for a whole batch of texts at once."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20260101)
#: A random 64-bit value per byte; A-Z share those of a-z.
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_ORDER = _RNG.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers_up_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    for i, base in enumerate((_BASE, _INVERSE)):
        if len(_powers[i]) < n:
            p = np.full(n, base, dtype=np.uint64)
            p[0] = 1
            _powers[i] = np.cumprod(p, dtype=np.uint64)
    return _powers[0], _powers[1]


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column without nulls, and the row borders in them."""
    n = len(column)
    borders = np.frombuffer(column.buffers()[1], dtype=np.int32, count=n + column.offset + 1)[column.offset :].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[borders[0] : borders[-1]], borders - borders[0]


def words_in(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, start, end) of each word: a run of bytes other than white space, A-Z as a-z."""
    n = len(data)
    if not n:
        nothing = np.zeros(0, dtype=np.int64)
        return nothing.astype(np.uint64), nothing, nothing, nothing
    inside = ~_SPACE[data]
    fresh = np.zeros(n + 1, dtype=bool)
    fresh[borders] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | fresh[1:n]
    ends[:-1] &= ~inside[1:] | fresh[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = _powers_up_to(n)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * up[:n], out=sums[1:])
    hashes = mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    return hashes, np.searchsorted(borders, start, side="right") - 1, start, end


def shingle_sets(data: np.ndarray, borders: np.ndarray, size: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, borders): per row its distinct ``size``-word shingles, sorted.

    A row of fewer words has its whole sequence as the one shingle; a row without words has none.
    """
    hashes, row, _, _ = words_in(data, borders)
    rows, m = len(borders) - 1, len(hashes)
    per_row = np.bincount(row, minlength=rows)
    whole = max(0, m - size + 1)
    value = np.zeros(whole, dtype=np.uint64)
    for i in range(size):
        value += hashes[i : i + whole] * _ORDER[i]
    full = row[:whole] == row[size - 1 :] if whole else np.zeros(0, dtype=bool)
    value, owner = mixed(value[full]), row[:whole][full]
    first = np.concatenate([[0], np.cumsum(per_row)])
    for r in np.flatnonzero((per_row > 0) & (per_row < size)):
        part = hashes[first[r] : first[r + 1]]
        short = mixed((part * _ORDER[: len(part)]).sum(dtype=np.uint64, keepdims=True) + _ORDER[size + len(part)])
        at = np.searchsorted(owner, r)
        value, owner = np.insert(value, at, short), np.insert(owner, at, r)
    edges = np.searchsorted(owner, np.arange(rows + 1))
    for a, b in zip(edges[:-1], edges[1:]):
        value[a:b].sort()
    keep = np.ones(len(value), dtype=bool)
    keep[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[keep], owner[keep]
    return value, np.searchsorted(owner, np.arange(rows + 1))
