"""Vectorised tokens of a batch of texts: NumPy over the UTF-8 bytes of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORD_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(WORD_BASE), -1, 2 ** 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)
CHUNK_BYTES = 1 << 20

# ASCII white space separates words; A-Z fold to a-z; every other byte stays.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(
    0, 2 ** 64, 256, dtype=np.uint64, endpoint=False) | np.uint64(1)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the base and of its inverse modulo 2^64, kept per process."""
    if len(_POWERS[0]) < n:
        for i, b in enumerate((WORD_BASE, _INVERSE)):
            run = np.full(n, b, np.uint64)
            run[0] = 1
            _POWERS[i] = np.cumprod(run, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (public splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null text is an empty one."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset:column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[offsets[0]:offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes; a longer text is a range of its own."""
    at = 0
    while at < len(offsets) - 1:
        to = int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1
        to = min(max(to, at + 1), len(offsets) - 1)
        yield at, to
        at = to


def words(data: np.ndarray, offsets: np.ndarray, sep: np.ndarray = WHITE,
          fold: np.ndarray = LOWER):
    """(row, hash, start, end) of every word of the rows, in order."""
    n = len(data)
    gap = sep[data]
    first = np.zeros(n + 1, bool)
    first[offsets[:-1]] = True
    start = ~gap
    start[1:] &= gap[:-1] | first[1:n]
    starts = np.flatnonzero(start)
    if len(starts) == 0:
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none, none
    up, down = _powers(n + 1)
    value = _BYTE[fold[data]] * up[:n]
    value[gap] = 0
    total = np.add.reduceat(value, starts) * down[starts]
    inside = np.concatenate([[0], np.cumsum(~gap)])
    lengths = np.diff(np.append(inside[starts], inside[-1]))
    row = np.searchsorted(offsets, starts, "right") - 1
    return row, mix(total + lengths.astype(np.uint64) * _STEP), starts, starts + lengths


def shingles(row: np.ndarray, word: np.ndarray, n_rows: int, width: int = 5):
    """(row, hash) of the distinct ``width``-word shingles, sorted by row and hash.

    A row with fewer words is one shingle of all its words; without words it has none.
    """
    total = np.bincount(row, minlength=n_rows)
    first = np.concatenate([[0], np.cumsum(total)])
    out_row, out_hash = [], []
    if len(word) >= width:
        ok = row[:-(width - 1)] == row[width - 1:]
        acc = np.zeros(len(word) - width + 1, np.uint64)
        for k in range(width):
            acc = acc * _STEP + word[k:len(word) - width + 1 + k]
        out_row.append(row[:-(width - 1)][ok])
        out_hash.append(mix(acc[ok]))
    for r in np.flatnonzero((total > 0) & (total < width)):
        acc = int(total[r])
        for w in word[first[r]:first[r + 1]]:
            acc = (acc * int(_STEP) + int(w)) % 2 ** 64
        out_row.append(np.array([r]))
        out_hash.append(mix(np.array([acc ^ 0x5DEECE66D], np.uint64)))
    if not out_row:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    r, h = np.concatenate(out_row), np.concatenate(out_hash)
    order = np.lexsort((h, r))
    r, h = r[order], h[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
    return r[new], h[new]
