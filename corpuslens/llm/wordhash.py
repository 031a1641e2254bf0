"""Words and word n-grams of Arrow string columns as numpy arrays.

A batch is read as one byte array: word borders come from a table of byte classes and the
64-bit hash of every word from one running sum, so no Python object is made per word.
A word is a longest run of ASCII letters, digits, ``_`` and bytes of non-ASCII characters.
"""

from __future__ import annotations

import sys
import types
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BLOCK = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _byte_codes() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def worker_cache() -> dict:
    """What one process keeps between tasks. It hangs on the interpreter, as functions of
    this package travel with each job and bring their globals along."""
    return sys.modules.setdefault("_corpuslens_cache", types.ModuleType("_corpuslens_cache")).__dict__


class Tables:
    """Lookup arrays, built once in each Python worker."""

    def __init__(self):
        self.word = np.zeros(256, dtype=bool)
        for first, last in ((48, 57), (65, 90), (95, 95), (97, 122), (128, 255)):
            self.word[first : last + 1] = True
        self.codes = _byte_codes()
        self.size = _BLOCK + 1
        self.grow(self.size)

    def grow(self, n: int) -> None:
        self.size = n
        self.pow = _powers(_BASE, n)
        self.inverse = _powers(pow(_BASE, -1, 1 << 64), n)

    @classmethod
    def get(cls) -> Tables:
        held = worker_cache()
        if "tables" not in held:
            held["tables"] = cls()
        return held["tables"]


class Words(NamedTuple):
    """``hashes[bounds[i]:bounds[i + 1]]`` are the words of row i; starts and ends are byte
    offsets into ``data``; row i is ``data[offsets[i]:offsets[i + 1]]``."""

    hashes: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray
    offsets: np.ndarray


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows and where each row begins; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs of True that lie in one row, and the run number
    at which each row begins."""
    n = len(inside)
    before, after = np.empty(n, bool), np.empty(n, bool)
    if n:
        before[0] = after[-1] = False
        before[1:], after[:-1] = inside[:-1], inside[1:]
        before[offsets[offsets < n]] = False
        after[offsets[offsets > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges in ascending order."""
    tables = Tables.get()
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _BLOCK, "right")))
        low, high = starts[i], ends[j - 1]
        if high - low >= tables.size:
            tables.grow(int(high - low) + 1)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(tables.codes[data[low:high]] * tables.pow[: high - low], out=sums[1:])
        a, b = starts[i:j] - low, ends[i:j] - low
        out[i:j] = mix((sums[b] - sums[a]) * tables.inverse[a] + (b - a).astype(np.uint64))
        if tables.size > _BLOCK + 1:
            tables.grow(_BLOCK + 1)
        i = j
    return out


def words(column: pa.Array | pa.ChunkedArray, lower: bool = True) -> Words:
    """Hashed words of every row, in order."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    data, offsets = utf8(pc.utf8_lower(column) if lower else column)
    starts, ends, bounds = runs(Tables.get().word[data], offsets)
    return Words(hash_runs(data, starts, ends), bounds, starts, ends, data, offsets)


def ngrams(hashes: np.ndarray, bounds: np.ndarray, n: int, whole_short: bool = True):
    """Hashes of all runs of n words inside a row: (hash, row, first word), by row and place.

    A row of fewer words has one n-gram of all its words if ``whole_short``, else none.
    """
    counts = np.diff(bounds)
    total = len(hashes)
    full = np.maximum(counts - n + 1, 0)
    rows = np.repeat(np.arange(len(counts)), full)
    first = np.arange(full.sum()) - np.repeat(np.cumsum(full) - full, full) + np.repeat(bounds[:-1], full)
    gram = np.zeros(len(first), np.uint64)
    if total:
        for k in range(n):
            gram = gram * np.uint64(_BASE) + hashes[first + k]
    gram = mix(gram)
    if whole_short:
        short = np.flatnonzero((counts > 0) & (counts < n))
        if len(short):
            extra = np.zeros(len(short), np.uint64)
            for k in range(n - 1):
                has = counts[short] > k
                extra[has] = extra[has] * np.uint64(_BASE) + hashes[bounds[short[has]] + k]
            gram = np.concatenate([gram, mix(extra ^ counts[short].astype(np.uint64))])
            rows = np.concatenate([rows, short])
            first = np.concatenate([first, bounds[short]])
            order = np.argsort(rows, kind="stable")
            gram, rows, first = gram[order], rows[order], first[order]
    return gram, rows, first


def row_counts(gram: np.ndarray, rows: np.ndarray, n_rows: int):
    """Distinct (row, hash) with their counts, sorted by row: (hash, row, count, row bounds)."""
    keys = mix(gram ^ mix(rows.astype(np.uint64)))
    bounds = np.searchsorted(rows, np.arange(n_rows + 1))
    order = np.empty(len(gram), np.int64)
    for i in range(n_rows):
        a, b = bounds[i], bounds[i + 1]
        if b > a:
            order[a:b] = np.argsort(keys[a:b]) + a
    keys = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(keys)))
    pick = order[at]
    return gram[pick], rows[pick], counts, np.searchsorted(rows[pick], np.arange(n_rows + 1))


def slices(column: pa.Array | pa.ChunkedArray, size: int = 4 << 20):
    """Cut a column into runs of rows of about ``size`` bytes: (first row, part)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, first = np.cumsum(lengths), 0
    while first < len(column):
        low = ends[first] - lengths[first]
        last = max(first + 1, int(np.searchsorted(ends, low + size, "right")))
        yield first, column.slice(first, last - first)
        first = last
