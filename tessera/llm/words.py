"""Words and word shingles of Arrow text columns, hashed with numpy straight from the column's bytes.

A word is a maximal run of characters other than space and U+0009 to U+000D. Hashes are 64-bit and depend on the
word's bytes alone, so every executor and every run agrees on them.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LANES = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)
#: Bytes of text worked on at a time, unless one text alone is longer.
CHUNK_BYTES = 500_000
_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def give_back() -> None:
    """At a task's end: the worker lives on beside the executor's next tasks, and what it has freed goes back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            factors = np.full(n, base, dtype=np.uint64)
            factors[0] = 1
            _powers[k] = np.cumprod(factors)
    return _powers[0][:n], _powers[1][:n]


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return data, offsets


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with up to `most` bytes; a longer text is a range of its own."""
    n, at = len(offsets) - 1, 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        end = min(max(end, at + 1), n)
        yield at, end
        at = end


class Words:
    """The words of consecutive rows: `start` and `end` in bytes from the first row's first, `row` from 0, and `count` and `first` by row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        base = offsets[0]
        self.data = data[base : offsets[-1]]
        self.offsets = offsets - base
        n = len(self.data)
        inside = ~_SEPARATOR[self.data]
        begins = inside.copy()
        if n:
            begins[1:] &= ~inside[:-1]
            firsts = self.offsets[:-1][self.offsets[:-1] < n]
            begins[firsts] = inside[firsts]
            ends = inside.copy()
            ends[:-1] &= ~inside[1:]
            lasts = self.offsets[1:][self.offsets[1:] > 0] - 1
            ends[lasts] = inside[lasts]
            self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        else:
            self.start = self.end = np.zeros(0, dtype=np.int64)
        self.first = np.searchsorted(self.start, self.offsets[:-1])
        self.count = np.searchsorted(self.start, self.offsets[1:]) - self.first
        self.row = np.repeat(np.arange(len(self.count)), self.count)

    def hashes(self) -> np.ndarray:
        n = len(self.data)
        power, inverse = _power_tables(n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * inverse[self.start])

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, hash) of every window of `width` words; a row with fewer words has none."""
        h = self.hashes()
        n = max(len(h) - width + 1, 0)
        out = np.zeros(n, dtype=np.uint64)
        for k in range(width):
            out += h[k : k + n] * _LANES[k]
        whole = self.row[:n] == self.row[width - 1 :] if n else np.zeros(0, dtype=bool)
        return np.flatnonzero(whole), mix(out[whole])

    def shingles(self, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
        """(row, hash), ordered by row, of every shingle; a row with fewer words than `width` has one, of all it has."""
        at, h = self.windows(width)
        rows = self.row[at]
        few = np.flatnonzero((self.count > 0) & (self.count < width))
        if len(few):
            all_h = self.hashes()
            short = np.zeros(len(few), dtype=np.uint64)
            for k in range(width - 1):
                has = self.count[few] > k
                short[has] += all_h[self.first[few[has]] + k] * _LANES[k]
            rows, h = np.concatenate([rows, few]), np.concatenate([h, mix(short)])
            order = np.argsort(rows, kind="stable")
            rows, h = rows[order], h[order]
        return rows, h


def distinct(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, value), ordered by both."""
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    keep = np.ones(len(rows), dtype=bool)
    keep[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
    return rows[keep], values[keep]


def sums_by_row(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many set bytes each row has."""
    total = np.zeros(len(mask) + 1, dtype=np.int64)
    np.cumsum(mask, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]
