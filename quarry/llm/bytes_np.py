"""Vectorised work on the bytes of Arrow string columns: words, hashes, shingles.

Everything runs inside tasks on slices of one Arrow batch, so memory is bounded
by the slice (or by the longest single text).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
WHITE = b"\t\n\x0b\x0c\r "
#: Bytes of text in a slice; a longer single text makes a slice of its own.
SLICE_BYTES = 1 << 19


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows with about ``most`` bytes of text each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        ends = np.frombuffer(col.buffers()[1], np.int32, len(col) + 1, col.offset * 4).astype(np.int64)
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + most, side="right")) - 1)
            yield batch.slice(first, last - first)
            first = last


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the row bounds in them; null counts as empty."""
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    ends = np.frombuffer(col.buffers()[1], np.int32, n + 1, col.offset * 4).astype(np.int64)
    data = col.buffers()[2]
    if data is None or ends[-1] == ends[0]:
        return np.zeros(0, np.uint8), ends - ends[0]
    return np.frombuffer(data, np.uint8, ends[-1] - ends[0], ends[0]), ends - ends[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (splitmix64's finisher)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=U64))
_BASE = U64(0x9E3779B97F4A7C15)
_POW = np.cumprod(np.full(4096, _BASE, U64))


def powers(n: int) -> np.ndarray:
    """The first n powers of the hash base."""
    global _POW
    if len(_POW) < n:
        _POW = np.cumprod(np.full(1 << int(n - 1).bit_length(), _BASE, U64))
    return _POW[:n]


class Words:
    """Words of a slice: row, first byte, end, 64-bit hash; and per row the bounds in them.

    ``fold`` maps each byte to the byte that counts, 0x20 for those between words.
    """

    def __init__(self, data: np.ndarray, ends: np.ndarray, fold: np.ndarray):
        n = len(data)
        self.folded = folded = fold[data]
        inside = folded != 0x20
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        marks = ends[1:-1]
        marks = marks[marks < n]
        first[marks] = inside[marks]
        self.start = start = np.flatnonzero(first)
        rows = len(ends) - 1
        self.bounds = np.searchsorted(start, ends)
        self.row = np.repeat(np.arange(rows), np.diff(self.bounds))
        if not len(start):
            self.end, self.hash = start, np.zeros(0, U64)
            return
        word = np.cumsum(first, dtype=np.int64) - 1
        at = np.arange(n) - start[np.maximum(word, 0)]
        at[~inside] = 0
        value = _BYTE[folded] * powers(int(at.max()) + 1)[at]
        value[~inside] = 0
        self.hash = mix(np.add.reduceat(value, start))
        self.end = start + np.add.reduceat(inside.astype(np.int64), start)

    def text(self, i: int) -> bytes:
        return self.folded[self.start[i] : self.end[i]].tobytes()


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each run of ``size`` words of one row, and the number of the run's first word."""
    n = len(words.hash) - size + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    value = words.hash[:n].copy()
    for k in range(1, size):
        value = value * _BASE + words.hash[k : k + n]
    at = np.flatnonzero(words.row[:n] == words.row[size - 1 :])
    return mix(value[at]), at


def fold_table(keep: str) -> np.ndarray:
    """A byte map: ``plain`` splits at white space; ``words`` lower-cases A-Z and keeps digits, letters, non-ASCII."""
    table = np.arange(256, dtype=np.uint8)
    if keep == "plain":
        table[list(WHITE)] = 0x20
    else:
        table[:0x80] = 0x20
        table[0x30:0x3A] = np.arange(0x30, 0x3A)
        table[0x61:0x7B] = np.arange(0x61, 0x7B)
        table[0x41:0x5B] = np.arange(0x61, 0x7B)
    return table
