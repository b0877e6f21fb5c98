"""Words and word hashes of Arrow text columns, without a Python loop over words.

A batch is one byte buffer; word borders come from a lookup table, word hashes from
a sum of byte codes times a random factor per position, window hashes from sums of word hashes
times a factor per place. Equal words have equal hashes in every task.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_random = np.random.default_rng(20240229)
_CODE = _random.integers(1, 2**63, 256, dtype=np.uint64)
_PLACE = _random.integers(1, 2**63, 4096, dtype=np.uint64) | np.uint64(1)
_FACTOR = _random.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_FAR = np.uint64(0x9E3779B97F4A7C15)


def far(n: int) -> np.uint64:
    return np.uint64(n * 0x9E3779B97F4A7C15 % 2**64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads all bits (a 64-bit finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets


class Words:
    """Words of some texts: byte borders, the text each belongs to, the first word of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data = data = data[offsets[0] : offsets[-1]]
        if lower:
            self.data = data = LOWER[data]
        self.offsets = off = offsets - offsets[0]
        n = len(data)
        inside = ~SPACE[data]
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        begin, stop = inside.copy(), inside.copy()
        if n:
            begin[1:] &= ~inside[:-1] | edge[1:n]
            stop[:-1] &= ~inside[1:] | edge[1:n]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.start, off)
        self.doc = np.repeat(np.arange(len(off) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, np.uint64)
        lengths = self.end - self.start
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        at = np.arange(int(lengths.sum()))
        place = at - np.repeat(starts, lengths)
        codes = _CODE[self.data[place + np.repeat(self.start, lengths)]]
        codes *= _PLACE[place & 4095] + (place >> 12).astype(np.uint64) * _FAR
        return mix(np.add.reduceat(codes, starts) + lengths.astype(np.uint64) * _FAR)

    def windows(self, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First words and hashes of all windows of `size` words that lie within one text."""
        last = self.first[1:][self.doc] if len(self.doc) else self.doc
        at = np.flatnonzero(np.arange(len(hashes)) + size <= last)
        return at, window_hash(hashes, at, size)


def window_hash(hashes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    total = np.full(len(at), far(size), np.uint64)
    for j in range(size):
        total += hashes[at + j] * _FACTOR[j % 64]
        if j % 64 == 63:
            total = mix(total)
    return mix(total)


def pieces(column: pa.Array, most_bytes: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows from..to with their bytes and offsets, about `most_bytes` of text at a time (one text at least)."""
    data, offsets = buffers(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most_bytes, "right")) - 1)
        to = min(to, n)
        yield row, to, data, offsets[row : to + 1]
        row = to
