"""Whole Arrow string columns as numpy arrays: bytes, words, word hashes.

A column arrives as one byte buffer with row offsets. Everything here works on
that buffer, so no Python object is made per word. ``pieces`` cuts a batch by
bytes first, which bounds the memory of a task whatever the batch size; one
text is never cut.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 19

#: Words are runs of 0-9, a-z and bytes from 0x80 after A-Z is lower-cased.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < size:
        for at, base in enumerate((_BASE, _BASE_INVERSE)):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            _powers[at] = np.cumprod(table, dtype=np.uint64)
    return _powers[0], _powers[1]


def pieces(column: pa.Array, most: int = PIECE_BYTES):
    """Slices of about ``most`` bytes, at least one row each."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    start = 0
    while start < len(column):
        stop = int(np.searchsorted(ends, ends[start] + most, side="right")) - 1
        stop = min(max(stop, start + 1), len(column))
        yield column.slice(start, stop - start)
        start = stop


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows, and where each row starts (one more entry than rows)."""
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


class Words:
    """Words of a piece: ``starts``, ``ends`` (bytes), ``row``, ``first`` (word number where each row starts)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = _LOWER[data]
        inside = np.zeros(len(data) + 2, dtype=bool)
        inside[1:-1] = _IS_WORD[self.data]
        opens = inside[1:-1] & ~inside[:-2]
        closes = inside[1:-1] & ~inside[2:]
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(data))]
        opens[edges] = inside[1:-1][edges]
        closes[edges - 1] = inside[1:-1][edges - 1]
        self.starts = np.flatnonzero(opens)
        self.ends = np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)
        self.row = np.repeat(np.arange(len(offsets) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word: a polynomial of its bytes, shifted to start at zero."""
        power, inverse = _power_tables(len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, dtype=np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * power[:len(self.data)], out=total[1:])
        return mix((total[self.ends] - total[self.starts]) * inverse[self.starts])


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of ``size`` neighbours; entry i starts at word i and may run over a row's end."""
    if len(hashes) < size:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(len(hashes) - size + 1, dtype=np.uint64)
    for at in range(size):
        out = out * _BASE + hashes[at:len(hashes) - size + 1 + at]
    return mix(out)


def sequence_hash(hashes: np.ndarray) -> int:
    """One 64-bit hash of a whole sequence."""
    power, _ = _power_tables(len(hashes) + 1)
    return int(mix((hashes * power[1:len(hashes) + 1]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(hashes)))[0])


def whole_rows(row: np.ndarray, size: int) -> np.ndarray:
    """Which entries of ``shingles`` stay inside one row."""
    return row[:len(row) - size + 1] == row[size - 1:] if len(row) >= size else np.zeros(0, dtype=bool)
