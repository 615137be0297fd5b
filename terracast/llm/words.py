"""Words and shingles of Arrow text columns, computed on the UTF-8 bytes of a whole batch with numpy.

A batch is cut into runs of rows of about `SLICE` bytes, so memory follows that figure and the longest
single text. Words never cross a row. Hashes are 64-bit: a polynomial over the bytes of a word, mixed;
a shingle mixes the hashes of its words in order.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE = 1_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
ODD = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z: digits, letters and all bytes beyond ASCII
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
#: `[^\x20\x09-\x0D]+`
SPACED = np.ones(256, dtype=bool)
SPACED[[32, *range(9, 14)]] = False

_POWERS: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** i for i below n (at least), modulo 2 ** 64."""
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        size = max(1024, 1 << (int(n) - 1).bit_length())
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= 1 << 23:  # a very long text doesn't leave its table behind
            _POWERS[int(base)] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


@dataclass
class Words:
    """Words of `rows` texts: byte range and text number of each, over `data` (lower-cased)."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    rows: int

    def hashes(self) -> np.ndarray:
        n = len(self.data) + 1
        prefix = np.zeros(n, dtype=np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * _powers(BASE, n)[: n - 1], out=prefix[1:])
        return mix((prefix[self.end] - prefix[self.start]) * _powers(INVERSE, n)[self.start])

    def counts(self) -> np.ndarray:
        """Words per text."""
        return np.bincount(self.row, minlength=self.rows).astype(np.int64)

    def word(self, i: int) -> str:
        return self.data[self.start[i]:self.end[i]].tobytes().decode("utf-8", "replace")


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, dtype=kind)[column.offset:column.offset + len(column) + 1].astype(np.int64) if offsets and len(column) else np.zeros(len(column) + 1, np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8)), at


def runs(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows of about `limit` bytes."""
    data, at = buffers(column)
    first, rows = 0, len(at) - 1
    while first < rows:
        end = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        yield first, end, data[at[first]:at[end]], at[first:end + 1] - at[first]
        first = end


def split(data: np.ndarray, at: np.ndarray, letters: np.ndarray, lower: bool = True) -> Words:
    """Words of the texts that lie in `data` between the offsets `at`."""
    data = LOWER[data] if lower else data
    inside = letters[data]
    n = len(data)
    edge = np.zeros(n + 1, dtype=bool)  # a text begins here
    edge[at] = True
    before = np.zeros(n, dtype=bool)
    before[1:] = inside[:-1]
    before &= ~edge[:n]
    after = np.zeros(n, dtype=bool)
    after[:-1] = inside[1:]
    after &= ~edge[1:]
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return Words(data, start, end, np.searchsorted(at, start, "right") - 1, len(at) - 1)


def shingles(hashes: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of every run of `size` words within a text."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(row[:n] == row[size - 1:])
    total = np.full(len(at), np.uint64(size), dtype=np.uint64)
    for k in range(size):
        total = (total ^ hashes[at + k]) * ODD[k % len(ODD)]
        total ^= total >> np.uint64(29)
    return at, mix(total)
