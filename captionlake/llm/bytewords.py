"""Words, lines and their 64-bit hashes from whole Arrow text columns, with numpy only.

A word is a longest run of bytes outside space and 0x09-0x0D (the pattern ``[^\\x20\\x09-\\x0D]+``: every
separator is one ASCII byte, so the UTF-8 bytes give the same words as the characters).
Texts are taken in chunks of about CHUNK bytes; a longer text is a chunk of its own, never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK + (CHUNK >> 2))
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        tables = []
        for base in (_BASE, inverse):
            t = np.full(size, base, np.uint64)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        _powers[:] = tables
    return _powers[0], _powers[1]


@dataclass
class Chunk:
    """Rows lo..hi of a batch: their bytes and, for each row, where its bytes begin (one more than rows)."""

    lo: int
    hi: int
    data: np.ndarray
    offs: np.ndarray

    def __post_init__(self) -> None:
        n = len(self.data)
        power, self._inverse = _power_tables(n + 1)
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * power[:n], out=self._sums[1:])
        self.space = _SPACE[self.data]

    @property
    def rows(self) -> int:
        return self.hi - self.lo

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit hash of data[start:end] for each pair; equal bytes have equal hashes."""
        raw = (self._sums[end] - self._sums[start]) * self._inverse[start]
        return mix(raw + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """start and end of every word, and for each row the index of its first word (one more than rows)."""
        n = len(self.data)
        edge = np.zeros(n + 1, bool)
        edge[self.offs] = True
        solid = ~self.space
        before = np.ones(n, bool)
        before[1:] = self.space[:-1]
        start = np.flatnonzero(solid & (before | edge[:n]))
        after = np.ones(n, bool)
        after[:-1] = self.space[1:]
        end = np.flatnonzero(solid & (after | edge[1:])) + 1
        return start, end, np.searchsorted(start, self.offs)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """start and end of every \\n-split line, and for each row the index of its first line."""
        feeds = np.flatnonzero(self.data == 10)
        start = np.sort(np.concatenate([self.offs[:-1], feeds + 1]), kind="stable")
        end = np.sort(np.concatenate([self.offs[1:], feeds]), kind="stable")
        n = np.searchsorted(feeds, self.offs)
        return start, end, n + np.arange(len(self.offs))

    def per_row(self, flags: np.ndarray) -> np.ndarray:
        """How many of the bytes flagged true each row has."""
        total = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.offs[1:]] - total[self.offs[:-1]]


def chunks(column: pa.Array, lower: bool = False, size: int = CHUNK) -> Iterator[Chunk]:
    """Chunks of a text column; null counts as empty. lower: A-Z become a-z."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + size, side="right")) - 1)
        part = data[offs[lo] : offs[hi]]
        yield Chunk(lo, hi, _LOWER[part] if lower else part, offs[lo : hi + 1] - offs[lo])
        lo = hi


def row_of(first: np.ndarray) -> np.ndarray:
    """The row of each item, from the index of each row's first item."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k words in a row (across row borders too; the caller masks those)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = mix(out + words[i : i + n] + np.uint64(0x9E3779B97F4A7C15))
    return out
