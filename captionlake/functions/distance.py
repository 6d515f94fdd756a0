"""Edit distance of long sequences: bit vectors of a diagonal band.

A column of the table of distances is kept as the differences between its neighbouring cells: one number with a bit for each cell that is
one more than the cell above it, and one for each that is one less (Myers, 1999; Hyyrö, 2003). A column follows from the one before by
a dozen operations on these numbers. Only a band of diagonals around the main one is kept, and it moves down a row with each
column; a distance up to the band's half width is exact. A band that turns out too narrow is left at once for a wider one, of the width
that the edits so far let expect; where that is not much less than the whole column, whole columns are kept.
"""

from __future__ import annotations

from collections.abc import Hashable, Sequence

import numpy as np
import pandas as pd

from captionlake.functions.udf import vectorised

FIRST_BAND = 64
#: Columns for which the places of the symbols are looked up at once.
STRIP = 4096


def _coded(left: Sequence[Hashable], right: Sequence[Hashable]) -> tuple[np.ndarray, np.ndarray]:
    codes = {k: i for i, k in enumerate(dict.fromkeys([*left, *right]))}
    return tuple(np.fromiter((codes[x] for x in side), np.int64, len(side)) for side in (left, right))


def _trimmed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both without their equal beginnings and ends."""
    n = min(len(a), len(b))
    other = np.flatnonzero(a[:n] != b[:n])
    lo = int(other[0]) if len(other) else n
    a, b, n = a[lo:], b[lo:], n - lo
    other = np.flatnonzero(a[::-1][:n] != b[::-1][:n])
    hi = int(other[0]) if len(other) else n
    return a[: len(a) - hi], b[: len(b) - hi]


def _places(rows: np.ndarray, wanted: np.ndarray) -> dict[int, int]:
    """For each wanted symbol a number with the bits of the rows that hold it."""
    order = np.argsort(rows, kind="stable")
    begin, finish = np.searchsorted(rows[order], wanted, "left"), np.searchsorted(rows[order], wanted, "right")
    out = {}
    for symbol, lo, hi in zip(wanted.tolist(), begin.tolist(), finish.tolist(), strict=True):
        if lo < hi:
            bits = np.zeros(len(rows), np.uint8)
            bits[order[lo:hi]] = 1
            out[symbol] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    return out


def _whole(a: np.ndarray, b: np.ndarray) -> int:
    """The distance by whole columns."""
    every, last = (1 << len(a)) - 1, len(a) - 1
    up, down, far = every, 0, len(a)
    for left in range(0, len(b), STRIP):
        columns = b[left : left + STRIP]
        places = _places(a, np.unique(columns))
        for symbol in columns.tolist():
            equal = places.get(symbol, 0)
            same = ((equal & up) + up) ^ up | equal | down
            right_up = (down | ~(same | up)) & every
            right_down = same & up
            far += (right_up >> last & 1) - (right_down >> last & 1)
            step = right_up << 1 | 1
            up = (right_down << 1 | ~(same | step)) & every
            down = step & same & every
    return far


def _banded(a: np.ndarray, b: np.ndarray, half: int) -> tuple[int, int]:
    """The least number of edits along paths within ``half`` diagonals of the main one, and the columns done: fewer than all where it is over ``half``.

    Bit i of column j stands for row j - half + i. Rows above the first are as far from it as they are numbered, rows below the last match
    nothing; neither is on a shortest path.
    """
    m, n = len(a), len(b)
    width = 2 * half + 1
    every, lowest, middle = (1 << width) - 1, 1 << (width - 1), 1 << half
    up = every ^ ((1 << (half + 1)) - 1)  # column 0: rows 1 and more are one more than the row above
    down = (1 << (half + 1)) - 1
    far, most = 0, half + abs(m - n)  # the main diagonal's numbers never fall, and end near the distance
    for left in range(0, n, STRIP):
        columns = b[left : left + STRIP]
        # the rows that this strip's columns reach; bit 0 is row left + 1 - half
        first = left + 1 - half
        reach = np.full(len(columns) - 1 + width, -1, np.int64)
        lo, hi = max(first, 1), min(first + len(reach), m + 1)
        if lo < hi:
            reach[lo - first : hi - first] = a[lo - 1 : hi - 1]
        places = _places(reach, np.unique(columns))
        for at, symbol in enumerate(columns.tolist()):
            up, down = up >> 1 | lowest, down >> 1  # the window moves down a row
            equal = places.get(symbol, 0) >> at & every
            same = (((equal & up) + up) ^ up | equal | down) & every  # cells equal to the one diagonally before
            right_up = down | every ^ (same | up)
            right_down = same & up
            if not same & middle:
                far += 1
                if far > most:
                    return far, left + at + 1
            step = right_up << 1 | 1
            up = (right_down << 1 | every ^ (same | step) & every) & every
            down = step & same
    # from the cell of the main diagonal to the one in row m of the last column
    if m > n:
        part = ((1 << (m - n)) - 1) << (half + 1)
        far += (up & part).bit_count() - (down & part).bit_count()
    elif m < n:
        part = ((1 << (n - m)) - 1) << (half + 1 - (n - m))
        far -= (up & part).bit_count() - (down & part).bit_count()
    return far, n


def edit_distance(left: Sequence[Hashable], right: Sequence[Hashable]) -> int:
    """Least insertions, deletions and changes that turn one sequence into the other."""
    a, b = _trimmed(*_coded(left, right))
    if not len(a) or not len(b):
        return len(a) + len(b)
    half = max(FIRST_BAND, 2 * abs(len(a) - len(b)))
    while 2 * half < len(a):
        far, done = _banded(a, b, half)
        if far <= half:
            return far
        half = max(2 * half, far * len(b) // done * 9 // 8)
    return _whole(a, b)


@vectorised("double")
def token_error_rate(reference: pd.Series, hypothesis: pd.Series) -> pd.Series:
    """Edit distance of token arrays over the reference's length; of an empty reference 1 where the hypothesis has tokens."""
    return pd.Series([edit_distance(a, b) / len(a) if len(a) else float(len(b) > 0) for a, b in zip(reference, hypothesis, strict=True)])


@vectorised("long")
def text_distance(left: pd.Series, right: pd.Series) -> pd.Series:
    """Edit distance of texts by code point; null where one is null."""
    return pd.Series([None if a is None or b is None else edit_distance(a, b) for a, b in zip(left, right, strict=True)], dtype="Int64")
