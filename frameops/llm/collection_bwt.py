"""Column-wise construction over a collection of aligned strings: which of their 100-byte windows are repeated.

The strings of a group share a piece of text, the anchor, and are aligned on it, so only suffixes that begin in
the same column are ever compared. Each round inserts one symbol per string, the column left of the last one:
the new column's symbols in suffix order are that column of the collection's Burrows-Wheeler transform, a stable
sort by them is the order of the longer suffixes, and the common prefix of two neighbours is one more than the
least common prefix that lay between them before. Neighbours with a common prefix of a whole window begin equal
windows.
"""

from __future__ import annotations

import numpy as np


def _range_min(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The least of ``values[first..last]`` for each pair, by a table of powers of two."""
    width = last - first + 1
    out = np.empty(len(first), dtype=values.dtype)
    level, size = values, 1
    while True:
        at = np.flatnonzero((width >= size) & (width < 2 * size))
        out[at] = np.minimum(level[first[at]], level[last[at] - size + 1])
        if not (width >= 2 * size).any():
            return out
        level = np.minimum(level[:-size], level[size:])
        size *= 2


def repeated_windows(
    symbols: np.ndarray, left: np.ndarray, right: np.ndarray, group: np.ndarray, place: np.ndarray, window: int
) -> np.ndarray:
    """A flag for each string and column: a window begins there that also begins, in this column, in a string of the
    same group that comes before it by ``place``.

    ``symbols`` has a row per string, of which columns ``left`` to ``right`` count; ``group`` is not decreasing.
    """
    n, columns = symbols.shape
    marks = np.zeros((n, columns), dtype=bool)
    order = np.empty(0, dtype=np.int64)  # strings by the suffix that begins in this column, group by group
    common = np.empty(0, dtype=np.int64)  # common prefix with the string before; 0 at a group's first
    by_right = np.argsort(right, kind="stable")
    ends = np.searchsorted(right[by_right], np.arange(columns + 1))
    for column in range(columns - 1, -1, -1):
        keep = left[order] <= column
        if not keep.all():
            at = np.flatnonzero(keep)
            if len(at):
                common = np.minimum.reduceat(common[: at[-1] + 1], np.concatenate([[0], at[:-1] + 1]))
                # A group whose first string went: the barrier stays with the next one.
                order = order[at]
            else:
                order, common = order[:0], common[:0]
        new = by_right[ends[column] : ends[column + 1]]
        if len(new):
            both = np.concatenate([new, order])
            shared = np.concatenate([np.zeros(len(new), dtype=np.int64), common])
            by_group = np.argsort(group[both], kind="stable")
            order, common = both[by_group], shared[by_group]
        if not len(order):
            continue
        key = group[order] * 256 + symbols[order, column]
        moved = np.argsort(key, kind="stable")
        key, longer = key[moved], np.zeros(len(order), dtype=np.int64)
        same = np.flatnonzero(key[1:] == key[:-1]) + 1
        if len(same):
            longer[same] = 1 + _range_min(common, moved[same - 1] + 1, moved[same])
        order, common = order[moved], longer
        starts = np.flatnonzero(common < window)
        if len(starts) < len(order):
            first = np.minimum.reduceat(place[order], starts)
            sizes = np.diff(np.append(starts, len(order)))
            again = place[order] > np.repeat(first, sizes)
            marks[order[again], column] = True
    return marks
