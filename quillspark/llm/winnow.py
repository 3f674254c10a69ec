"""Content-chosen anchors: equal windows of words choose equal anchors."""

from __future__ import annotations

import numpy as np

from . import hashing as H


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w values, by doubling."""
    out, size = x, 1
    while size < w:
        step = min(size, w - size)
        out = np.minimum(out[: len(out) - step], out[step:])
        size += step
    return out


def anchors(words: np.ndarray, bounds: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Group all windows of ``window`` words by the least k-gram in them, leftmost if tied.

    Returns for each group of neighbouring windows with the same anchor: first window, number of windows,
    anchor hash, and row.  Every window of every row is in exactly one group.
    """
    w = window - k + 1
    none = np.zeros(0, np.int64)
    n = len(words) - window + 1
    if n <= 0:
        return none, none, np.zeros(0, H.U64), none
    g = H.grams(words, k)
    least = sliding_min(g, w)
    # Leftmost place of the minimum: the first of w shifts that equals it.
    place = np.full(n, -1, np.int64)
    for j in range(w - 1, -1, -1):
        same = g[j : j + n] == least
        place[same] = j
    place += np.arange(n)
    row_of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    valid = row_of[:n] == row_of[window - 1 :]
    starts = np.flatnonzero(valid)
    if not len(starts):
        return none, none, np.zeros(0, H.U64), none
    at, row = place[starts], row_of[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    return starts[first], np.diff(np.append(first, len(starts))), least[starts[first]], row[first]


def contents(words: np.ndarray, first: np.ndarray, count: np.ndarray, window: int) -> np.ndarray:
    """Hash of the words that each group of windows spans."""
    last, out = first + count + window - 1, None
    out = count.astype(H.U64)
    for j in range(int(count.max(initial=0)) + window - 1):
        at = first + j
        out = np.where(at < last, out * H.U64(0xD1342543DE82EF95) + words[np.minimum(at, len(words) - 1)], out)
    return H.mix(out)
