"""The two intervals that overlap another most, for many at once, without comparing pairs."""

from __future__ import annotations

import numpy as np


def two_best(s: np.ndarray, e: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each interval [s, e) the places of the two of [a, b) that overlap it most, the earlier place on ties (-1: none), and the overlaps (0: none). None is empty.

    Those that overlap are of four kinds, each with an order in which the best come first: they hold the interval (first
    place), begin in it and outlast it (earliest start), begin before it and end in it (latest end), lie in it (longest).
    Sorted by start, the ones that begin by s and those that begin within (s, e) are unions of blocks of 1, 2, 4, ..
    neighbours. In a block sorted by end each kind is a run at its head or tail, so running bests answer.
    """
    n, m = len(a), len(s)
    best, value = np.full((2, m), -1, np.int64), np.zeros((2, m), np.int64)

    def offer(rows: np.ndarray, at: np.ndarray) -> None:
        rows, at = rows[at >= 0], at[at >= 0]
        got = np.minimum(e[rows], b[at]) - np.maximum(s[rows], a[at])
        rows, at, got = rows[got > 0], at[got > 0], got[got > 0]
        first = (got > value[0, rows]) | ((got == value[0, rows]) & (at < best[0, rows]))
        second = ~first & ((got > value[1, rows]) | ((got == value[1, rows]) & (at < best[1, rows])))
        for table, new in ((best, at), (value, got)):
            table[1, rows] = np.where(first, table[0, rows], np.where(second, new, table[1, rows]))
            table[0, rows] = np.where(first, new, table[0, rows])

    if not n or not m:
        return best, value
    place = np.arange(n)
    sorted_by = {"hold": place, "outlast": np.lexsort((place, a)), "inside": np.lexsort((place, a - b))}
    rank = {kind: np.argsort(order) for kind, order in sorted_by.items()}
    by_start = sorted_by["outlast"]
    low = np.searchsorted(a[by_start], s, "right")
    lo, hi = low, np.maximum(low, np.searchsorted(a[by_start], e, "left"))
    wanted = np.unique(e)
    asked, steps = np.searchsorted(wanted, e), len(wanted) + 1
    size = 1 << (n - 1).bit_length()
    reach, owner = np.zeros(size, np.int64), np.full(size, -1)
    reach[:n], owner[:n] = np.searchsorted(wanted, b[by_start], "right"), by_start  # b >= wanted[k] exactly where reach > k
    ends = np.full(size, np.iinfo(np.int64).min + 1)
    ends[:n] = b[by_start]
    every, width = np.arange(m), 1
    while width <= size:
        block = np.arange(size) // width
        order = np.lexsort((owner, -ends, block))
        index = owner[order]
        key = block * steps + (len(wanted) - reach[order])

        def running(kind: str, backwards: bool, index=index, width=width) -> tuple[np.ndarray, np.ndarray]:
            """The best and the second of a kind from each block's head (or tail) to each position, as ranks; n: none."""
            x = np.where(index >= 0, rank[kind][index], n).reshape(-1, width)
            x = x[:, ::-1] if backwards else x
            one = np.minimum.accumulate(x, axis=1)
            two = np.minimum.accumulate(np.maximum(x, np.concatenate([np.full((len(x), 1), n), one[:, :-1]], axis=1)), axis=1)
            return tuple((v[:, ::-1] if backwards else v).ravel() for v in (one, two))

        bests = {"hold": running("hold", False), "outlast": running("outlast", False), "inside": running("inside", True)}

        def pick(kind: str, rows: np.ndarray, at: np.ndarray, bests=bests) -> None:
            for ranks in bests[kind]:
                v = ranks[at]
                offer(rows, np.where(v < n, sorted_by[kind][np.minimum(v, n - 1)], -1))

        def cut(rows: np.ndarray, blocks: np.ndarray, key=key) -> np.ndarray:
            """The position in each one's block from which ends lie before e."""
            return np.searchsorted(key, blocks * steps + (len(wanted) - asked[rows]), "left")

        def late(rows: np.ndarray, blocks: np.ndarray, width=width, cut=cut, pick=pick) -> None:
            at = cut(rows, blocks)
            some, rest = at > blocks * width, at < (blocks + 1) * width
            pick("outlast", rows[some], at[some] - 1)
            pick("inside", rows[rest], at[rest])

        rows = every[(low & width) > 0]
        blocks = low[rows] // width - 1
        at = cut(rows, blocks)
        some = at > blocks * width
        pick("hold", rows[some], at[some] - 1)
        for k in (0, 1):  # the latest ends before e
            more = at + k < (blocks + 1) * width
            offer(rows[more], index[at[more] + k])
        left = (lo < hi) & (lo % 2 == 1)
        late(every[left], lo[left])
        lo = lo + left
        right = (lo < hi) & (hi % 2 == 1)
        late(every[right], hi[right] - 1)
        lo, hi = lo // 2, (hi - right) // 2
        width *= 2
    return best, value
