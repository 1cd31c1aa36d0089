"""A packed R-tree over count vectors, joined with itself to find sets that may overlap enough.

A set's elements are hashed into groups; the counts of its elements in each group are its point. Two sets share at most
the sum over groups of the smaller count, and the sets below two boxes at most that sum over the boxes' upper corners. The bound, and the sizes,
prune pairs of boxes and points alike. Nothing that could reach the required overlap is ever pruned, but for pairs that are linked already.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np

FAN_OUT = 16
#: Pairs of boxes opened together.
OPENED = 64


def count_vector(hashes: np.ndarray, groups: int) -> np.ndarray:
    """Counts in a power of two of groups, by the hashes' low bits."""
    return np.bincount((hashes & np.uint64(groups - 1)).astype(np.int64), minlength=groups).astype(np.int32)


def folded(counts: np.ndarray, groups: int) -> np.ndarray:
    """Finer count vectors (one, or one in each row) brought down to fewer groups."""
    return counts.reshape(*counts.shape[:-1], -1, groups).sum(axis=-2, dtype=np.int32)


def packed_counts(hashes: np.ndarray) -> bytes:
    """Counts in so many groups that most hold at most one element, four bits each, compressed; empty if a group overflows.

    The number of groups is a power of two, about half the set's size or more, so vectors of unlike sets fold onto each other."""
    groups = 64
    while groups * 2 < len(hashes):
        groups *= 2
    counts = np.bincount((hashes & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
    if counts.max(initial=0) > 15:
        return b""
    return zlib.compress((counts[::2] | counts[1::2] << 4).astype(np.uint8).tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    both = np.frombuffer(zlib.decompress(data) if data else b"", np.uint8)
    out = np.empty(2 * len(both), np.uint8)
    out[::2], out[1::2] = both & 15, both >> 4
    return out


def most_shared(a: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """At most so many elements are in both sets, for one set and each of others, by unpacked counts; finer vectors are folded to coarser ones."""
    out = np.zeros(len(others), np.int64)
    sizes = np.array([len(b) for b in others])
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        width = min(size, len(a))
        theirs = np.stack([others[k] for k in at.tolist()])
        out[at] = np.minimum(folded(a, width), theirs if size == width else folded(theirs, width)).sum(axis=1, dtype=np.int64)
    return out


class CountTree:
    """Boxes over points: packed by size, then by the two heaviest coordinates, so that boxes stay narrow where it counts. A few points are one leaf."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        spread = np.argsort(-points.var(axis=0))[:2]
        self.order = np.lexsort((points[:, spread[1]], points[:, spread[0]], sizes))
        high, small, large = points[self.order], sizes[self.order], sizes[self.order]
        self.levels = [(high, small, large)]  # points, then boxes from the leaves up: upper corner, least and largest size
        while len(high) > 1:
            at = np.arange(0, len(high), FAN_OUT)
            high, small, large = np.maximum.reduceat(high, at, axis=0), np.minimum.reduceat(small, at), np.maximum.reduceat(large, at)
            self.levels.append((high, small, large))

    def pairs(self, percent: int, *labels: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions (in the constructor's order) of pairs that may be similar and differ in each of the ``labels``. These may change between the turns: what
        has one label by then is not opened any more."""
        p = percent
        start = np.zeros(1, np.int64)
        waiting = [(len(self.levels) - 1, start, start)]
        while waiting:
            height, i, j = waiting.pop()
            high, small, large = self.levels[height]
            keep = (100 * large[i] >= p * small[j]) & (100 * large[j] >= p * small[i])
            for some in labels:
                first = last = mine = some[self.order]
                if height:
                    at = np.arange(0, len(mine), FAN_OUT**height)
                    first, last = np.minimum.reduceat(mine, at), np.maximum.reduceat(mine, at)
                keep &= (first[i] != last[i]) | (first[j] != last[j]) | (first[i] != first[j])
            i, j = i[keep], j[keep]
            bound = np.minimum(np.minimum(high[i], high[j]).sum(axis=1, dtype=np.int64), np.minimum(large[i], large[j]))
            keep = (100 + p) * bound >= p * (small[i] + small[j])
            i, j = i[keep], j[keep]
            if not len(i):
                continue
            if not height:
                yield self.order[i], self.order[j]
                continue
            below = len(self.levels[height - 1][0])
            for k in range(0, len(i), OPENED):
                a = (i[k : k + OPENED, None, None] * FAN_OUT + np.arange(FAN_OUT)[:, None] + np.zeros((1, FAN_OUT), np.int64)).ravel()
                b = (j[k : k + OPENED, None, None] * FAN_OUT + np.arange(FAN_OUT) + np.zeros((FAN_OUT, 1), np.int64)).ravel()
                real = (a < below) & (b < below) & ((a < b) if height == 1 else (a <= b))
                waiting.append((height - 1, a[real], b[real]))


def linked(points: np.ndarray, sizes: np.ndarray, labels: np.ndarray, apart: np.ndarray, sides: np.ndarray, percent: int, shared: Callable[[int, np.ndarray], np.ndarray], every: bool = False) -> list[tuple[int, int]]:
    """Pairs (positions) whose shared elements suffice, as ``shared(i, others)`` tells, that differ in ``apart``; two of different sides, or of side 2, can be a pair.

    Each link gives both members one label, and pairs of one label are not looked at, so what comes back joins the
    labels without a circle. With ``every`` nothing is skipped for its label, and all links come back."""
    out: list[tuple[int, int]] = []
    if len(sizes) < 2 or (labels == labels[0]).all() or (apart == apart[0]).all():
        return out
    labels = np.arange(len(sizes)) if every else np.unique(labels, return_inverse=True)[1]

    def settle(i: int, others: np.ndarray) -> None:
        others = others[(labels[others] != labels[i]) & (apart[others] != apart[i]) & ((sides[others] != sides[i]) | (sides[i] == 2))]
        if not len(others):
            return
        both = shared(i, others)
        for j in others[(both > 0) & ((100 + percent) * both >= percent * (sizes[i] + sizes[others]))].tolist():
            if labels[j] != labels[i]:
                out.append((i, j))
                if not every:
                    labels[labels == labels[j]] = labels[i]

    if len(sizes) > FAN_OUT and not every:
        # The most central point first: where a family was copied from it, the rest of the join finds one label.
        hub = int(np.abs(points - np.median(points, axis=0)).sum(axis=1).argmin())
        bound = np.minimum(points, points[hub]).sum(axis=1, dtype=np.int64)
        settle(hub, np.flatnonzero((100 + percent) * np.minimum(bound, np.minimum(sizes, sizes[hub])) >= percent * (sizes + sizes[hub])))
    for i, j in CountTree(points, sizes).pairs(percent, labels, apart):
        by = np.argsort(i, kind="stable")
        i, j = i[by], j[by]
        cuts = (np.flatnonzero(np.diff(i)) + 1).tolist()
        for a, b in zip([0, *cuts], [*cuts, len(i)], strict=True):
            settle(int(i[a]), j[a:b])
    return out
