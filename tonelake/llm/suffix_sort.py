"""Suffix arrays by two-stage sorting, in numpy.

A suffix is of type B if it is smaller than the suffix one byte on, else of type A. Only type B suffixes are sorted directly, by
words of eight bytes, ties going on to the next word up to ``depth`` bytes. The rest is induced: scanning the array by first
byte upwards, a suffix p puts p - 1, if that is of type A, next into the bucket of its byte. Whole buckets are scanned at once;
entries that land in the bucket being scanned (runs of one byte) make a further turn.
"""

from __future__ import annotations

import numpy as np


def words(data: np.ndarray) -> np.ndarray:
    """At each position the eight bytes from there on as one big-endian number, zeros beyond the end."""
    out = np.r_[data, np.zeros(8, np.uint8)].astype(np.uint64)
    for step in (1, 2, 4):
        out[:-step] = (out[:-step] << np.uint64(8 * step)) | out[step:]
    return out[: len(data)]


def ascending(data: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one (type B)."""
    n = len(data)
    change = np.zeros(n, np.int8)
    change[:-1] = np.sign(data[1:].astype(np.int16) - data[:-1])
    change[-1] = -1  # the empty suffix is smaller
    at = np.where(change != 0, np.arange(n), n)
    follows = np.minimum.accumulate(at[::-1])[::-1]  # where the run of equal bytes ends
    return change[follows] > 0


def directly_sorted(positions: np.ndarray, word: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` bytes; equal ones next to each other."""
    padded = np.r_[word, np.zeros(depth + 8, np.uint64)]
    order = positions[np.argsort(padded[positions], kind="stable")]
    key = padded[order]
    group = np.cumsum(np.r_[0, (key[1:] != key[:-1]).astype(np.int64)]) if len(order) else np.zeros(0, np.int64)
    for done in range(8, depth, 8):
        tied = np.zeros(len(order), bool)
        equal = group[1:] == group[:-1]
        tied[1:] |= equal
        tied[:-1] |= equal
        where = np.flatnonzero(tied)
        if not len(where):
            break
        mine, key = order[where], padded[order[where] + done]
        by = np.lexsort((key, group[where]))
        order[where] = mine[by]
        # New groups are numbered by their first place, so that numbers still ascend along the array.
        key, old = key[by], group[where][by]
        new = np.r_[True, (key[1:] != key[:-1]) | (old[1:] != old[:-1])]
        group = np.arange(len(order))
        group[where] = where[np.maximum.accumulate(np.where(new, np.arange(len(where)), 0))]
    return order


def needed(wanted: np.ndarray, b_type: np.ndarray) -> np.ndarray:
    """``wanted`` suffixes and those that they are induced from: on to the next one of type B."""
    n = len(wanted)
    last_b = np.maximum.accumulate(np.where(b_type, np.arange(n), -1))
    run = np.r_[0, last_b[:-1] + 1]  # first place of the run of type A that ends here
    count = np.r_[0, np.cumsum(wanted)]
    return count[1:] > count[run]


def suffix_array(data: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """Positions of the suffixes of a byte array, in order of their first ``depth`` bytes at least. With ``wanted`` only these
    suffixes are sure to be in the array."""
    if not len(data):
        return np.zeros(0, np.int64)
    b_type = ascending(data)
    use = np.ones(len(data), bool) if wanted is None else needed(wanted, b_type)
    sorted_b = directly_sorted(np.flatnonzero(b_type & use), words(data), depth)
    first_byte = data[sorted_b]
    cuts = np.searchsorted(first_byte, np.arange(257))
    buckets: list[list[np.ndarray]] = [[] for _ in range(256)]
    # The last suffix has no successor that could induce it: it is the smallest of its byte.
    if use[-1]:
        buckets[data[-1]].append(np.array([len(data) - 1]))
    out = [np.zeros(0, np.int64)]

    def scan(found: np.ndarray) -> None:
        before = found[found > 0] - 1
        before = before[~b_type[before] & use[before]]
        if not len(before):
            return
        chars = data[before]
        before = before[np.argsort(chars, kind="stable")]
        edges = np.cumsum(np.bincount(chars, minlength=256))
        start = 0
        for c in np.unique(chars).tolist():
            buckets[c].append(before[start : edges[c]])
            start = edges[c]

    for c in range(256):
        turn = 0
        while turn < len(buckets[c]):  # grows while runs of this byte are followed
            scan(buckets[c][turn])
            turn += 1
        out += buckets[c]
        tail = sorted_b[cuts[c] : cuts[c + 1]]
        scan(tail)
        out.append(tail)
    return np.concatenate(out)


def repeated(data: np.ndarray, valid: np.ndarray, length: int) -> np.ndarray:
    """Which ``valid`` positions begin a string of ``length`` bytes (a multiple of 8) that begins at another position too: those whose
    common prefix with a neighbour in the suffix array is that long."""
    order = suffix_array(data, length, valid)
    order = order[valid[order]]
    padded = np.r_[words(data), np.zeros(length + 8, np.uint64)]
    a, b = order[:-1], order[1:]
    for at in range(0, length, 8):
        same = padded[a + at] == padded[b + at]
        a, b = a[same], b[same]
    out = np.zeros(len(data), bool)
    out[a] = out[b] = True
    return out
