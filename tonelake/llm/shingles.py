"""Word shingles of whole texts: as hashes under a key, or as exact numbers within one set of texts.

A word is hashed under the key by the library to 128 bits, once for each distinct word. A shingle's hash is a sum over its words' halves, each
times an odd number of its place, which follow from the key too. The key is drawn once a run, so nobody can write texts whose hashes fall together. Numbers come from
dictionaries of the words themselves and are exact.
"""

from __future__ import annotations

import hashlib
import secrets

import numpy as np

#: Bytes of text hashed together; longer texts go alone.
BATCH_BYTES = 1_000_000
#: Distinct words whose hashes are kept, and the longest that are.
MEMO_WORDS, MEMO_BYTES = 200_000, 64
#: Most words in a shingle.
MOST_WIDTH = 64


def new_key() -> bytes:
    """A key for one run, handed to all its tasks."""
    return secrets.token_bytes(16)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    """The words of a text: A-Z count as a-z, words end at space and 0x09-0x0D, as ``bytes`` have it."""
    return (text or "").encode().lower().split()


class Keyed(dict):
    """Digests of words under one key, filled on demand and emptied when full, and odd numbers for places."""

    def __init__(self, key: bytes):
        super().__init__()
        self.key = key
        rng = np.random.default_rng(int.from_bytes(key, "little"))
        self.places = rng.integers(0, 2**63, (2, 4 * MOST_WIDTH), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def __missing__(self, word: bytes) -> bytes:
        digest = hashlib.blake2b(word, digest_size=16, key=self.key).digest()
        if len(word) <= MEMO_BYTES:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[word] = digest
        return digest


_last: list[Keyed] = []


def keyed(key: bytes) -> Keyed:
    """The hashes of this worker's last key, which batches and tasks of one run share."""
    if not _last or _last[0].key != key:
        _last[:] = [Keyed(key)]
    return _last[0]


def hashed_sets(texts: list[str | None], width: int, key: bytes) -> list[tuple[np.ndarray, bytes]]:
    """The sorted distinct shingle hashes of each text (``width`` words, or all words where there are fewer), and 128 bits for the whole set, from twice as
    many bits of each shingle."""
    hashes = keyed(key)
    out: list[tuple[np.ndarray, bytes]] = []
    held: list[bytes] = []
    counts: list[int] = []
    size = 0
    for text in texts:
        words = words_of(text)
        held.append(b"".join(map(hashes.__getitem__, words)))
        counts.append(len(words))
        size += len(text or "")
        if size >= BATCH_BYTES:
            out += _batch(b"".join(held), counts, width, hashes)
            held, counts, size = [], [], 0
    return out + _batch(b"".join(held), counts, width, hashes)


def shingle_sets(texts: list[str | None], width: int, key: bytes) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    return [s for s, _ in hashed_sets(texts, width, key)]


def _batch(digests: bytes, counts: list[int], width: int, hashes: Keyed) -> list[tuple[np.ndarray, bytes]]:
    if width > MOST_WIDTH:
        raise ValueError(f"a shingle has at most {MOST_WIDTH} words")
    halves = np.frombuffer(digests, np.uint64).reshape(-1, 2)
    low, high = np.ascontiguousarray(halves[:, 0]), np.ascontiguousarray(halves[:, 1])
    n = max(len(low) - width + 1, 0)
    full = np.zeros((2, n), np.uint64)
    for which, place in enumerate(hashes.places):
        for k in range(width if n else 0):
            full[which] += low[k : k + n] * place[2 * k] + high[k : k + n] * place[2 * k + 1]
        full[which] = mix(full[which])
    out, start = [], 0
    for count in counts:
        if count >= width:
            end = start + count - width + 1
            tokens, at = np.unique(full[0, start:end], return_index=True)
            more = full[1, start:end][at]
        elif count:
            k = np.arange(count) * 2 + 2 * width
            both = [(low[start : start + count] * place[k] + high[start : start + count] * place[k + 1]).sum(dtype=np.uint64) + np.uint64(count) for place in hashes.places]
            tokens, more = mix(np.array(both[:1], np.uint64)), mix(np.array(both[1:], np.uint64))
        else:
            tokens = more = np.zeros(0, np.uint64)
        out.append((tokens, hashlib.blake2b(tokens.tobytes() + more.tobytes(), digest_size=16).digest()))
        start += count
    return out


class _Numbers(dict):
    """Numbers of words from 1 on, in the order of their first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self) + 1
        return number


def _joint(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers that are equal where both parts are."""
    return np.unique(a * (b.max() + 1) + b, return_inverse=True)[1].astype(np.int64)


def numbered_sets(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray, int]:
    """All texts' sets of shingles, one after the other, as (numbers, bounds) with the count of numbers in use. Equal numbers mean equal
    shingles, letter by letter."""
    numbers = _Numbers()
    parts, counts = [], []
    for text in texts:
        words = words_of(text)
        # Zeros fill up what is shorter than a shingle; no word has that number.
        part = np.zeros(max(len(words), width) if words else 0, np.int64)
        part[: len(words)] = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
        parts.append(part)
        counts.append(max(len(part) - width + 1, 0))
    flat = np.concatenate([*parts, np.zeros(width, np.int64)])
    spans, whole, done = flat, None, 0  # shingles of 1, 2, 4, ... words; of the first ``done`` words
    step = 1
    while step <= width:
        if width & step:
            whole = spans if whole is None else _joint(whole[: len(spans) - done], spans[done:])
            done += step
        step *= 2
        if step <= width:
            spans = _joint(spans[: -(step // 2)], spans[step // 2 :])
    rows = np.repeat(np.arange(len(texts)), counts)
    starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])])[:-1]
    within = np.arange(len(rows)) - np.repeat(np.concatenate([[0], np.cumsum(counts)])[:-1], counts)
    used = whole[starts[rows] + within] if len(rows) else np.zeros(0, np.int64)
    top = int(used.max(initial=-1)) + 1
    both = np.unique(rows * max(top, 1) + used)
    return both % max(top, 1), np.searchsorted(both // max(top, 1), np.arange(len(texts) + 1)), top
