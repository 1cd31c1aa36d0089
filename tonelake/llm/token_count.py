"""Token counts by rank-synchronous merging of ragged numpy arrays.

A byte-level BPE vocabulary splits text into pre-tokens and merges each one's bytes pair by pair, lowest
rank first. Here all pre-tokens not met before in an Arrow batch lie in one flat array with offsets. The rank of every adjacent
pair is kept, and the lowest of every block of places; each round takes each sequence's lowest by a segmented minimum and
merges all its occurrences at once, in the blocks that have it. Merged symbols are linked over, so a round looks at what it merges and
at its blocks, and the whole work follows the number of merges, also in a pre-token of megabytes. Sequences without a mergeable pair
are done; the symbols they are left with are their token count. Counts are kept per distinct pre-token in a bounded memo.

Defined results: null and empty texts have 0 bytes and 0 tokens. Repeated rows are counted each. Very long texts are counted whole, a slice of a batch holds one
of them. Any other columns of the input are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

from .common import map_texts, sliced

#: The published splitting pattern of this vocabulary family, with white space spelt out.
PRE_TOKEN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: Distinct pre-tokens whose counts a worker keeps, in each of two generations; the older one goes when the newer is full.
MEMO_ENTRIES = 300_000
#: Pre-tokens longer than this are counted but not kept.
MEMO_CHARS = 64
#: Pre-tokens merged together in one ragged array.
MERGE_BATCH = 60_000
#: Places that share a lowest rank.
BLOCK = 128
NO_RANK = np.int32(2**31 - 1)


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use, by character: bytes that print stand for
    themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _places(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of ranges one after the other, and where each range begins among them."""
    cuts = np.cumsum(size) - size
    return np.arange(int(size.sum())) + np.repeat(start - cuts, size), cuts


class RankMerger:
    """Counts tokens of texts under one byte-level BPE vocabulary file (the ``tokenizers`` JSON format)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.byte_ids = np.zeros(256, np.int64)
        for char, byte in byte_alphabet().items():
            self.byte_ids[byte] = vocab[char]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.made = made  # by rank
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        specials = [t["content"] for t in spec.get("added_tokens", []) if t["content"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self.pre_token = regex.compile(PRE_TOKEN)
        self.memo: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)

    def merged_counts(self, pieces: list[bytes]) -> np.ndarray:
        """Symbols that survive in each byte string (none empty)."""
        lengths = np.array([len(p) for p in pieces], np.int64)
        first = np.cumsum(lengths) - lengths
        ids = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        n = len(ids)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)  # neighbouring symbols in the sequence, -1 for none
        after[first + lengths - 1] = -1
        before[first] = -1
        live = np.ones(n, bool)
        rank = np.full(n, NO_RANK, np.int32)  # of the pair that begins here
        at = np.flatnonzero(after >= 0)
        rank[at] = self._rank(ids[at], ids[at + 1])
        # Sequences lie in blocks of at most BLOCK places, each with its lowest rank, so that a round only opens blocks where something is merged.
        blocks = -(-lengths // BLOCK)
        seq = np.repeat(np.arange(len(pieces)), blocks)
        nth = np.arange(len(seq)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = first[seq] + nth * BLOCK
        size = np.minimum(lengths[seq] - nth * BLOCK, BLOCK)
        block_of = np.repeat(np.arange(len(seq)), size)
        low = np.minimum.reduceat(rank, start)
        open_ = np.flatnonzero(low != NO_RANK)
        while len(open_):
            edge = np.flatnonzero(np.diff(seq[open_], prepend=-1))
            lowest = np.repeat(np.minimum.reduceat(low[open_], edge), np.diff(edge, append=len(open_)))
            turn = open_[low[open_] == lowest]
            place, _ = _places(start[turn], size[turn])
            left = place[rank[place] == np.repeat(low[turn], size[turn])]
            # Of overlapping occurrences (a run of one symbol) every second one, from the left.
            chained = np.r_[False, after[left[:-1]] == left[1:]]
            if chained.any():
                k = np.arange(len(left))
                left = left[(k - np.maximum.accumulate(np.where(chained, 0, k))) % 2 == 0]
            right = after[left]
            ids[left] = self.made[rank[left]]
            live[right] = False
            rank[right] = NO_RANK
            after[left] = beyond = after[right]
            before[beyond[beyond >= 0]] = left[beyond >= 0]
            changed = np.concatenate([left, before[left]])
            changed = changed[changed >= 0]
            follows = after[changed]
            pair = follows >= 0
            rank[changed[~pair]] = NO_RANK
            changed, follows = changed[pair], follows[pair]
            rank[changed] = self._rank(ids[changed], ids[follows])
            touched = np.zeros(len(seq), bool) if len(turn) * 8 > len(seq) else None
            where = np.concatenate([block_of[left], block_of[right], block_of[changed]])
            if touched is None:
                where = np.unique(where)
            else:
                touched[where] = True
                where = np.flatnonzero(touched)
            place, cuts = _places(start[where], size[where])
            low[where] = np.minimum.reduceat(rank[place], cuts)
            open_ = open_[low[open_] != NO_RANK]
            fresh = where[low[where] != NO_RANK]
            if len(fresh) and not np.isin(fresh, open_).all():
                open_ = np.union1d(open_, fresh)
        return np.add.reduceat(live.astype(np.int64), first)

    def split(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens, and the number of special tokens that the text spells out."""
        if self.special is None or not self.special.search(text):
            return self.pre_token.findall(text), 0
        parts = self.special.split(text)
        return [t for p in parts for t in self.pre_token.findall(p)], len(parts) - 1

    def count(self, texts: list[str]) -> list[int]:
        split = [self.split(t) for t in texts]
        if len(self.memo) > MEMO_ENTRIES:
            self.older, self.memo = self.memo, {}
        memo, older = self.memo, self.older
        new = {t for tokens, _ in split for t in tokens if t not in memo}
        memo.update((t, older[t]) for t in new if t in older)
        new = [t for t in new if t not in memo]
        long: dict[str, int] = {}
        for a in range(0, len(new), MERGE_BATCH):
            part = new[a : a + MERGE_BATCH]
            for t, n in zip(part, self.merged_counts([t.encode() for t in part]).tolist(), strict=True):
                (memo if len(t) <= MEMO_CHARS else long)[t] = n
        if not long:
            return [sum(map(memo.__getitem__, tokens)) + extra for tokens, extra in split]
        return [sum(long[t] if t in long else memo[t] for t in tokens) + extra for tokens, extra in split]


def token_counts(df: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row; ``vocabulary`` is the path of the JSON file, which
    must exist on every executor. The whole text is counted, without begin, end or added special tokens;
    special strings inside a text count as the one token that the library makes of them."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        merger = RankMerger(vocabulary)
        for frame in sliced(frames, "text"):
            texts = [t or "" for t in frame["text"].tolist()]
            n = np.array(merger.count(texts), np.int64)
            yield pd.DataFrame({id_col: frame["id"].to_numpy(), "n_bytes": np.array([len(t.encode()) for t in texts], np.int64), "n_tokens": n, "over_limit": n > limit})

    kind = df.schema[id_col].dataType.simpleString()
    slim = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    return map_texts(slim, run, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
