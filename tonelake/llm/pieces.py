"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Symbols start as characters. An agenda (a heap) holds every adjacent pair whose joint spelling is a piece,
ordered by the piece's score and, on ties, by position from the left; taking the best pair merges it and adds
the two new pairs. Entries whose symbols have changed meanwhile are passed over. What is left maps to ids,
and unknown characters fall back to byte pieces.

No piece joins a character to a following word mark, mixes letters with other characters or holds a line feed,
which is verified when the model is read. So text falls apart there into words that can be encoded on their own,
and each distinct word's ids are kept in a bounded memo. In every Arrow batch ``checked`` rows, spread over the batch, are also encoded and decoded
by the sentencepiece library; a difference fails the task instead of passing wrong ids on.

Defined results: null and empty texts give begin and end ids alone and decode to the empty text. Repeated rows
are encoded each, an empty table gives an empty result, other columns are ignored, whatever their names. Very long texts are encoded whole, word by word; a
word of any length goes through one agenda, in time about proportional to its length.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import map_texts, sliced

MARK = "▁"
LETTER = "[A-Za-zÀ-ÖØ-öø-ɏ]"
#: A word: marks and letters, or marks and what is neither, or a line feed.
WORD = re.compile(f"{MARK}*{LETTER}+|{MARK}*(?:(?!{LETTER})[^{MARK}\n])+|{MARK}+|\n")
#: Distinct words whose ids a worker keeps, in each of two generations; the older one goes when the newer is full.
MEMO_ENTRIES = 100_000
#: Words longer than this are encoded but not kept.
MEMO_CHARS = 64


class PieceCoder:
    """Encoder and decoder for one model file; ``sentencepiece`` serves to read the model and to check."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bos, self.eos, self.unk = lib.bos_id(), lib.eos_id(), lib.unk_id()
        self.begin, self.end = (np.array([i], "<u4").tobytes() for i in (self.bos, self.eos))
        names = [lib.id_to_piece(i) for i in range(lib.get_piece_size())]
        self.byte_ids = {int(names[i][3:5], 16): i for i in range(len(names)) if lib.is_byte(i)}
        plain = [i for i in range(len(names)) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i))]
        self.ids = {names[i]: i for i in plain}
        self.scores = {names[i]: lib.get_score(i) for i in plain}
        self.spelled = [b""] * len(names)  # what decoding puts out for an id
        for i in plain:
            self.spelled[i] = names[i].replace(MARK, " ").encode()
        for byte, i in self.byte_ids.items():
            self.spelled[i] = bytes([byte])
        if len(self.byte_ids) != 256 or not all(WORD.fullmatch(p) for p in self.ids):
            raise ValueError("this vocabulary has pieces across words or lacks byte pieces")
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def agenda(self, word: str) -> list[int]:
        """Ids of one word by the score-ordered agenda."""
        symbols: list[str | None] = list(word)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        scores, heap = self.scores, []

        def propose(left: int, right: int) -> None:
            joint = symbols[left] + symbols[right]
            score = scores.get(joint)
            if score is not None:
                heapq.heappush(heap, (-score, left, right, joint))

        for i in range(n - 1):
            propose(i, i + 1)
        while heap:
            _, left, right, joint = heapq.heappop(heap)
            a, b = symbols[left], symbols[right]
            if a is None or b is None or len(a) + len(b) != len(joint) or after[left] != right:
                continue
            symbols[left], symbols[right] = joint, None
            after[left] = after[right]
            if after[right] >= 0:
                before[after[right]] = left
                propose(left, after[left])
            if before[left] >= 0:
                propose(before[left], left)
        out: list[int] = []
        for s in symbols:
            if s is not None:
                found = self.ids.get(s)
                out += [found] if found is not None else [self.byte_ids[x] for x in s.encode()]
        return out

    def _word_bytes(self, word: str) -> bytes:
        return np.array(self.agenda(word), "<u4").tobytes()

    def encode_bytes(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers, without begin and end."""
        if not text:
            return b""
        words = WORD.findall(MARK + text.replace(" ", MARK))
        out = list(map(self.memo.get, words))
        if None in out:
            for k, ids in enumerate(out):
                if ids is None:
                    out[k] = self._learn(words[k])
        return b"".join(out)

    def _learn(self, word: str) -> bytes:
        ids = self.memo.get(word) or self.older.get(word) or self._word_bytes(word)
        if len(word) <= MEMO_CHARS:
            if len(self.memo) >= MEMO_ENTRIES:
                self.older, self.memo = self.memo, {}
            self.memo[word] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        return [self.bos, *np.frombuffer(self.encode_bytes(text), "<u4").tolist(), self.eos]

    def decode(self, ids: list[int]) -> str:
        """Text of ids: the first word mark is the one that encoding puts before every text."""
        raw = b"".join(map(self.spelled.__getitem__, ids))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")

    def verify(self, text: str, ids: list[int], decoded: str) -> None:
        if self.library.encode(text, add_bos=True, add_eos=True) != ids or self.library.decode(ids) != decoded:
            raise ValueError(f"the agenda and the library disagree on {text[:80]!r}")


def encode_decode(df: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True, checked: int = 2) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded]) for every row, over whole texts.

    ``model`` is the path of the model file on every executor; ``keep_ids`` adds the ids and the decoded text;
    ``checked`` rows of each slice of an Arrow batch are held against the library."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = PieceCoder(model)
        for frame in sliced(frames, "text"):
            texts = [t or "" for t in frame["text"].tolist()]
            test = set(np.linspace(0, len(texts) - 1, min(checked, len(texts))).astype(int).tolist())
            rows = []
            for k, text in enumerate(texts):
                raw = coder.begin + coder.encode_bytes(text) + coder.end
                ids = np.frombuffer(raw, "<u4")
                decoded = coder.decode(ids.tolist())
                if k in test:
                    coder.verify(text, ids.tolist(), decoded)
                row = (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
                rows.append((*row, ids.astype(np.int32), decoded) if keep_ids else row)
            names = ["n_tokens", "ids_sha256", "decoded_sha256", *(("ids", "decoded") if keep_ids else ())]
            out = pd.DataFrame(rows, columns=names)
            out.insert(0, id_col, frame["id"].to_numpy())
            yield out

    kind = df.schema[id_col].dataType.simpleString()
    slim = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    more = ", ids array<int>, decoded string" if keep_ids else ""
    return map_texts(slim, run, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string{more}")
