import hashlib
import random
import time

import numpy as np
import pytest
from oracle import SF_SMALL

from tonelake.llm import pieces, queries, token_count

sentencepiece = pytest.importorskip("sentencepiece")
tokenizers = pytest.importorskip("tokenizers")
BPE, PIECES = queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path("piece_bpe_32k.model")
ALPHABET = "ab é\n\t\r ▁'s 't 12٣ \xa0　\x85\x1c​😀漢字aaaa!!..,ßé\x00İ½Ⅷ²'LL"


def texts(n=400):
    rng = random.Random(2)
    out = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 80))) for _ in range(n)]
    return out + ["", None, "<|endoftext|>a<|endoftext|><|endoftext|> b", "<s>x</s>", "▁", " ", "  a ", "a" * 5000, "ab" * 3000, " " * 1000, "\n" * 300, "the of and " * 20_000]


def test_counts_like_the_library(docs):
    rows = list(enumerate(texts()))
    library = tokenizers.Tokenizer.from_file(BPE)
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_count.token_counts(docs(rows), BPE).collect()}
    for i, t in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert got[i] == (len((t or "").encode()), n, n > 1024)


def test_pieces_like_the_library(docs):
    rows = list(enumerate(texts()))
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = {r.doc_id: r for r in pieces.encode_decode(docs(rows), PIECES, checked=10**9).collect()}
    for i, t in rows:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        assert list(got[i].ids) == ids and got[i].n_tokens == len(ids) and got[i].decoded == library.decode(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_small_memos(monkeypatch):
    monkeypatch.setattr(pieces, "MEMO_ENTRIES", 3)
    monkeypatch.setattr(token_count, "MEMO_ENTRIES", 3)
    coder, merger = pieces.PieceCoder(PIECES), token_count.RankMerger(BPE)
    library = tokenizers.Tokenizer.from_file(BPE)
    for t in texts(30):
        assert coder.encode(t or "") == coder.library.encode(t or "", add_bos=True, add_eos=True)
        assert merger.count([t or ""]) == [len(library.encode(t or "", add_special_tokens=False).ids)]


def test_a_difference_is_noticed():
    coder = pieces.PieceCoder(PIECES)
    with pytest.raises(ValueError):
        coder.verify("hello", [1, 2], "")


@pytest.mark.parametrize("block", [2, 3, 128])
def test_long_pre_tokens(monkeypatch, block):
    """One pre-token of many blocks, equal to the library; the work follows the merges."""
    monkeypatch.setattr(token_count, "BLOCK", block)
    rng = random.Random(block)
    n = 1_000_000 if block == 128 else 3000
    merger, library = token_count.RankMerger(BPE), tokenizers.Tokenizer.from_file(BPE)
    cases = ["".join(rng.choices("etaoinshrdlu", k=n)), "a" * (n // 2), "ab" * (n // 2), "aab" * 999, "é" * 777, "the" * 1500 + "x"]
    began = time.process_time()
    got = merger.count(cases)
    spent = time.process_time() - began
    assert got == [len(library.encode(t, add_special_tokens=False).ids) for t in cases]
    assert spent < 60 and not any(len(t) > token_count.MEMO_CHARS for t in merger.memo)


def test_empty(docs):
    assert token_count.token_counts(docs([]), BPE).count() == 0 and pieces.encode_decode(docs([]), PIECES).count() == 0


def test_queries(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    bpe, lib = tokenizers.Tokenizer.from_file(BPE), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    counts = queries.op8_token_counts(spark, SF_SMALL).collect()
    coded = queries.op9_sentencepiece(spark, SF_SMALL).collect()
    assert len(counts) == len(coded) == len(docs)
    assert all(r.n_tokens == len(bpe.encode(docs[r.doc_id], add_special_tokens=False).ids) for r in counts)
    assert all(r.ids_sha256 == hashlib.sha256(np.array(lib.encode(docs[r.doc_id], add_bos=True, add_eos=True), "<u4").tobytes()).hexdigest() for r in coded)


def test_long_words_in_pieces():
    """A word of very many letters, equal to the library."""
    coder, rng = pieces.PieceCoder(PIECES), random.Random(3)
    for text in ("".join(rng.choices("etaoinshrdlu", k=200_000)), "a" * 100_000, "é" * 50_000):
        began = time.process_time()
        assert coder.encode(text) == coder.library.encode(text, add_bos=True, add_eos=True)
        assert time.process_time() - began < 30
