import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from oracle import SF_SMALL
from hypothesis import given, settings
from hypothesis import strategies as st

from tonelake.llm import common, queries, repeats
from tonelake.llm.suffix_sort import repeated, suffix_array


def brute(rows, length):
    count = Counter()
    raw = [(i, (t or "").encode()) for i, t in rows]
    for _, t in raw:
        count.update(t[i : i + length] for i in range(len(t) - length + 1))
    out = {}
    for d, t in raw:
        gone = np.zeros(len(t) + 1, int)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.setdefault(d, []).append((len(t), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return {d: sorted(v) for d, v in out.items()}


def result(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
    return {d: sorted(v) for d, v in out.items()}


@given(st.lists(st.integers(0, 3), min_size=1, max_size=80), st.integers(0, 2**80 - 1))
@settings(max_examples=300, deadline=None)
def test_suffix_array(values, mask):
    data = np.array(values, np.uint8)
    wanted = np.array([mask >> i & 1 for i in range(len(data))], bool)
    order = sorted(range(len(data)), key=lambda i: data[i:].tobytes())
    assert suffix_array(data, 96).tolist() == order
    assert [i for i in suffix_array(data, 96, wanted).tolist() if wanted[i]] == [i for i in order if wanted[i]]


@given(st.lists(st.integers(1, 2), min_size=9, max_size=120))
@settings(max_examples=100, deadline=None)
def test_repeated(values):
    data = np.r_[np.array(values, np.uint8), 0]
    valid = np.zeros(len(data), bool)
    valid[: len(values) - 7] = True
    strings = Counter(data[i : i + 8].tobytes() for i in np.flatnonzero(valid))
    assert repeated(data, valid, 8).tolist() == [bool(v) and strings[data[i : i + 8].tobytes()] > 1 for i, v in enumerate(valid)]


def made(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared, short = prose(120), prose(20)
    rows = [(i, prose(30) + shared[rng.randint(0, 60) : -rng.randint(1, 60)] + prose(25)) for i in range(12)]
    rows += [(20, shared), (21, shared), (22, short), (23, short), (24, None), (25, ""), (26, "z" * 700), (27, "ab" * 333), (28, prose(50) + shared * 2), (29, "y" * 199), (30, "y" * 200), (31, "q" * 200)]
    return rows + [(32, "dup " * 60 + "end"), (32, "dup " * 60 + "end")]


@pytest.mark.parametrize(("hot", "depth", "together"), [(2000, 6, 2000), (1, 6, 2000), (1, 1, 2), (2, 3, 1)])
def test_like_brute_force(docs, monkeypatch, hot, depth, together):
    monkeypatch.setattr(repeats.repeated_ranges, "__defaults__", (hot,))
    monkeypatch.setattr(repeats, "DEPTH", depth)
    monkeypatch.setattr(repeats, "CUT_TOGETHER", together)
    rows = made(1)
    assert result(repeats.remove_repeats(docs(rows), length=200)) == brute(rows, 200)


def test_a_hot_passage_in_different_surroundings(docs, monkeypatch):
    """Passages of all lengths around one core, one of them of a short period, cut again and again."""
    monkeypatch.setattr(repeats.repeated_ranges, "__defaults__", (3,))
    rng = random.Random(8)
    prose = lambda n: "".join(rng.choice("abcdef gh") for _ in range(n))
    core, period = prose(420), "xyz" * 150
    rows = [(i, prose(rng.randint(0, 90)) + core[rng.randint(0, 150) : len(core) - rng.randint(0, 150)] + prose(rng.randint(0, 90))) for i in range(25)]
    rows += [(100 + i, prose(40) + period[rng.randint(0, 9) : len(period) - rng.randint(0, 200)] + prose(40)) for i in range(12)]
    assert result(repeats.remove_repeats(docs(rows), length=200)) == brute(rows, 200)


def test_joins_without_broadcast_and_parts(docs, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(repeats, "PART_BYTES", 300)  # documents are cut into parts
    rows = made(2)
    assert result(repeats.remove_repeats(docs(rows), length=200)) == brute(rows, 200)


def test_spans_and_bytes(docs):
    rows = made(3)
    texts = {i: (t or "").encode() for i, t in rows}
    for r in repeats.remove_repeats(docs(rows), length=104).collect():
        raw = texts[r.doc_id]
        kept = b"".join(raw[a:b] for a, b in zip([0, *[s[1] for s in r.spans]], [*[s[0] for s in r.spans], len(raw)], strict=True))
        assert kept == bytes(r.kept)


def test_rows_without_an_id_and_one_id_on_different_texts(docs):
    texts = [t for _, t in made(4) if t is not None]
    rows = [(None if k % 3 == 0 else k // 4, t) for k, t in enumerate(texts)] + [(None, texts[0]), (0, texts[5]), (2**60 + 1, texts[1]), (None, None)]
    assert result(repeats.remove_repeats(docs(rows), length=200)) == brute(rows, 200)


def test_empty(docs):
    assert repeats.remove_repeats(docs([])).count() == 0


def test_length_is_checked(docs):
    with pytest.raises(ValueError):
        repeats.remove_repeats(docs([]), length=50)


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    assert result(queries.op2_suffix_dedup(spark, SF_SMALL)) == brute(rows, 200)


def test_contexts_whose_polynomial_hashes_fall_together(docs):
    """Two texts that share no string of 200 bytes lose nothing, whatever sums modulo a power of two say."""
    a, b = "--fixed-d2boxtjE", "--fixed-w5fOrBMA"
    middle = "--fixed-................z0OoqTigH6U3CQRUQqzXsBT3D3UB MrIFISFRGoRRVmu4mgF++++++++"
    first, second = "abbabaab", "baababba"
    texts = ["".join({"a": a, "b": b}[c] for c in x) + middle + "".join({"a": a, "b": b}[c] for c in y) + "--fixed-========" for x, y in ((first, second), (second, first))]
    rows = list(enumerate(texts))
    assert len(texts[0]) == 352 and not {texts[0][i : i + 200] for i in range(153)} & {texts[1][i : i + 200] for i in range(153)}
    assert result(repeats.remove_repeats(docs(rows), keep_bytes=False)) == brute(rows, 200)
