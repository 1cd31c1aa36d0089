import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tonelake.functions import text as T


def one(spark, value, *columns):
    return spark.createDataFrame([(value,)], "x string").select(*columns).first()


def python_simhash(words):
    weights = [0] * 64
    for w in words:
        h = int(hashlib.md5(w.encode()).hexdigest(), 16)
        for i in range(64):
            weights[i] += 1 if h >> i & 1 else -1
    out = sum(1 << i for i in range(64) if weights[i] > 0)
    return out - (1 << 64) if out >> 63 else out


def test_simhash(spark):
    texts = ["", "a b c", "alpha beta beta gamma", "abc", "x " * 50 + "yy zz", "één twee drie vier vijf"]
    rows = spark.createDataFrame([(t,) for t in texts], "x string").select("x", T.simhash(F.col("x")).alias("h")).collect()
    for r in rows:
        assert r.h == python_simhash([w for w in r.x.split() if len(w) > 1])
    assert one(spark, "abc", T.simhash(F.col("x")).alias("b")).b == -2984127896297046158


def test_simhash_of_nothing_and_of_many(spark, monkeypatch):
    monkeypatch.setattr(T, "COUNTED", 5)
    monkeypatch.setattr(T, "MEMO_TOKENS", 3)
    texts = [None, "", "a", "ab cd ef gh", "ab ab cd", "", "xx yy zz ab", None, "ab " * 40]
    assert T.simhashes(texts) == [None if t is None else python_simhash([w for w in t.split() if len(w) > 1]) for t in texts]
    assert [r.h for r in spark.createDataFrame([(None,), ("",)], "x string").select(T.simhash(F.col("x")).alias("h")).collect()] == [None, 0]


letters = st.text("abcde é", max_size=150)


def plain_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


@given(letters, letters, st.integers(0, 150))
@settings(max_examples=200, deadline=None)
def test_longest_common_with_a_least(a, b, least):
    whole = plain_common(a, b)
    assert T.longest_common(a, b) == whole
    assert T.longest_common(a, b, least) == whole if whole >= least else T.longest_common(a, b, least) in (-1, whole)


@given(st.lists(letters, min_size=2, max_size=6), st.lists(st.tuples(st.integers(0, 5), st.integers(0, 149)), max_size=8))
@settings(max_examples=100, deadline=None)
def test_similar_texts(texts, cuts):
    for k, at in cuts:  # copies with a letter taken out, so that some are similar
        texts.append(texts[k % len(texts)][:at] + texts[k % len(texts)][at + 1 :])
    pairs = [(i, j) for i in range(len(texts)) for j in range(i)]
    wanted = [(i, j) for i, j in pairs if texts[i] == texts[j] or 200.0 * plain_common(texts[i], texts[j]) / (len(texts[i]) + len(texts[j])) >= 85]
    assert T.similar_texts(texts, pairs, 85) == wanted


def test_hamming(spark):
    assert spark.range(1).select(T.hamming(F.lit(-1), F.lit(0)).alias("d")).first().d == 64


@pytest.mark.parametrize(
    ("raw", "wanted"),
    [
        ("See https://a.b/c?d now", "see now"),
        ("Call 010-1234-5678!", "call"),
        ("위 내용은 우리의 승인이\n이뤄진 내용입니다. 본문", "본문"),
        ("*텔레그램 채널: @abc 글", "글"),
        ("  Été—élan_1  ", "été élan_1"),
        ("", ""),
    ],
)
def test_normalised(spark, raw, wanted):
    assert one(spark, raw, T.normalised(F.col("x")).alias("n")).n == wanted


def test_scoring_input(spark):
    rows = spark.createDataFrame([("a", "b"), (None, " b "), ("", None), ("a", "")], "t string, e string")
    assert [r.s for r in rows.select(T.scoring_input(F.col("t"), F.col("e")).alias("s")).collect()] == ["a\n\nb", "b", "", "a"]


def test_first_url(spark):
    schema = "x string, e array<struct<kind: string, url: string, offset: int, length: int>>"
    rows = [("see http://x.y z", None), ("see abc.de z", [("url", None, 4, 6)]), ("t", [("text_url", "http://q", 0, 1)]), ("none", []), (None, None)]
    out = spark.createDataFrame(rows, schema).select(T.first_url(F.col("x"), F.col("e")).alias("u")).collect()
    assert [r.u for r in out] == ["http://x.y", "abc.de", "http://q", None, None]


def test_extract_status(spark):
    rows = [(None, True, "document", None), ("a.jpg", True, "document", None), ("a.docx", True, "document", "x"), ("a.pdf", True, "document", "x" * 199), ("a.pdf", True, "document", "x" * 200), ("a.pdf", False, "document", "x"), ("a.pdf", True, "photo", None), ("a.pdf", True, "document", None)]
    df = spark.createDataFrame(rows, "p string, e boolean, k string, t string")
    out = df.select(T.extract_status(*map(F.col, "pekt")).alias("s")).collect()
    assert [r.s for r in out] == ["no_file", "image_pending", "error", "scanned", "ok", "no_file", "image_pending", "error"]


def table_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@given(st.text("abc", max_size=40), st.text("abc", max_size=40))
@settings(max_examples=200, deadline=None)
def test_longest_common(a, b):
    assert T.longest_common(a, b) == table_lcs(a, b)


@given(st.lists(st.text("abcd", min_size=2, max_size=5), max_size=20).flatmap(lambda w: st.tuples(st.just(w), st.permutations(w))))
@settings(max_examples=50, deadline=None)
def test_simhash_ignores_order(pair):
    assert python_simhash(pair[0]) == python_simhash(pair[1])


@pytest.mark.parametrize("ratio", [50, 85, 100])
def test_short_texts_like_one_by_one(monkeypatch, ratio):
    monkeypatch.setattr(T, "PLACES_BYTES", 4000)
    monkeypatch.setattr(T, "PAIRS_AT_ONCE", 70)
    rng = random.Random(7)
    texts = ["", "x" * 64, "x" * 65] + ["".join(rng.choice("abc é한😀") for _ in range(rng.randrange(1, 129))) for _ in range(40)]
    texts += ["".join(c for c in t if rng.random() < 0.9) + "z" for t in texts]
    held = T.ShortTexts(pa.chunked_array([pa.array([*texts, None])]))
    assert held.held.tolist() == [True] * len(texts) + [False]
    for some in (range(len(texts)), [0, 1, 5]):  # of the second ones all texts are shorter than the longest that is held
        pairs = [(i, j) for i in some for j in range(len(texts)) if texts[i] or texts[j]]
        got = held.similar(*np.array(pairs).T, ratio).tolist()
        assert got == [200 * T.longest_common(texts[i], texts[j]) >= ratio * (len(texts[i]) + len(texts[j])) for i, j in pairs]


def changed(rng, t, n):
    """The text with n letters left out and n put in."""
    t = list(t)
    for _ in range(n):
        del t[rng.randrange(len(t))]
        t.insert(rng.randrange(len(t) + 1), rng.choice("etaoin shrdlu"))
    return "".join(t)


@pytest.mark.parametrize("fewest, at_work, most", [(1, 16_384, 60), (1, 40, 60), (30, 500, 2), (10**9, 16_384, 60)])
def test_pairs_of_like_lengths_are_compared_at_once(monkeypatch, fewest, at_work, most):
    """The same pairs as one by one, close to the ratio on both sides; unrelated texts are not compared one by one."""
    monkeypatch.setattr(T, "FEWEST_PAIRS", fewest)
    monkeypatch.setattr(T, "AT_WORK", at_work)
    monkeypatch.setattr(T, "MOST_WORDS", most)
    rng = random.Random(11)
    words = ["".join(rng.choices("eeeettaaooiinn shrdlucmfwypvbgkéß한", k=rng.randrange(2, 9))) for _ in range(200)]
    texts = [" ".join(rng.choices(words, k=rng.randrange(40, 130))) for _ in range(24)]
    texts += [changed(rng, texts[k], int(len(texts[k]) * share)) for k, share in enumerate((0.02, 0.1, 0.14, 0.15, 0.16, 0.17, 0.18, 0.2, 0.25))] + [texts[0], "", "ab", "e" * 300]
    pairs = [(i, j) for i in range(len(texts)) for j in range(len(texts)) if i < j and (i + j) % 5 or i > j and (i + j) % 5 == 0]
    full = {(i, j): T.longest_common(texts[i], texts[j]) for i, j in pairs}
    want = {(i, j) for i, j in pairs if texts[i] == texts[j] or 200.0 * full[i, j] / (len(texts[i]) + len(texts[j])) >= 85}
    assert 5 < len(want) < 12
    calls = []
    one = T.longest_common
    monkeypatch.setattr(T, "longest_common", lambda *a: calls.append(a) or one(*a))
    got = T.similar_texts(texts, pairs, 85)
    assert len(got) == len(set(got)) and set(got) == want
    if (fewest, at_work) == (1, 16_384):
        assert len(calls) < len(pairs) / 10


def test_a_subsequence_is_looked_for_near_the_diagonal():
    """With a least length the result is exact from there on and -1 below, whatever part of the table is left out; and only that part's places are held."""
    rng = random.Random(2)
    for _ in range(150):
        a = "".join(rng.choices("abcde", k=rng.randrange(1, 400)))
        b = changed(rng, a, rng.randrange(0, 1 + len(a) // 3)) + "x" * rng.randrange(40)
        if rng.random() < 0.5:
            a, b = b, a
        full = T.longest_common(a, b)
        for least in {1, full - 20, full - 1, full, full + 1}:
            if least > 0:
                assert T.longest_common(a, b, least) == (full if full >= least else -1)
