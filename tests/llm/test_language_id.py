import unicodedata
import zlib
from collections import Counter

import numpy as np
from oracle import SF, SF_SMALL
from pyspark.sql import functions as F

from tonelake.llm import language_id, queries


def naive_bundle(profiles, text):
    """One n-gram at a time."""
    slots = profiles.slots(text)
    total = np.zeros(profiles.letters.shape[1])
    for i in range(len(slots) - language_id.NGRAM + 1):
        v = np.ones_like(total)
        for k in range(language_id.NGRAM):
            v = v * np.roll(profiles.letters[slots[i + k]], k)
        total += v
    return total


def brute_predictions(rows):
    """(language, score) of each (text, language or None, learned from) by definition: letters, then n-grams, then sums, then cosines, one at a time."""
    random = np.random.default_rng(20240501).integers(0, 2, (language_id.SLOTS, language_id.DIMENSIONS), dtype=np.int8) * 2 - 1
    rolled = [np.roll(random, k, axis=1).astype(float) for k in range(3)]
    vectors = {}

    def slot(ch):
        if unicodedata.category(ch)[0] != "L":
            return 0
        return ord(ch) + 1 if ord(ch) < 0x250 else 1 + zlib.crc32(ch.encode()) % (language_id.SLOTS - 1)

    def bundle(text):
        slots = [0]
        for s in [slot(ch) for ch in (text or "").lower()] + [0]:
            if s or slots[-1]:
                slots.append(s)
        total = np.zeros(language_id.DIMENSIONS)
        for gram, n in Counter(zip(slots, slots[1:], slots[2:], strict=False)).items():
            if gram not in vectors:
                vectors[gram] = rolled[0][gram[0]] * rolled[1][gram[1]] * rolled[2][gram[2]]
            total += n * vectors[gram]
        return total

    bundles = [bundle(t) for t, *_ in rows]
    sums = {}
    for b, (_, lang, learn) in zip(bundles, rows, strict=True):
        if learn and lang is not None:
            sums[lang] = sums.get(lang, 0) + b
    out = []
    for b in bundles:
        cosines = {k: float(b @ v / np.linalg.norm(b) / np.linalg.norm(v)) for k, v in sorted(sums.items()) if b.any() and v.any()}
        best = max(cosines, key=cosines.get, default="und")
        out.append((best, max(0.0, cosines.get(best, 0.0))))
    return out


def test_query_like_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    wanted = brute_predictions([(r.text, r.lang, zlib.crc32(str(r.doc_id).encode()) % 3 != 1) for r in docs])
    got = {r.doc_id: r for r in queries.op6_language_id(spark, SF_SMALL).collect()}
    assert len(got) == len(docs) == 200
    for r, (lang, score) in zip(docs, wanted, strict=True):
        assert got[r.doc_id].lang_pred == lang and abs(got[r.doc_id].score - score) < 1e-4
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_odd_rows_like_brute_force(docs):
    train = [(1, "the and of to in that is"), (2, "that of the in and"), (3, "1 2 3")]
    rows = [(10, None), (11, ""), (12, "12 !"), (13, "of the that"), (14, "Σίσυφος 漢字"), (15, "é" * 70_000), (16, "x"), (17, "\ufdfa ß İI")]
    frame = docs(train).unionByName(docs([(4, "der und das ist nicht"), (5, "das der die")], lang="de")).unionByName(docs(rows))
    found = language_id.fit(frame, F.col("doc_id") < 10)
    given = [(t, "de" if i in (4, 5) else "en", i < 10) for i, t in [*train, (4, "der und das ist nicht"), (5, "das der die"), *rows]]
    wanted = brute_predictions(given)[5:]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(docs(rows), found).collect()}
    for (i, _), (lang, score) in zip(rows, wanted, strict=True):
        assert got[i][0] == lang and abs(got[i][1] - score) < 1e-4, i


def test_bundles_like_one_by_one():
    profiles = language_id.Profiles()
    texts = ["Hello, world", "", None, "été 123 où?", "漢字 かな", "...", "a" * 3000]
    got = profiles.bundles(texts)
    for row, text in zip(got, texts, strict=True):
        assert np.allclose(row, naive_bundle(profiles, text) if text else 0)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = queries.op6_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(rows) > 200 and sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_held_out_rule(spark):
    for r in spark.range(50).select("id", language_id.held_out(F.col("id")).alias("h")).collect():
        assert r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1)


def test_edges(docs):
    train = docs([(i, "the and of to in that is was for with " * 3) for i in range(5)]).unionByName(docs([(10 + i, "der und die das nicht ein ist von mit sich " * 3) for i in range(5)], lang="de"))
    found = language_id.fit(train, F.lit(True))
    assert list(found) == ["de", "en"]
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, "und die nicht"), (5, "the with that " * 50_000), (5, "the with that"), (None, "a")]
    got = [(r.doc_id, r.lang_pred) for r in language_id.predict(docs(rows), found).collect()]
    assert sorted(got, key=str) == sorted([(1, "und"), (2, "und"), (3, "und"), (4, "de"), (5, "en"), (5, "en"), (None, got[-1][1])], key=str)
    kept = language_id.recognised(docs(rows), found, least=0.0).collect()
    assert sorted(((r.doc_id, r.lang) for r in kept), key=str) == sorted(((i, k) for i, k in got if k != "und"), key=str)
    assert language_id.predict(docs([]), found).count() == 0


def test_nothing_to_learn_from(docs):
    assert language_id.fit(docs([]), F.lit(True)) == {}
    assert language_id.predict(docs([(1, "abc")]), {}).first().lang_pred == "und"


def test_recognised_is_what_predict_names(docs):
    """Rows and languages follow from the prototypes alone, whatever the label says."""
    rows = docs([(1, "one two three"), (2, "123"), (3, None), (4, "drei vier"), (5, "zzz qqq"), (6, "")], lang="it")
    usual = language_id.fit(docs([(9, "one two three four")]), F.lit(True))
    both = usual | language_id.fit(docs([(9, "eins zwei drei vier")], lang="de"), F.lit(True))
    seen = set()
    for prototypes in (usual, both, {"und": usual["en"]}, {"xx": -usual["en"]}):
        for least in (0.0, language_id.NOISE, 0.9):
            wanted = {(r.doc_id, r.lang_pred) for r in language_id.predict(rows, prototypes).filter(f"lang_pred <> 'und' and score >= {least}").collect()}
            kept = language_id.recognised(rows, prototypes, least=least)
            assert kept.columns == rows.columns and {(r.doc_id, r.lang) for r in kept.collect()} == wanted
            seen.add(frozenset(wanted))
    assert len(seen) > 4
