import math
import random
import re
import zlib
from collections import Counter

import pytest
from oracle import SF_SMALL
from pyspark.sql import functions as F

from tonelake.llm import language_id, queries, toxicity

ORDER, SHARED = toxicity.ORDER, toxicity.SHARED


def expressions(text):
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    return list(dict.fromkeys(zip(["", *words], words)))


class Brute:
    """The models by dictionaries, a letter at a time."""

    def __init__(self, ordinary, toxic):
        self.own, longest = [], []
        for texts in (ordinary, toxic):
            counts = Counter()
            for _, word in {e for t in texts for e in expressions(t)}:
                counts.update(self.letters(word))
            levels = {}
            for n in range(ORDER, SHARED, -1):
                levels[n] = counts
                last, counts = counts, Counter(s[1:] for s in counts)
            longest += last
            self.own.append(levels)
        self.shared, kinds = {}, set(longest)
        for n in range(SHARED, 0, -1):
            self.shared[n] = Counter(s[1:] for s in kinds)
            kinds = set(self.shared[n])

    def letters(self, word):
        whole = "#" * (ORDER - 1) + word + "#"
        return [whole[i : i + ORDER] for i in range(len(whole) - ORDER + 1)]

    def chance(self, k, s):
        p = 1 / toxicity.SLOTS
        for n in range(1, ORDER + 1):
            counts, part = (self.shared if n <= SHARED else self.own[k])[n], s[ORDER - n :]
            once, twice = sum(c == 1 for c in counts.values()), sum(c == 2 for c in counts.values())
            d = min(max(once / (once + 2 * twice), 0.1), 0.95) if once else 0.5
            context = {g: c for g, c in counts.items() if g[:-1] == part[:-1]}
            if context:
                total = sum(context.values())
                p = max(counts[part] - d, 0) / total + d * len(context) / total * p
        return p

    def word(self, word):
        return sum(math.log(self.chance(1, s) / self.chance(0, s)) for s in self.letters(word))

    def evidence(self, text):
        values = [self.word(w) for _, w in expressions(text)]
        if len(values) <= toxicity.WINDOW:
            return sum(values) / (len(values) + toxicity.NEUTRAL)
        starts = {*range(0, len(values) - toxicity.WINDOW, toxicity.WINDOW // 2), len(values) - toxicity.WINDOW}
        return max(sum(values[s : s + toxicity.WINDOW]) for s in starts) / (toxicity.WINDOW + toxicity.NEUTRAL)


def invented(seed, n, bad=()):
    rng = random.Random(seed)
    words = [rng.choice(["the", "sea", "and", "éte", "日本", "stone", "hill", "öl"]) + rng.choice(["", "s", "ing", "ed"]) for _ in range(n)]
    for w in bad:
        words.insert(rng.randrange(len(words) + 1), w)
    return " ".join(words)


BAD = ["vexgrul", "vexgrols", "krompf"]
LABELLED = [(i, invented(i, 30), 0) for i in range(60)] + [(100 + i, invented(i + 500, 30, random.Random(i).sample(BAD, 2)), 1) for i in range(40)]


def tables(spark, rows, labels=None):
    docs = spark.createDataFrame([(i, t, "x", 1.0, 5) for i, t, *_ in rows], "doc_id bigint, text string, word string, evidence double, toxic int")
    return docs, spark.createDataFrame(labels if labels is not None else [(i, 1, y) for i, _, y in rows], "doc_id bigint, quality int, toxic int")


def test_like_brute_force(spark):
    docs, labels = tables(spark, LABELLED)
    models = toxicity.fit(docs, labels, F.lit(True))
    curve = {r.doc_id for r in docs.filter(F.pmod(F.xxhash64("doc_id", F.lit("curve")), F.lit(toxicity.CURVE_PART)) == 0).collect()}
    brute = Brute(*[[t for i, t, y in LABELLED if y == k and i not in curve] for k in (0, 1)])
    odd = [None, "", "123 __ !", "vexgrul", "Vexgrols KROMPF vexgrols", "unseen wörds あ", "a" * 300, invented(7, 300, BAD), invented(8, 65)]
    got = toxicity.Reader(models).read(odd)
    assert got == pytest.approx([brute.evidence(t) for t in odd], abs=1e-9)
    rows = toxicity.scores(tables(spark, list(enumerate(odd)), [])[0], models).collect()
    assert [r.score for r in sorted(rows)] == pytest.approx([1 / (1 + math.exp(-models.slope * (brute.evidence(t) - models.middle))) for t in odd], abs=1e-9)
    assert rows[3].score > 0.9 and rows[7].score > 0.5 and rows[8].score < 0.2 and rows[0].score < 0.2


def test_curve_lies_between_the_labels():
    import numpy as np

    middle, slope = toxicity.fitted_curve(np.array([0.0, 0.1, 0.9, 1.0]), np.array([False, False, True, True]))
    assert 0.1 < middle < 0.9 and slope > 0
    assert toxicity.fitted_curve(np.array([1.0, 0.0]), np.array([False, True])) == (toxicity.MIDDLE, toxicity.SLOPE)
    assert toxicity.fitted_curve(np.zeros(0), np.zeros(0, bool)) == (toxicity.MIDDLE, toxicity.SLOPE)


@pytest.mark.parametrize("labels, share", [([], 0.0), ([(1, 1, 1)], 1.0), ([(1, 1, 0), (2, 1, None)], 0.0), ([(1, 1, 1), (2, 1, 0), (3, 1, 0), (4, 1, 0), (None, 1, 1)], 0.25)])
def test_without_words_of_both_labels(spark, labels, share):
    docs, known = tables(spark, [(1, "a word"), (2, None), (3, ""), (None, "x" * 100_000)], labels)
    models = toxicity.fit(docs, known, F.lit(True))
    assert models == share
    assert sorted((str(r.doc_id), r.score) for r in toxicity.scores(docs, models).collect()) == [(i, share) for i in ("1", "2", "3", "None")]
    assert toxicity.scores(docs.limit(0), models).count() == 0


def test_repeated_rows_and_long_texts(spark):
    docs, labels = tables(spark, LABELLED)
    models = toxicity.fit(docs, labels.unionByName(labels), F.lit(True))
    assert models.own[1][0].code.tolist() == toxicity.fit(docs, labels, F.lit(True)).own[1][0].code.tolist()
    long = invented(3, 40_000) + " krompf vexgrul vexgrols " + invented(4, 40_000)
    rows = toxicity.scores(tables(spark, [(1, long), (1, long), (2, invented(3, 40_000))], [])[0], models).collect()
    by_id = {r.doc_id: r.score for r in rows}
    assert len(rows) == 3 and by_id[1] > 0.6 > 0.2 > by_id[2]


def test_labels_of_held_out_rows_are_never_read(spark):
    docs, labels = tables(spark, LABELLED)
    kept = [r for r in LABELLED if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    flipped = [(i, 1, y if (i, t, y) in kept else 1 - y) for i, t, y in LABELLED]
    a, b = (toxicity.fit(docs, known, ~language_id.held_out(F.col("id"))) for known in (labels, tables(spark, LABELLED, flipped)[1]))
    assert (a.middle, a.slope) == (b.middle, b.slope) and all((x.code == y.code).all() and (x.share == y.share).all() for p, q in zip(a.own, b.own) for x, y in zip(p, q))


def test_query_on_held_out_rows(spark):
    """Of the held-out labels no ordinary row is called toxic; of the toxic ones those with words that the training rows have are found."""
    sf = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in queries.op12_toxicity(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7) for i, r in rows.items())
    found = Counter((r.toxic, rows[r.doc_id].predicted) for r in labels if r.toxic is not None and rows[r.doc_id].held_out)
    assert found[0, 1] <= 0.005 * (found[0, 0] + found[0, 1]) and found[1, 1] >= 0.4 * (found[1, 0] + found[1, 1])


def test_query_has_all_rows(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    out = queries.op12_toxicity(spark, SF_SMALL)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and out.count() == docs.count()
    assert out.filter("score < 0 or score > 1 or score is null").count() == 0
