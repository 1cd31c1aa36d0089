"""Toxicity by two Kneser-Ney models of spelling, one of toxic and one of ordinary texts.

An expression is a word (a run of letters, lower-cased) at one place: word and predecessor. Each class has a model of how its words are spelled, letter by
letter with the ``ORDER`` - 1 letters before. Orders above ``SHARED`` are the class's own; the orders below are one backoff for both classes, from continuation
counts over all their letter sequences, so sequences that neither class has seen cost both the same. A word counts in its class as often as it has different predecessors, which copies
of a text don't raise.

A text's different expressions, in the order of their first places, are read in windows of ``WINDOW``, half of each shared with the next, up to the last one. A window's evidence is
its log-likelihood under the toxic model less that under the ordinary one, divided by its length and ``NEUTRAL`` words more; the window with the
most evidence decides. So a long text with one toxic passage is found, and words repeated without end count once. A logistic curve, fitted on rows left out of
the counts, turns evidence into a score.

Learning takes a bounded sample, drawn by a hash of the id: about ``TOXIC_ROWS`` rows of label 1 and ``ORDINARY_ROWS`` of label 0. Scoring reads every text whole.

Defined results: rows whose label is null are not learned from; an id labelled more than once is toxic if one of its labels is. Null and empty texts and texts without letters have no
evidence: 0, whose score the curve gives. Where one of the labels has no row with a word, every score is the share of label 1 among the labelled rows, 0 without any. Label, language, source and id of a row are never inputs
of its score. Repeated rows are scored each; rows without an id are scored like others. Very long texts are scored whole. Empty tables give empty results; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts, sliced

WORD = re.compile(r"[^\W\d_]+")
#: Letters in a sequence, and the highest order whose counts both classes share.
ORDER, SHARED = 5, 2
#: Letters told apart; rarer scripts share slots by hash. Slot 0 is a word's edge.
SLOTS, PLAIN = 1024, 592
#: Expressions in a window, and words without evidence added to each.
WINDOW, NEUTRAL = 64, 16
#: Bounds of the sample learned from, in expectation, and the part of it that fits the curve.
TOXIC_ROWS, ORDINARY_ROWS, CURVE_PART = 3000, 9000, 5
#: The curve where the part left for it has only one label: evidence at its middle, and its slope.
MIDDLE, SLOPE = 0.4, 15.0
#: Words whose evidence is kept, and the longest that are.
MEMO_WORDS, MEMO_LETTERS = 200_000, 40
#: Bits of a letter in a sequence's code.
BITS = 10


def slots_of(text: str) -> np.ndarray:
    """A slot from 1 on for each letter."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    for code in np.unique(codes[codes >= PLAIN]).tolist():
        codes[codes == code] = -(PLAIN + zlib.crc32(chr(code).encode()) % (SLOTS - PLAIN))
    return np.abs(codes)


def sequences(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the ``ORDER`` letters up to each letter and up to the end of each word, and the word of each."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    edge = ORDER - 1
    flat = np.zeros(int(sizes.sum()) + (edge + 1) * len(words), np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + edge + 1)])[:-1] + edge
    owner = np.repeat(np.arange(len(words)), sizes)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    flat[starts[owner] + within] = slots_of("".join(words))
    code = np.zeros(max(len(flat) - edge, 0), np.int64)
    for k in range(ORDER):
        code = (code << BITS) | flat[k : k + len(code)]
    word = np.repeat(np.arange(len(words)), sizes + 1)
    at = np.arange(len(word)) - np.repeat(np.cumsum(sizes + 1) - (sizes + 1), sizes + 1)
    return code[starts[word] - edge + at], word


def expressions(text: str | None) -> list[tuple[str, str]]:
    """(predecessor, word) of a text, each once."""
    words = WORD.findall((text or "").lower())
    return list(dict.fromkeys(zip(["", *words], words, strict=False)))


@dataclass
class Order:
    """Counts of the sequences of one order: discounted share of each sequence, and what each context leaves to the order below."""

    code: np.ndarray
    share: np.ndarray
    context: np.ndarray
    rest: np.ndarray

    @classmethod
    def of(cls, code: np.ndarray, count: np.ndarray) -> Order:
        once, twice = int((count == 1).sum()), int((count == 2).sum())
        discount = min(max(once / (once + 2 * twice), 0.1), 0.95) if once else 0.5
        context, at = np.unique(code >> BITS, return_inverse=True)
        total = np.bincount(at, count, len(context))
        kinds = np.bincount(at, minlength=len(context))
        return cls(code, np.maximum(count - discount, 0) / total[at], context, discount * kinds / total)

    def smooth(self, code: np.ndarray, below: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
        share = np.where(self.code[at] == code, self.share[at], 0.0)
        above = code >> BITS
        at = np.minimum(np.searchsorted(self.context, above), len(self.context) - 1)
        rest = np.where(self.context[at] == above, self.rest[at], 1.0)
        return share + rest * below


def shortened(code: np.ndarray, order: int) -> np.ndarray:
    """Sequences without their first letters."""
    return code & ((1 << (BITS * order)) - 1)


@dataclass
class Models:
    """Both classes' orders above the shared ones (ordinary first), the shared orders, and the curve."""

    own: tuple[list[Order], list[Order]]
    shared: list[Order]
    middle: float = MIDDLE
    slope: float = SLOPE

    @classmethod
    def of(cls, ordinary: tuple[np.ndarray, np.ndarray], toxic: tuple[np.ndarray, np.ndarray]) -> Models:
        """From (codes, counts) of the longest sequences of each class, sorted by code."""
        own: tuple[list[Order], list[Order]] = ([], [])
        lowest = []
        for orders, (code, count) in zip(own, (ordinary, toxic), strict=True):
            for order in range(ORDER, SHARED, -1):
                orders.insert(0, Order.of(code, count))
                longer, (code, count) = code, np.unique(shortened(code, order - 1), return_counts=True)
            lowest.append(longer)
        shared: list[Order] = []
        code = np.union1d(*lowest)
        for order in range(SHARED, 0, -1):
            code, count = np.unique(shortened(code, order), return_counts=True)
            shared.insert(0, Order.of(code, count))
        return cls(own, shared)

    def evidence(self, words: list[str]) -> np.ndarray:
        """The log-likelihood of each word under the toxic model less that under the ordinary one."""
        code, word = sequences(words)
        p = np.full(len(code), 1.0 / SLOTS)
        for k, order in enumerate(self.shared):
            p = order.smooth(shortened(code, k + 1), p)
        logs = []
        for orders in self.own:
            q = p
            for k, order in enumerate(orders):
                q = order.smooth(shortened(code, SHARED + 1 + k), q)
            logs.append(np.log(q))
        return np.bincount(word, logs[1] - logs[0], len(words))

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (evidence - self.middle), -500, 500)))


class Reader:
    """Evidence of texts; words once seen are kept."""

    def __init__(self, models: Models):
        self.models = models
        self.memo: dict[str, float] = {}

    def read(self, texts: list[str | None]) -> np.ndarray:
        found = [[word for _, word in expressions(t)] for t in texts]
        new = list({w for words in found for w in words if w not in self.memo})
        if len(self.memo) + len(new) > MEMO_WORDS:
            self.memo.clear()
            new = list({w for words in found for w in words})
        if new:
            self.memo.update(zip(new, self.models.evidence(new).tolist(), strict=True))
        out = np.array([strongest(np.fromiter(map(self.memo.__getitem__, words), float, len(words))) for words in found])
        for w in new:
            if len(w) > MEMO_LETTERS:
                del self.memo[w]
        return out


def strongest(evidence: np.ndarray) -> float:
    """The evidence of the window that has most, by its length."""
    n = len(evidence)
    sums = np.concatenate([[0.0], np.cumsum(evidence)])
    if n <= WINDOW:
        return float(sums[-1] / (n + NEUTRAL))
    starts = np.append(np.arange(0, n - WINDOW, WINDOW // 2), n - WINDOW)
    return float((sums[starts + WINDOW] - sums[starts]).max() / (WINDOW + NEUTRAL))


def fitted_curve(evidence: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Middle and slope of a logistic curve through labelled evidence, by Newton steps; labels count as slightly less than sure, so that a clean cut has a
    finite slope."""
    many = int(toxic.sum())
    few = len(toxic) - many
    if not many or not few:
        return MIDDLE, SLOPE
    goal = np.where(toxic, (many + 1) / (many + 2), 1 / (few + 2))
    x = np.column_stack([evidence, np.ones(len(evidence))])
    w = np.array([SLOPE, -SLOPE * MIDDLE])
    prior = np.diag([1e-4, 1e-4])
    loss = lambda v: float(np.logaddexp(0, x @ v).sum() - goal @ (x @ v) + 0.5 * v @ prior @ v)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        slope = x.T @ (p - goal) + prior @ w
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + prior, slope)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return (float(-w[1] / w[0]), float(w[0])) if w[0] > 0 else (MIDDLE, SLOPE)


def fit(docs: DataFrame, labels: DataFrame, training: Column, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Models | float:
    """The models of the labelled rows whose id ``training``, a column over ``id``, accepts; the share of label 1 where a class has no words."""
    known = labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("toxic")).filter("id is not null and toxic is not null")
    known = known.filter(training).groupBy("id").agg(F.max("toxic").alias("toxic")).filter("toxic in (0, 1)")
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = sizes.get(1, 0) / max(sum(sizes.values()), 1)
    if len(sizes) < 2:
        return share
    part = F.when(F.col("toxic") == 1, F.lit(min(1.0, TOXIC_ROWS / sizes[1]))).otherwise(F.lit(min(1.0, ORDINARY_ROWS / sizes[0])))
    picked = known.filter(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1_000_000)) < part * 1_000_000)
    picked = picked.withColumn("curve", F.pmod(F.xxhash64("id", F.lit("curve")), F.lit(CURVE_PART)) == 0)
    # Broadcast: about TOXIC_ROWS + ORDINARY_ROWS ids.
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).join(F.broadcast(picked), "id").select("toxic", "curve", "text").filter("text is not null")

    def words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in sliced(frames, "text"):
            found = {(k, *pair) for k, text in zip(frame["toxic"].tolist(), frame["text"].tolist(), strict=True) for pair in expressions(text)}
            yield pd.DataFrame(sorted(found), columns=["toxic", "before", "word"])

    def spelled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in sliced(frames, "word"):
            for toxic, own in frame.groupby("toxic"):
                code, at = sequences(own["word"].tolist())
                code, where = np.unique(code, return_inverse=True)
                yield pd.DataFrame({"toxic": np.full(len(code), toxic), "code": code, "n": np.bincount(where, own["n"].to_numpy()[at], len(code)).astype(np.int64)})

    seen = map_texts(rows.filter("not curve").select("toxic", "text"), words, "toxic int, before string, word string").distinct()
    counted = map_texts(seen.groupBy("toxic", "word").agg(F.count("*").alias("n")), spelled, "toxic int, code bigint, n bigint", "word")
    table = counted.groupBy("toxic", "code").agg(F.sum("n").alias("n")).toPandas().sort_values("code")
    codes = [(own["code"].to_numpy(np.int64), own["n"].to_numpy(np.int64)) for own in (table[table["toxic"] == k] for k in (0, 1))]
    if not all(len(code) for code, _ in codes):
        return share
    models = Models.of(*codes)

    def judged(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(models)
        for frame in sliced(frames, "text"):
            yield pd.DataFrame({"toxic": frame["toxic"].to_numpy(), "evidence": reader.read(frame["text"].tolist())})

    curve = map_texts(rows.filter("curve").select("toxic", "text"), judged, "toxic int, evidence double").orderBy("evidence", "toxic").toPandas()
    models.middle, models.slope = fitted_curve(curve["evidence"].to_numpy(float), curve["toxic"].to_numpy() == 1)
    return models


def scores(docs: DataFrame, models: Models | float, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row, from the whole text alone."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = None if isinstance(models, float) else Reader(models)
        for frame in sliced(frames, "text"):
            score = np.full(len(frame), models) if reader is None else models.score(reader.read(frame["text"].tolist()))
            yield pd.DataFrame({id_col: frame["id"].to_numpy(), "score": score})

    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return map_texts(slim, run, f"`{id_col}` {kind}, score double")
