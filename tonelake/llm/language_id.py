"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from a hash of the letter. A letter n-gram is bound into one
vector by multiplying its letters' vectors, each rotated by its place; a text's vector is the bundle (sum) of its
n-grams' vectors, and a language's prototype the bundle of its training texts. The cosine between text and prototype
names the language. Runs of anything but letters count as one blank.

Bundling is linear, so a batch is one product of an n-gram count matrix with the vectors of the n-grams in it.

Defined results: null texts and texts without a letter get ``und`` and score 0. Ties go to the language first in
alphabetical order. Negative cosines score 0. With no training rows everything is ``und``. Language, source and id of
a row are never inputs of its prediction. Repeated rows are judged each; other columns are ignored, whatever their names. Very long texts are taken
whole: their n-grams are counted before anything is multiplied, so a text needs memory in proportion to its length. Empty tables give no prototypes and empty results.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import cut_batch, give_back, map_texts, sliced, small_batches

DIMENSIONS = 1024
NGRAM = 3
#: Distinct letters told apart; rarer scripts share slots by hash. Slot 0 is the blank.
SLOTS = 1024
#: Texts bundled in one matrix product.
BLOCK = 256
#: Bound of the training sample: rows of each language taken, in expectation.
FIT_ROWS = 3000
UNKNOWN = "und"
#: Cosines below three deviations of those of random vectors tell no language.
NOISE = 3 / DIMENSIONS**0.5


class Profiles:
    """Letter vectors, and how texts become counts of n-grams and bundles."""

    def __init__(self, dimensions: int = DIMENSIONS):
        rng = np.random.default_rng(20240501)
        self.letters = (rng.integers(0, 2, (SLOTS, dimensions), dtype=np.int8) * 2 - 1).astype(np.int8)
        self.slot_of = np.zeros(0x110000, np.uint16)
        self.known = np.zeros(0x110000, bool)

    def slots(self, text: str) -> np.ndarray:
        """Letter slots of a text, lower-cased, with single blanks between words and around all."""
        codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
        for code in np.unique(codes[~self.known[codes]]) if not self.known[codes].all() else ():
            letter = unicodedata.category(chr(code))[0] == "L"
            self.slot_of[code] = 1 + (zlib.crc32(chr(code).encode()) % (SLOTS - 1) if code >= 0x250 else code) if letter else 0
            self.known[code] = True
        slots = self.slot_of[codes]
        if not slots.any():
            return slots[:0]
        keep = (slots != 0) | np.r_[True, slots[:-1] != 0]
        slots = slots[keep]
        return np.r_[np.zeros(int(slots[0] != 0), np.uint16), slots, np.zeros(int(slots[-1] != 0), np.uint16)]

    def grams(self, text: str) -> np.ndarray:
        """One integer code for each n-gram occurrence; empty if there is no letter."""
        slots = self.slots(text).astype(np.int64)
        if len(slots) < NGRAM:
            return slots[:0]
        code = slots[: len(slots) - NGRAM + 1].copy()
        for k in range(1, NGRAM):
            code = code * SLOTS + slots[k : len(slots) - NGRAM + 1 + k]
        return code

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        """Bound vectors of n-gram codes."""
        bound = np.ones((len(codes), self.letters.shape[1]), np.int8)
        for k in range(NGRAM):
            slot = codes // SLOTS ** (NGRAM - 1 - k) % SLOTS
            bound *= np.roll(self.letters, k, axis=1)[slot]
        return bound

    def bundles(self, texts: list[str | None]) -> np.ndarray:
        """Bundled vectors, one row for each text."""
        grams = [self.grams(t) if t else np.zeros(0, np.int64) for t in texts]
        row = np.repeat(np.arange(len(texts)), [len(g) for g in grams])
        codes, at = np.unique(np.concatenate(grams) if grams else np.zeros(0, np.int64), return_inverse=True)
        out = np.zeros((len(texts), self.letters.shape[1]), np.float32)
        step = 2048  # n-grams in one product, so that its matrices stay small
        for a in range(0, len(codes), step):
            here = (at >= a) & (at < a + step)
            width = min(step, len(codes) - a)
            counts = np.bincount(row[here] * width + at[here] - a, minlength=len(texts) * width).reshape(len(texts), width)
            out += counts.astype(np.float32) @ self.vectors(codes[a : a + step]).astype(np.float32)
        return out


def fit(docs: DataFrame, training: Column, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = FIT_ROWS) -> dict[str, np.ndarray]:
    """Prototypes by language from the rows that ``training`` accepts.

    The sample is drawn by a hash of the id, ``fit_rows`` of each language in expectation (all, where there are fewer);
    each partition bundles its own rows, and only one vector for each language and partition is summed further.
    """
    rows = docs.filter(training & docs[lang_col].isNotNull()).select(docs[id_col].alias("id"), docs[lang_col].alias("lang"), docs[text_col].alias("text"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return {}
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, fit_rows / n))) for k, n in sorted(sizes.items())])
    chosen = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share * 1_000_000).select("lang", "text")

    def bundle(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        profiles, total = Profiles(), {}
        for frame in sliced(frames, "text"):
            for lang, part in frame.groupby("lang"):
                total[lang] = total.get(lang, 0) + profiles.bundles(part["text"].tolist()).sum(axis=0, dtype=np.float64)
        if total:
            yield pd.DataFrame({"lang": list(total), "vector": [v.tolist() for v in total.values()]})

    parts = map_texts(chosen, bundle, "lang string, vector array<double>")
    sums = parts.select("lang", F.posexplode("vector").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x"))
    out: dict[str, np.ndarray] = {}
    for r in sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("v")).collect():
        vector = np.array([x["x"] for x in r["v"]])
        if (norm := np.linalg.norm(vector)) > 0:
            out[r["lang"]] = vector / norm
    return dict(sorted(out.items()))


def named(vectors: np.ndarray, langs: list[str], matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The language and its score for each bundle."""
    norms = np.linalg.norm(vectors, axis=1)
    lang, score = np.full(len(vectors), UNKNOWN, object), np.zeros(len(vectors))
    if langs:
        # One factor for all languages, so it can be taken after the choice.
        dots = vectors @ matrix.T
        best = dots.argmax(axis=1)
        real = norms > 0
        lang[real] = np.array(langs, object)[best[real]]
        score[real] = np.clip(dots[np.arange(len(vectors)), best][real] / norms[real], 0, 1)
    return lang, score


def stacked(prototypes: dict[str, np.ndarray]) -> tuple[list[str], np.ndarray]:
    """Languages and their prototypes as the rows of a matrix."""
    langs = list(prototypes)
    return langs, np.array([prototypes[k] for k in langs], np.float32).reshape(len(langs), -1) if langs else np.zeros((0, DIMENSIONS), np.float32)


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for every row, from the whole text alone."""
    langs, matrix = stacked(prototypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        profiles = Profiles()
        for frame in sliced(frames, "text"):
            ids, texts = frame["id"].to_numpy(), frame["text"].tolist()
            for a in range(0, len(texts), BLOCK):
                part = texts[a : a + BLOCK]
                lang, score = named(profiles.bundles(part), langs, matrix)
                yield pd.DataFrame({id_col: ids[a : a + BLOCK], "lang_pred": lang, "score": score.astype(float)})

    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return map_texts(slim, run, f"`{id_col}` {kind}, lang_pred string, score double")


def recognised(docs: DataFrame, prototypes: dict[str, np.ndarray], *, text_col: str = "text", lang_col: str = "lang", least: float = NOISE) -> DataFrame:
    """The rows of ``docs`` to which ``predict`` gives a language with a score of ``least`` or more, in their columns, with that language in
    ``lang_col``; nothing is shuffled."""
    langs, matrix = stacked(prototypes)
    at, where = docs.columns.index(text_col), docs.columns.index(lang_col)
    arrow = to_arrow_schema(docs.schema)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = Profiles()
        for batch in batches:
            for part in cut_batch(batch, at):
                texts = part.column(at).to_pylist()
                for a in range(0, len(texts), BLOCK):
                    lang, score = named(profiles.bundles(texts[a : a + BLOCK]), langs, matrix)
                    keep = (lang != UNKNOWN) & (score >= least)
                    if keep.any():
                        rows = part.slice(a, BLOCK).filter(pa.array(keep))
                        columns = [pa.array(lang[keep].tolist(), arrow.types[k]) if k == where else rows.column(k).cast(arrow.types[k]) for k in range(rows.num_columns)]
                        yield pa.RecordBatch.from_arrays(columns, schema=arrow)
        give_back()

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: Column) -> Column:
    """A third of all ids, by checksum: these are never learned from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))
