"""Removal of repeated byte strings over a whole corpus, by suffix arrays.

A string of ``length`` bytes is repeated if it starts at another place too, in any document. Every byte inside a repeated
string is removed.

Suffixes have to meet to be compared, so each window of ``length`` bytes is filed under its anchor: of the hashes of all
``GRAM``-byte strings in the window the smallest, leftmost on ties. Equal windows have equal anchors. Windows in a row with the same
anchor form one context, the bytes that they span.

1. One pass over the texts gives a small row for each context: anchor hash, 128-bit BLAKE2 digest of its bytes, document, first and last window.
2. Anchors seen once are dropped, which leaves the repeated parts and chance matches.
3. Contexts equal as a whole are counted, and all their windows are repeated if there are two or more.
4. Where one anchor has different contexts, one representative of each is fetched, and the contexts of an anchor are put into one suffix array
   (two-stage sorting); a window is repeated if its suffix has a common prefix of ``length`` with a neighbour. Contexts are kept
   in whole anchor groups, of many anchors at a time.
5. An anchor with more than ``HOT`` different contexts is not gathered at once. Its contexts are cut again, by the next smallest hash in each window, and
   go through steps 3 to 5 under both hashes: equal windows agree in the next hash too, while what surrounds a common passage goes apart.
   After ``DEPTH`` cuts, or where a window has no further hash (text of one short period), a group is sorted whatever its size.
6. Ranges are gathered by document and taken out.

Defined results: null text counts as empty; documents shorter than ``length`` lose nothing. Repeated rows (same id and text) are two documents and
remove each other. Rows are told apart by id and text: an id may stand on different texts, and rows without an id take part and come back without one. Empty tables give
empty results; other columns are ignored, whatever their names. Very long texts are cut into overlapping parts for hashing. The bytes left need not be valid UTF-8, so they are given as bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import addressed, give_back, map_texts, sent, shuffle_partitions, sliced, stored
from .shingles import mix
from .suffix_sort import repeated, words

GRAM = 48
#: Bytes hashed together; longer documents are cut into overlapping parts, which changes contexts but no result.
PART_BYTES = 1_000_000
POSITION = np.uint64(2**21 - 1)
#: Bytes in one suffix array, about; contexts of one anchor beyond which they are cut again, and how often at most.
ARRAY_BYTES, HOT, DEPTH = 1_500_000, 2000, 6
#: Contexts cut again together.
CUT_TOGETHER = 2000
NONE = np.uint64(2**64 - 1)
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def gram_hashes(word: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each position on, from the words of eight bytes; the last GRAM - 1 places are void."""
    h8 = mix(word)
    h16 = h8[:-8] * _C[0] + h8[8:]
    h32 = h16[:-16] * _C[1] + h16[16:] * _C[2]
    n = len(word) - GRAM + 1
    return mix(h32[:n] * _C[3] + h16[32 : 32 + n] * _C[4])


def sliding_minimum(v: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while step * 2 <= width:
        v = np.minimum(v[:-step], v[step:])
        step *= 2
    return np.minimum(v[: len(v) - (width - step)], v[width - step :]) if step < width else v


def contexts(parts: list[bytes], length: int, used: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """(part, anchor hash, digest of the context's bytes, first window, last window) of all contexts; each part has at least ``length`` bytes. Hashes already ``used`` are no
    anchors; a window that has no other gets NONE."""
    raw = b"".join(parts)
    data = np.frombuffer(raw, np.uint8)
    sizes = np.array([len(p) for p in parts])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    word = words(data)
    grams = gram_hashes(word)
    if used:
        grams = np.where(np.isin(grams, np.array(used, np.int64).view(np.uint64)), NONE, grams)
    low = sliding_minimum((grams & ~POSITION) | np.arange(len(grams), dtype=np.uint64), length - GRAM + 1)
    windows = np.ones(len(low), np.int8)  # windows that cross documents don't count
    for e in ends[:-1]:
        windows[e - length + 1 : e] = 0
    at = np.flatnonzero(windows)
    anchor = (low[at] & POSITION).astype(np.int64)
    first = np.r_[True, (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)]
    lo = at[first]
    hi = at[np.r_[np.flatnonzero(first)[1:] - 1, len(at) - 1]]
    part = np.searchsorted(ends, lo, side="right")
    view = memoryview(raw)
    digest = [hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(lo.tolist(), (hi + length).tolist(), strict=True)]
    return part, grams[anchor[first]], digest, lo - starts[part], hi - starts[part]


def anchored(docs: DataFrame, length: int) -> DataFrame:
    """A row per context: doc, spot, key, digest, lo, hi (byte positions of the first and the last window)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in sliced(frames, "text"):
            parts: list[bytes] = []
            owner: list[tuple[int, int]] = []  # row, offset
            size = 0
            doc, spot = frame["doc"].to_numpy(np.int64), frame["spot"].to_numpy(np.int64)

            def flush() -> pd.DataFrame:
                part, key, digest, lo, hi = contexts(parts, length)
                row, offset = np.array([o[0] for o in owner]), np.array([o[1] for o in owner])
                return pd.DataFrame({"doc": doc[row[part]], "spot": spot[row[part]], "key": key.view(np.int64), "digest": digest, "lo": (lo + offset[part]).astype(np.int32), "hi": (hi + offset[part]).astype(np.int32)})

            for k, text in enumerate(frame["text"]):
                raw = (text or "").encode()
                for a in range(0, max(len(raw) - length + 1, 0), PART_BYTES):
                    piece = raw[a : a + PART_BYTES + length - 1]
                    if parts and size + len(piece) > PART_BYTES:
                        yield flush()
                        parts, owner, size = [], [], 0
                    parts.append(piece)
                    owner.append((k, a))
                    size += len(piece)
            if parts:
                yield flush()

    return map_texts(docs, run, "doc bigint, spot bigint, key bigint, digest binary, lo int, hi int")


def sorted_ranges(rows: DataFrame, length: int) -> DataFrame:
    """(doc, spot, lo, hi): ranges of repeated windows of contexts seen once. ``rows``: key, doc, spot, lo, n, context; sorted by the first four."""

    def judge(held: list[tuple]) -> Iterator[pd.DataFrame]:
        # Bytes of UTF-8 are below 0xF5, so 1 can be added and 0 parts contexts.
        data = np.zeros(sum(len(r[5]) + 1 for r in held), np.uint8)
        valid = np.zeros(len(data), bool)
        at, places = 0, []
        for r in held:
            n = len(r[5])
            data[at : at + n] = np.frombuffer(r[5], np.uint8) + np.uint8(1)
            valid[at : at + n - length + 1] = True
            places.append(at)
            at += n + 1
        found = repeated(data, valid, length)
        docs, spots, los, his = [], [], [], []
        for r, at in zip(held, places, strict=True):
            if r[4] > 1:
                continue
            mine = found[at : at + len(r[5]) - length + 1]
            if mine.any():
                edge = np.flatnonzero(np.diff(np.r_[False, mine, False].astype(np.int8)))
                docs += [r[1]] * (len(edge) // 2)
                spots += [r[2]] * (len(edge) // 2)
                los += (edge[::2] + r[3]).tolist()
                his += (edge[1::2] - 1 + r[3]).tolist()
        if docs:
            yield pd.DataFrame({"doc": docs, "spot": spots, "lo": los, "hi": his}).astype({"lo": np.int32, "hi": np.int32})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        size, key = 0, None
        for frame in frames:
            for row in zip(*[frame[c].tolist() for c in ("key", "doc", "spot", "lo", "n", "context")], strict=True):
                if held and held[-1][:4] == row[:4]:  # repeated rows: one stands for all
                    continue
                if size > ARRAY_BYTES and row[0] != key:
                    yield from judge(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
                key = row[0]
        if held:
            yield from judge(held)

    return rows.mapInPandas(run, "doc bigint, spot bigint, lo int, hi int")


def cut_again(rows: DataFrame, length: int) -> DataFrame:
    """Contexts (path, n, doc, spot, lo, context) cut by the next hash: path, digest, n, doc, spot, lo, hi, context. ``path``: the hashes used so far."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, group in frame.groupby(frame["path"].map(tuple), sort=False):
                raw = [bytes(c) for c in group["context"]]
                for a in range(0, len(raw), CUT_TOGETHER):
                    some = raw[a : a + CUT_TOGETHER]
                    part, key, digest, lo, hi = contexts(some, length, path)
                    own = group.iloc[a : a + CUT_TOGETHER].iloc[part]
                    pieces = [some[k][x : y + length] for k, x, y in zip(part.tolist(), lo.tolist(), hi.tolist(), strict=True)]
                    first = own["lo"].to_numpy()
                    yield pd.DataFrame({"path": [[*path, k] for k in key.view(np.int64).tolist()], "digest": digest, "n": own["n"].to_numpy(), "doc": own["doc"].to_numpy(), "spot": own["spot"].to_numpy(), "lo": (first + lo).astype(np.int32), "hi": (first + hi).astype(np.int32), "context": pieces})
        give_back()

    return rows.mapInPandas(run, "path array<bigint>, digest binary, n bigint, doc bigint, spot bigint, lo int, hi int, context binary")


def within_groups(rows: DataFrame, length: int, hot: int, any_hot: bool) -> DataFrame:
    """(doc, spot, lo, hi): ranges of repeated windows of contexts seen once. ``rows``: path, many (contexts of that path), n, doc, spot, lo, context."""
    n = shuffle_partitions(rows.sparkSession)

    def in_arrays(few: DataFrame) -> DataFrame:
        few = few.select(F.xxhash64("path").alias("key"), "doc", "spot", "lo", "n", "context")
        return sorted_ranges(few.repartition(n, "key").sortWithinPartitions("key", "doc", "spot", "lo"), length)

    found = in_arrays(rows.filter(F.col("many") <= hot))
    if not any_hot:
        return found
    rows = stored(rows.filter(F.col("many") > hot).drop("many"), "hot")
    for depth in range(DEPTH):
        if rows.isEmpty():
            return found
        spread = rows.repartition(n, F.xxhash64("doc", "spot", "lo"))
        cut = stored(cut_again(spread, length).withColumn("key", F.xxhash64("path")), "cut")
        classes = cut.groupBy("key", "digest").agg(F.sum("n").alias("times"), F.min(F.struct("doc", "spot", "lo", "hi")).alias("one"))
        classes = stored(classes, "classes")
        equal = sent(stored(classes.filter("times > 1").select("key", "digest"), "equal"))
        found = found.unionByName(cut.filter("n = 1").join(equal, ["key", "digest"]).select("doc", "spot", "lo", "hi"))
        mixed = sent(stored(classes.groupBy("key").agg(F.count("*").alias("many")).filter("many > 1"), "mixed"))
        wanted = sent(stored(classes.join(mixed, "key").select("key", "digest", "times", "many", "one.*"), "wanted"))
        reps = cut.join(wanted, ["key", "digest", "doc", "spot", "lo", "hi"]).select("path", "many", F.col("times").alias("n"), "doc", "spot", "lo", "context")
        final = (F.col("many") <= hot) | (F.element_at("path", -1) == -1) | F.lit(depth == DEPTH - 1)
        reps = stored(reps.withColumn("final", final), "reps")
        found = found.unionByName(in_arrays(reps.filter("final")))
        rows = reps.filter("not final").drop("many", "final")
    return found


def repeated_ranges(docs: DataFrame, length: int, hot: int = HOT) -> DataFrame:
    """(doc, spot, lo, hi): ranges of first bytes of repeated strings; ``docs``: doc, spot, text."""
    anchors = stored(anchored(docs, length), "anchors")
    seen = stored(anchors.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "keys")
    found = stored(anchors.join(sent(seen), "key", "left_semi"), "found")
    classes = found.groupBy("key", "digest").agg(F.count("*").alias("n"), F.min(F.struct("doc", "spot", "lo", "hi")).alias("one"))
    classes = stored(classes.select("key", "digest", "n", "one.*"), "classes")
    equal = stored(classes.filter("n > 1").select("key", "digest"), "equal")
    whole = found.join(sent(equal), ["key", "digest"]).select("doc", "spot", "lo", "hi")
    mixed = stored(classes.groupBy("key").agg(F.count("*").alias("many")).filter("many > 1"), "mixed")
    wanted = stored(classes.join(sent(mixed), "key").select("key", "n", "many", "doc", "spot", "lo", "hi"), "wanted")
    slim = F.encode(F.col("text"), "utf-8")
    span = F.substring(slim, F.col("lo") + 1, F.col("hi") - F.col("lo") + length)
    rows = docs.join(sent(wanted), ["doc", "spot"]).select(F.array("key").alias("path"), "many", "n", "doc", "spot", "lo", span.alias("context"))
    any_hot = not wanted.filter(F.col("many") > hot).isEmpty()
    return whole.unionByName(within_groups(rows, length, hot, any_hot))


def remove_repeats(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 200, keep_bytes: bool = True) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256[, spans, kept]) for every row; ``spans`` are the removed runs (start, stop)."""
    if length % 8 or length <= GRAM:
        raise ValueError(f"the length must be a multiple of 8 above {GRAM}")
    docs = addressed(df, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    ranges = stored(repeated_ranges(docs, length), "ranges")
    lists = stored(ranges.groupBy("doc", "spot").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges")), "lists")
    joined = docs.join(lists, ["doc", "spot"], "left").select("doc", "known", "text", F.col("ranges.lo").alias("lo"), F.col("ranges.hi").alias("hi"))
    out = cut_out(joined, length, keep_bytes)
    return out.select(F.when(F.col("known"), F.col("doc")).alias(id_col), *out.columns[2:])


def cut_out(rows: DataFrame, length: int, keep_bytes: bool) -> DataFrame:
    """Takes the bytes covered by the windows out of each text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in sliced(frames, "text"):
            out = []
            for text, lo, hi in zip(frame["text"].tolist(), frame["lo"].tolist(), frame["hi"].tolist(), strict=True):
                raw = (text or "").encode()
                spans: list[list[int]] = []
                for a, b in sorted(zip(lo, hi, strict=True)) if lo is not None else ():
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], b + length)
                    else:
                        spans.append([a, b + length])
                edges = [0, *(x for s in spans for x in s), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                row = (len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
                out.append((*row, spans, kept) if keep_bytes else row)
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *(("spans", "kept") if keep_bytes else ())]
            result = pd.DataFrame(out, columns=names)
            result.insert(0, "doc", frame["doc"].to_numpy())
            result.insert(1, "known", frame["known"].to_numpy())
            yield result

    more = ", spans array<array<int>>, kept binary" if keep_bytes else ""
    return map_texts(rows, run, f"doc bigint, known boolean, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string{more}")
