"""Text columns: normalising, tokens, SimHash, fingerprints, classification of messages and extractions."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

#: Whether characters classes cover all of Unicode must be said in Java patterns.
UNICODE, DOT_ALL = "(?U)", "(?Us)"
# Compliance boilerplate of the channels, as patterns.
BOILERPLATE = (
    r"위\s*내용은.*?승인이\s*이뤄진\s*내용입니다\.?",
    r"위\s*내용은.*?승인이\s*이루어진\s*내용입니다\.?",
    r"제공해\s*드린\s*조사분석자료는.*?없습니다\.?",
    r"본\s*조사자료는.*?없습니다\.?",
    r"위\s*문자의\s*내용은\s*컴플라이언스의\s*승인을\s*득하였음",
    r"\*텔레그램\s*채널:\s*\S+",
    r"☎️?\s*[\d\-]+",
)
# What counts as a url and as a phone number.
URL, PHONE = r"https?://\S+", r"\d{2,3}-\d{3,4}-\d{4}"
SCANNED_BELOW = 200
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png")
BITS = 64
#: Shares of all occurrences that growing sets of the rarer letters have. A pair is compared by the first set of whose letters in common it needs more than ``NEEDED``, about what
#: unrelated texts have. Counts of letters held at once.
RARE_SHARES, NEEDED, COUNTS = (0.14, 0.2, 0.26, 0.32, 0.4, 0.5), 0.66, 4_000_000
#: Letters that are taken in between two looks at what is still within reach: one pair at a time, and many.
LOOK, LOOK_MANY = 96, 32
#: Bits of a word that hold places (the last one carries on), words worked on at once, and the fewest pairs and most words with which that is faster than one pair at a time.
WORD, AT_WORK, FEWEST_PAIRS, MOST_WORDS = 63, 16_384, 100, 60
FULL = np.uint64((1 << WORD) - 1)


def blank_to_null(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def strip(x: Column) -> Column:
    """Without white space (of all of Unicode) at both ends."""
    return F.regexp_replace(x, UNICODE + r"^\s+|\s+$", "")


def scoring_input(text: Column, extracted: Column) -> Column:
    """Caption and extracted text with a blank line between; empty parts are left out."""
    return strip(F.concat_ws("\n\n", blank_to_null(text), blank_to_null(extracted)))


def normalised(text: Column) -> Column:
    """Lower case, single spaces, without urls, phone numbers, boilerplate and signs."""
    out = F.regexp_replace(text, UNICODE + URL, " ")
    out = F.regexp_replace(out, UNICODE + PHONE, " ")
    for pattern in BOILERPLATE:
        out = F.regexp_replace(out, DOT_ALL + pattern, " ")
    out = F.regexp_replace(out, UNICODE + r"[^\w\s가-힣]", " ")
    return F.lower(strip(F.regexp_replace(out, UNICODE + r"\s+", " ")))


def tokens(text: Column) -> Column:
    """Words of two characters or more."""
    return F.filter(F.split(text, " "), lambda t: F.length(t) > 1)


#: Distinct tokens whose digests are kept, and tokens whose bits are counted together.
MEMO_TOKENS, COUNTED = 200_000, 100_000


class _Digests(dict):
    """The last eight bytes of each token's MD5, lowest first; emptied when full."""

    def __missing__(self, token: str) -> bytes:
        digest = hashlib.md5(token.encode(), usedforsecurity=False).digest()[:7:-1]
        if len(self) >= MEMO_TOKENS:
            self.clear()
        self[token] = digest
        return digest


_digests = _Digests()


def simhashes(texts: list[str | None]) -> list[int | None]:
    """64-bit SimHash of each text's tokens, as signed numbers; no tokens give 0, null gives null."""
    out: list[int | None] = []
    words: list[bytes] = []
    counts: list[int] = []

    def finish() -> None:
        numbers = np.zeros(len(counts), np.int64)
        full = np.flatnonzero(counts)
        if len(full):
            sizes = np.array(counts)[full]
            bits = np.unpackbits(np.frombuffer(b"".join(words), np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            sums = np.add.reduceat(bits, np.cumsum(sizes) - sizes, axis=0, dtype=np.int64)
            numbers[full] = np.packbits(2 * sums > sizes[:, None], axis=1, bitorder="little").view("<i8").ravel()
        out.extend(numbers.tolist())
        words.clear()
        counts.clear()

    for text in texts:
        mine = [t for t in (text or "").split(" ") if len(t) > 1]
        words += map(_digests.__getitem__, mine)
        counts.append(len(mine))
        if len(words) >= COUNTED:
            finish()
    finish()
    return [None if t is None else h for t, h in zip(texts, out, strict=True)]


@F.pandas_udf(LongType())
def simhash(text: pd.Series) -> pd.Series:
    """64-bit SimHash of a normalised text: a bit is set if more tokens (with repeats) have it in their digest than not."""
    return pd.Series(simhashes(text.tolist()), dtype="Int64")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def document_fingerprint(kind: Column, extracted: Column, chars: Column) -> Column:
    """Length and digest of the first 1000 characters of a document's text; null for anything else."""
    mark = F.concat(F.coalesce(chars.cast("string"), F.lit("None")), F.lit(":"), F.md5(F.substring(extracted, 1, 1000)))
    return F.when((kind == "document") & (F.length(extracted) > 0), mark)


def item_key(chat_id: Column, message_id: Column) -> Column:
    return F.concat_ws("_", chat_id.cast("string"), message_id.cast("string"))


def first_url(text: Column, entities: Column | None = None) -> Column:
    """A linked entity's target, else the part of the text that a url entity marks, whichever comes first; else the first url in the text.

    ``entities``: array of struct(kind, url, offset, length)."""
    plain = blank_to_null(F.regexp_extract(text, UNICODE + URL, 0))
    if entities is None:
        return plain
    usable = F.filter(entities, lambda e: (e["kind"] == "text_url") | ((e["kind"] == "url") & (F.length(text) > 0)))
    marked = F.transform(usable, lambda e: F.when(e["kind"] == "text_url", e["url"]).otherwise(F.substring(text, e["offset"] + 1, e["length"])))
    return F.coalesce(F.get(marked, F.lit(0)), plain)


def item_type(has_photo: Column, has_document: Column, url: Column) -> Column:
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.when(yes(has_photo), "photo").when(yes(has_document), "document").when(url.isNotNull(), "link").otherwise("text")


def extract_status(path: Column, exists: Column, kind: Column, text: Column) -> Column:
    """How an extraction ended. ``text``: the document's text, null if it could not be read."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return (
        F.when((F.coalesce(F.length(path), F.lit(0)) == 0) | ~F.coalesce(exists, F.lit(False)), "no_file")
        .when((kind == "photo") | suffix.isin(*IMAGE_SUFFIXES), "image_pending")
        .when((suffix != ".pdf") | text.isNull(), "error")
        .when(F.length(text) < SCANNED_BELOW, "scanned")
        .otherwise("ok")
    )


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def places_of(text: str) -> dict[str, int]:
    """For each character the positions that it has, as the bits of one number."""
    codes = code_points(text)
    return {chr(c): int.from_bytes(np.packbits(codes == c, bitorder="little").tobytes(), "little") for c in np.unique(codes).tolist()}


def longest_common(a: str, b: str, least: int = 0, places: dict[str, int] | None = None) -> int:
    """Length of the longest common subsequence, bit-parallel: a row of the table is one integer. ``places``: of ``a``.

    It stops with -1 as soon as ``least`` is out of reach: what is matched up to here, with no more of ``a`` passed over than may be, and all of what is left of ``b``.
    Only the places of ``a`` that this allows next to those of ``b`` are held: what lies before them is counted already."""
    over, under = len(a) - least, len(b) - least
    if over < 0 or under < 0:
        return -1
    places = places_of(a) if places is None else places
    row = low = high = found = counted = 0
    for start in range(0, len(b), LOOK):
        some = b[start : start + LOOK]
        end = start + len(some)
        if start - under > low:
            passed = start - under - low
            counted += passed - (row & ((1 << passed) - 1)).bit_count()
            row >>= passed
            low += passed
        top = min(end + over, len(a))
        row |= ((1 << (top - high)) - 1) << (high - low)
        high = top
        full = (1 << (high - low)) - 1
        near = places if not low and high == len(a) else {ch: places[ch] >> low & full for ch in set(some) if ch in places}
        for ch in some:
            if ch in near:
                match = row & near[ch]
                row = (row + match) | (row ^ match)
        row &= full
        found = counted + high - low - row.bit_count()
        if found + len(b) - end < least:
            return -1
    return found


@F.pandas_udf(DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of 0 to 100: twice the longest common subsequence over both lengths; two empty texts are equal."""
    return pd.Series([None if x is None or y is None else 100.0 if x == y else 200.0 * longest_common(x, y) / (len(x) + len(y)) for x, y in zip(a, b, strict=True)], dtype="float64")


def within_reach(codes: list[np.ndarray], letters: int, x: np.ndarray, y: np.ndarray, need: np.ndarray) -> np.ndarray:
    """For each pair (x, y) of texts, as numbers 1 to ``letters``, whether a common subsequence of ``need`` of them is within reach. Where there are enough pairs of like
    and not too great lengths, they are compared at once."""
    sizes = np.array([len(c) for c in codes], np.int64)
    out = np.minimum(sizes[x], sizes[y]) >= need
    words = -(-sizes[x] // WORD)
    todo = np.flatnonzero(out & (need > 0))
    todo = todo[np.lexsort((x[todo], words[todo]))]
    before, places = -1, {}
    while len(todo):
        some = todo[: max(1, AT_WORK // int(words[todo[0]]))]
        some = some[words[some] <= 1 + words[some[0]] * 9 // 8]
        todo = todo[len(some) :]
        if len(some) >= FEWEST_PAIRS and words[some[-1]] <= MOST_WORDS:
            out[some] = _within_reach(codes, sizes, letters, x[some], y[some], need[some])
            continue
        for k in some[np.argsort(x[some], kind="stable")].tolist():
            if before != x[k]:
                before, long = x[k], _as_text(codes[x[k]])
                places = places_of(long)
            out[k] = longest_common(long, _as_text(codes[y[k]]), int(need[k]), places) >= 0
    return out


def _as_text(codes: np.ndarray) -> str:
    return codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def _within_reach(codes: list[np.ndarray], sizes: np.ndarray, letters: int, x: np.ndarray, y: np.ndarray, need: np.ndarray) -> np.ndarray:
    """The rows of ``longest_common`` for all pairs as columns of words, the first word a letter of y ahead of the second and so on, so that what is carried on is at hand.

    Only words that a subsequence of ``need`` can pass through are worked on: it leaves out at most ``len(x) - need`` and ``len(y) - need`` letters. A pair is refused as soon as more
    letters of y are left out."""
    texts, of = np.unique(x, return_inverse=True)
    n = sizes[texts]
    words, steps = -(-int(n.max()) // WORD), int(sizes[y].max())
    place, stride = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n), len(texts) * (letters + 1)
    places = np.zeros(words * stride, np.uint64)  # [word, text, letter]
    entry = place // WORD * stride + np.repeat(np.arange(len(texts)) * (letters + 1), n) + np.concatenate([codes[k] for k in texts])
    np.add.at(places, entry, np.uint64(1) << (place % WORD).astype(np.uint64))
    others, to = np.unique(y, return_inverse=True)
    padded = np.zeros((len(others), steps + 2 * words), np.int64)
    for row, k in zip(padded, others, strict=True):
        row[words : words + sizes[k]] = codes[k]
    ahead = np.take(np.ascontiguousarray(padded.T[::-1]), to, axis=1)  # backwards, so that the words' letters follow one another
    first = len(ahead) - 1 - words
    base = of * (letters + 1) + (np.arange(words) * stride)[:, None]
    over, under, spare, size = int((sizes[x] - need).max()), int((sizes[y] - need).max()), sizes[y] - need, sizes[y]
    alive, rows, carry = np.arange(len(x)), np.full((words, len(x)), FULL), np.zeros((words + 1, len(x)), np.uint64)
    at, match = np.empty(base.shape, np.int64), np.empty(base.shape, np.uint64)
    out = np.zeros(len(x), bool)
    for t in range(steps + words - 1):
        low, high = max(0, -((WORD - 1 + under - t) // (WORD + 1))), min(words, (t + over) // (WORD + 1) + 1)
        if low >= high:
            break
        a, m, row = at[low:high], match[low:high], rows[low:high]
        np.add(base[low:high], ahead[first - t + low : first - t + high], out=a)
        np.take(places, a, out=m, mode="clip")
        np.bitwise_and(m, row, out=m)
        rest = np.bitwise_xor(row, m, out=a.view(np.uint64))
        np.add(row, m, out=m)
        np.add(m, carry[low:high], out=m)
        np.right_shift(m, np.uint64(WORD), out=carry[low + 1 : high + 1])
        np.bitwise_or(m, rest, out=row)
        np.bitwise_and(row, FULL, out=row)
        carry[low] = 0
        if t % LOOK_MANY == LOOK_MANY - 1:
            found = WORD * high - np.bitwise_count(rows[:high]).sum(axis=0, dtype=np.int64)
            kept = np.minimum(size, t - high + 1) - found <= spare
            left = np.count_nonzero(kept)
            if not left:
                return out
            if left < 0.75 * len(kept):
                alive, spare, size = alive[kept], spare[kept], size[kept]
                rows, carry, base, ahead = (np.compress(kept, v, axis=1) for v in (rows, carry, base, ahead))
                at, match = np.empty(base.shape, np.int64), np.empty(base.shape, np.uint64)
    out[alive] = size - (WORD * words - np.bitwise_count(rows).sum(axis=0, dtype=np.int64)) <= spare
    return out


class LongTexts:
    """Texts whose pairs are compared many at a time, looking first at a part of the alphabet.

    A common subsequence has at most what two texts share in some letters, plus the smaller counts of all others. With the rarer letters, less than half of
    all occurrences, that settles nearly all pairs that are not similar, at a fraction of the work. The less the lengths and counts of a pair leave to spare, the fewer letters will do."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        number: dict[str, int] = {}
        #: Equal texts have one number.
        self.number = np.array([number.setdefault(t, len(number)) for t in texts], np.int64)
        points = [code_points(t) for t in texts]
        self.sizes = np.array([len(p) for p in points], np.int64)
        seen = np.zeros(0x110000, np.int64)
        for p in points:
            letters, n = np.unique(p, return_counts=True)
            seen[letters] += n
        letters = np.flatnonzero(seen)
        letters = letters[np.argsort(seen[letters], kind="stable")]
        rank = np.zeros(0x110000, np.int32)  # from 1, the rarest first
        rank[letters] = np.arange(1, len(letters) + 1)
        share = np.cumsum(seen[letters]) / max(1, seen.sum())
        self.sets = sorted({int(np.searchsorted(share, s, "right")) for s in RARE_SHARES} - {0})
        self.counts = np.zeros((len(texts), len(letters) + 1), np.int32)
        self.codes = []
        for k, p in enumerate(points):
            numbers = rank[p]
            self.counts[k] = np.bincount(numbers, minlength=len(letters) + 1)
            self.codes.append(numbers[numbers <= self.sets[-1]] if self.sets else numbers[:0])

    def similar(self, i: np.ndarray, j: np.ndarray, ratio: float) -> np.ndarray:
        """For each pair of texts (i, j) whether they are at least that similar."""
        out = self.number[i] == self.number[j]
        todo = np.flatnonzero(~out)
        if ratio >= 100 or not len(todo):  # nothing may be left out, so only equal texts are that similar
            return out
        longer = self.sizes[i[todo]] >= self.sizes[j[todo]]
        x, y = np.where(longer, i[todo], j[todo]), np.where(longer, j[todo], i[todo])
        order = np.lexsort((y, x))
        todo, x, y = todo[order], x[order], y[order]
        least = np.maximum(-(-ratio * (self.sizes[x] + self.sizes[y]) // 200), 0).astype(np.int64)
        # Letters that each pair can have in common in the sets, and in all.
        ends_of_sets = [*self.sets, self.counts.shape[1] - 1]
        shared = np.zeros((len(x), len(ends_of_sets)), np.int64)
        step = max(1, COUNTS // self.counts.shape[1])
        for k in range(0, len(x), step):
            sums = np.cumsum(np.minimum(self.counts[x[k : k + step]], self.counts[y[k : k + step]]), axis=1, dtype=np.int64)
            shared[k : k + step] = sums[:, ends_of_sets]
        open_ = np.flatnonzero(shared[:, -1] >= least)
        for k, last in enumerate(self.sets):
            need = least[open_] - shared[open_, -1] + shared[open_, k]
            mine = np.flatnonzero((need > 0) & (need > NEEDED * shared[open_, k]))
            if len(mine):
                some = open_[mine]
                used = np.unique(np.concatenate([x[some], y[some]]))
                parts = [c[c <= last] for c in map(self.codes.__getitem__, used)]
                reached = within_reach(parts, last, np.searchsorted(used, x[some]), np.searchsorted(used, y[some]), need[mine])
                kept = np.ones(len(open_), bool)
                kept[mine[~reached]] = False
                open_ = open_[kept]
        before, places = -1, {}
        for k in open_.tolist():
            if before != x[k]:
                before, long = x[k], self.texts[x[k]]
                places = places_of(long)
            both = longest_common(long, self.texts[y[k]], int(least[k]), places)
            out[todo[k]] = both >= 0 and 200.0 * both / (self.sizes[x[k]] + self.sizes[y[k]]) >= ratio
        return out


def similar_texts(texts: list[str], pairs: list[tuple[int, int]], ratio: float) -> list[tuple[int, int]]:
    """Which pairs of places in ``texts`` are at least that similar."""
    ends = np.array(sorted(pairs), np.int64).reshape(-1, 2)
    return [tuple(pair) for pair in ends[LongTexts(texts).similar(ends[:, 0], ends[:, 1], ratio)].tolist()]


#: Bytes of the tables of places that are held at once, and pairs whose columns stay in a core's cache.
PLACES_BYTES, PAIRS_AT_ONCE = 64_000_000, 8_000


class ShortTexts:
    """Short texts (nulls are not held) whose pairs are compared many at a time: the rows of ``longest_common`` for all pairs as columns of 64-bit words."""

    def __init__(self, texts: pa.ChunkedArray):
        given = texts.to_pylist()
        self.held = np.array([t is not None for t in given], bool)
        points = [code_points(t or "") for t in given]
        self.sizes = np.array([len(p) for p in points], np.int64)
        flat = np.concatenate(points) if points else np.zeros(0, np.uint32)
        letters, number = np.unique(flat, return_inverse=True)
        #: Number of each letter from 1, 0 behind the end of a text.
        self.letters = len(letters) + 1
        self.codes = np.zeros((len(given), int(self.sizes.max(initial=0))), np.int32)
        self.codes[np.arange(self.codes.shape[1]) < self.sizes[:, None]] = number + 1

    def _places(self, which: np.ndarray, words: int) -> np.ndarray:
        """[word, text * letters + letter]: the positions of each letter."""
        out = np.zeros((words, len(which) * self.letters), np.uint64)
        rows = np.arange(len(which)) * self.letters
        for k in range(min(self.codes.shape[1], 64 * words)):
            out[k // 64, rows + self.codes[which, k]] |= np.uint64(1 << k % 64)
        out[:, rows] = 0
        return out

    def similar(self, x: np.ndarray, y: np.ndarray, ratio: float) -> np.ndarray:
        """For each pair of texts (x, y) whether they are at least that similar."""
        out = np.zeros(len(x), bool)
        if not len(x):
            return out
        which, at = np.unique(x, return_inverse=True)
        words = max(1, -(-int(self.sizes[which].max()) // 64))
        most = max(1, PLACES_BYTES // (8 * words * self.letters))
        for start in range(0, len(which), most):
            places, among = self._places(which[start : start + most], words), np.flatnonzero((at >= start) & (at < start + most))
            for first in range(0, len(among), PAIRS_AT_ONCE):
                mine = among[first : first + PAIRS_AT_ONCE]
                base, rows = (at[mine] - start) * self.letters, np.full((words, len(mine)), ~np.uint64(0))
                for step in self.codes[y[mine], : int(self.sizes[y[mine]].max(initial=0))].T.copy():
                    place, carry = base + step, None
                    for w in range(words):
                        row = rows[w]
                        match = row & places[w].take(place)
                        total = row + match
                        over = total < row
                        if carry is not None:
                            total += carry
                            over |= total < carry
                        rows[w] = total | (row ^ match)
                        carry = over
                common = 64 * words - np.bitwise_count(rows).sum(axis=0, dtype=np.int64)
                out[mine] = 200.0 * common >= ratio * (self.sizes[x[mine]] + self.sizes[y[mine]])
        return out
