import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from oracle import SF

from tonelake.llm import common, ngram_join, queries
from tonelake.llm.rtree import CountTree, count_vector, linked, most_shared, packed_counts, unpacked
from tonelake.llm.shingles import numbered_sets, shingle_sets


def sets_of(rows, width):
    out = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        out[d] = frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    return out


def brute(rows, width, percent):
    sets = sets_of(rows, width)
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    places, shared = defaultdict(list), Counter()
    for d, s in sets.items():
        for q in s:
            for other in places[q]:
                shared[other, d] += 1
            places[q].append(d)
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    return {d: (len(s), find(d)) for d, s in sets.items()}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def made(seed, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(200)]
    rows = []
    for base in range(4):
        text = [rng.choice(words) for _ in range(rng.choice([30, 120, 400]))]
        for k in range(n // 4):
            copy = list(text)
            for _ in range(rng.randint(0, max(1, len(copy) // 60))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((base * 100 + k, " ".join(copy)))
    rows += [(900, None), (901, ""), (902, " \t\n"), (903, "one"), (904, "ONE"), (905, "one two"), (906, "a b c d"), (907, "A  b\tc d"), (908, "x " * 5000), (909, "x " * 4000), (910, "É b c d"), (911, "é b c d")]
    return rows


@pytest.mark.parametrize(("width", "percent", "batch", "block"), [(4, 85, 1_000_000, 4000), (5, 80, 1, 4000), (3, 70, 500, 5), (7, 55, 500, 3)])
def test_like_brute_force(docs, monkeypatch, width, percent, batch, block):
    monkeypatch.setattr(ngram_join, "BATCH_SHINGLES", batch)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "SEEN", 10**9 if block == 5 else 3)
    rows = made(width)
    assert result(ngram_join.jaccard_components(docs(rows), width=width, percent=percent)) == brute(rows, width, percent)


def test_without_broadcast(docs, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 400)
    rows = made(9)
    assert result(ngram_join.jaccard_components(docs(rows), width=4, percent=85)) == brute(rows, 4, 85)


def test_words_with_structure_stand_apart(docs):
    """A Thue-Morse word and its complement collide under every polynomial hash modulo a power of two."""
    one = "".join("ab"[k.bit_count() % 2] for k in range(1024))
    two = one.translate(str.maketrans("ab", "ba"))
    rows = [(1, one), (2, two), (3, one + " x y z"), (4, two + " x y z")]
    assert result(ngram_join.jaccard_components(docs(rows), width=4, percent=85)) == brute(rows, 4, 85) == {i: (1, i) for i in (1, 2, 3, 4)}


def test_repeated_rows_and_missing_ids(docs):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (3, "a b c d e")]
    got = [(r.doc_id, r.component_id) for r in ngram_join.jaccard_components(docs(rows), width=4, percent=85).collect()]
    assert sorted(got) == [(1, 1), (1, 1), (3, 1)]


def test_one_id_on_different_texts(docs):
    """Every text keeps its own links, whichever row comes first."""
    first, second = "a b c d e f g h i j", "k l m n o p q r s t"
    for rows in ([(1, first), (1, second)], [(1, second), (1, first)]):
        rows += [(2, first + " x"), (3, second + " y"), (4, first + " z"), (5, "on its own here and now"), (3, "on its own here and now")]
        got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs(rows), width=4, percent=75).collect())
        assert got == [(1, 7, 1), (1, 7, 1), (2, 8, 1), (3, 3, 3), (3, 8, 1), (4, 8, 1), (5, 3, 3)]
        left = sorted((r.doc_id, r.text) for r in ngram_join.near_deduplicate(docs(rows), width=4, percent=75).collect())
        assert left == [(1, first), (1, second), (3, "on its own here and now")]
    rows = [(1, first), (5, first), (5, second)]  # 5 goes with its first text only
    assert sorted((r.doc_id, r.text) for r in ngram_join.near_deduplicate(docs(rows)).collect()) == [(1, first), (5, second)]


def test_rows_without_an_id_take_part(spark, docs, tmp_path):
    first, second = "a b c d e f g h i j", "k l m n o p q r s t"
    rows = [(None, first), (7, first + " x"), (8, "k l m n u v w"), (None, second), (None, second), (None, second + " y"), (None, ""), (None, None), (9, "")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs(rows), width=4, percent=75, missing_ids=True).collect()), key=str)
    assert got == sorted([(None, 7, 7), (7, 8, 7), (8, 4, 8), (None, 7, None), (None, 7, None), (None, 8, None), (None, 0, None), (None, 0, None), (9, 0, 9)], key=str)
    docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    assert queries.op3_ngram_join(spark, str(tmp_path)).count() == len(rows)
    left = [(r.doc_id, r.text) for r in ngram_join.near_deduplicate(docs(rows), width=4, percent=75).collect()]
    assert sum(d is None and (t or "").startswith("k") for d, t in left) == 1
    assert sorted(((d, t) for d, t in left if not (t or "").startswith(second)), key=str) == sorted([(7, first + " x"), (8, "k l m n u v w"), (None, ""), (None, None), (9, "")], key=str)


@pytest.mark.parametrize("block", [4000, 6])
def test_all_links(docs, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = made(6)
    classes = defaultdict(list)
    for d, x in sets_of(rows, 4).items():
        if x:
            classes[x].append(d)
    wanted = set()
    for x, ds in classes.items():
        for y, es in classes.items():
            both = len(x & y)
            if min(ds) < min(es) and 100 * both >= 85 * (len(x) + len(y) - both):
                wanted.add((min(ds), min(es), len(ds), len(es)))
    got = [tuple(r) for r in ngram_join.jaccard_links(docs(rows), width=4, percent=85).collect()]
    assert len(wanted) > 50 and len(got) == len(wanted) and set(got) == wanted


def test_near_deduplicate(docs):
    rows = made(4)
    df = docs(rows)
    out = ngram_join.near_deduplicate(df, width=5, percent=80)
    wanted = {d for d, (_, c) in brute(rows, 5, 80).items() if d == c}
    assert out.columns == df.columns and {r.doc_id for r in out.collect()} == wanted


def test_empty(docs):
    assert ngram_join.jaccard_components(docs([])).count() == 0


def test_shingle_sizes():
    texts = ["", None, "a", "a b", "a b c d", "a b c d e", "A\x0bB\x0cC D", "x" * 100_000, " a  b "]
    assert [len(s) for s in shingle_sets(texts, 4, b'k')] == [len(s) for s in sets_of(list(enumerate(texts)), 4).values()]
    assert shingle_sets(["A b C d"], 4, b"k")[0].tolist() == shingle_sets(["q", "a B c D"], 4, b"k")[1].tolist()


def test_numbered_sets():
    texts = ["", None, "a", "a b", "a b c d", "a b c d e", "A\x0bB\x0cC D", "x " * 1000, " a  b ", "a b", "d e a b c d"]
    for width in (1, 2, 3, 4, 5, 6, 7):
        sets, at, top = numbered_sets(texts, width)
        got = [set(sets[a:b].tolist()) for a, b in zip(at[:-1], at[1:], strict=True)]
        wanted = list(sets_of(list(enumerate(texts)), width).values())
        assert sets.max() < top
        assert [[len(x & y) for y in got] for x in got] == [[len(x & y) for y in wanted] for x in wanted]


def test_bounds_and_tree():
    """No pair that is similar enough is pruned, whatever the labels, and links join what is connected."""
    rng = np.random.default_rng(0)
    sets = []
    for _ in range(40):
        base = rng.integers(0, 2**63, 300, dtype=np.uint64)
        for _ in range(3):
            keep = base[rng.random(300) < 0.93]
            sets.append(np.unique(np.r_[keep, rng.integers(0, 2**63, rng.integers(0, 400), dtype=np.uint64)]))
    points = np.array([count_vector(s, 64) for s in sets])
    sizes, sides = np.array([len(s) for s in sets]), np.full(len(sets), 2)
    both = np.array([[len(np.intersect1d(s, t)) for t in sets] for s in sets])
    fine = [unpacked(packed_counts(s)) for s in sets]
    for i in range(len(sets)):
        assert (both[i] <= most_shared(fine[i], fine)).all()
    wanted = {(i, j) for i in range(len(sets)) for j in range(i) if 170 * both[i, j] >= 70 * (sizes[i] + sizes[j])}
    found = {(max(i, j), min(i, j)) for x, y in CountTree(points, sizes).pairs(70, np.arange(len(sets))) for i, j in zip(x.tolist(), y.tolist(), strict=True)}
    assert wanted <= found and len(found) < len(sets) ** 2 / 4
    alone = np.arange(len(sets))
    every = linked(points, sizes, alone, alone, sides, 70, lambda i, others: both[i, others], every=True)
    assert {(max(p), min(p)) for p in every} == wanted and len(every) == len(wanted)
    joined = linked(points, sizes, alone, alone, sides, 70, lambda i, others: both[i, others])
    assert {(max(p), min(p)) for p in joined} <= wanted
    assert linked(points, sizes, alone, alone % 1, sides, 70, lambda i, others: both[i, others]) == []

    def parts(pairs):
        name = list(range(len(sets)))
        for i, j in pairs:
            name = [name[i] if n == name[j] else n for n in name]
        return {frozenset(k for k, n in enumerate(name) if n == m) for m in set(name)}

    assert parts(joined) == parts(wanted) and len(joined) == len(sets) - len(parts(wanted))


def test_overflowing_groups():
    assert packed_counts(np.arange(0, 64 * 40, 64, dtype=np.uint64)) == b""


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert result(queries.op3_ngram_join(spark, SF)) == brute(rows, 4, 85)


@pytest.mark.parametrize("batch", [1, 3, 10_000])
def test_smallest_partners_across_batches(spark, batch):
    rng = random.Random(batch)
    rows = sorted({(rng.randrange(40), rng.randrange(60)) for _ in range(150)} | {(100, k) for k in range(30)})
    sizes = {i: rng.choice([10, 11, 100]) for i in range(60)}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame([(t, i, sizes[i]) for t, i in rows], "token bigint, id bigint, n int").coalesce(1).sortWithinPartitions("token", "id")
        got = Counter()
        for r in ngram_join.smallest_partners(df, 85).collect():
            assert r.n == sizes[r.id]
            got[r.low, r.id] += r.shared
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    most, least = Counter(), Counter()
    for token in {t for t, _ in rows}:
        ids = [i for t, i in rows if t == token]
        fits = 100 * min(sizes[i] for i in ids) >= 85 * max(sizes[i] for i in ids)
        for i in ids if len(ids) > 1 else []:
            most[ids[0], i] += 1
            least[ids[0], i] += len(ids) > 2 or fits
    assert all(least[k] <= got[k] <= most[k] for k in most) and set(got) <= set(most)
    assert batch < 10_000 or got == +least


def test_very_long_texts(docs):
    words = [f"w{k * k % 9973}" for k in range(60_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-3000])), (3, " ".join(words[:30_000])), (4, "q" * 200_000), (5, "q" * 200_000 + " x")]
    assert result(ngram_join.jaccard_components(docs(rows), width=4, percent=85)) == brute(rows, 4, 85)


@pytest.mark.parametrize("pair", [("136489 36e35f c d", "3e9379 561cd0 c d"), ("115e1c 2f3f64 c d", "1d754e 2dd581 c d")])
def test_shingles_whose_linear_hashes_fall_together(docs, pair):
    """Different shingles with equal sums of unkeyed word hashes are not linked, and neither document goes."""
    rows = list(enumerate(pair))
    assert result(ngram_join.jaccard_components(docs(rows), width=4, percent=85)) == {0: (1, 0), 1: (1, 1)}
    assert ngram_join.near_deduplicate(docs(rows), width=4).count() == 2


def test_rows_without_an_id_pass_through_names_used_inside(spark):
    text = "one two three four five six seven"
    rows = [(None, text, "a", 1, 2, 3), (None, text, "a", 1, 2, 3), (None, text, "a", 4, 5, 6), (8, "another text of six words here", "b", 7, 8, 9)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, row string, __doc int, __spot int, spot int")
    out = ngram_join.near_deduplicate(df)
    assert out.columns == df.columns
    kept = out.collect()
    assert len(kept) == 2 and {r["__doc"] for r in kept} <= {1, 4, 7} and {r.doc_id for r in kept} == {None, 8}
