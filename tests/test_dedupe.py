import random

import pytest
from oracle import SF
from pyspark.sql import functions as F

from tonelake.functions.text import longest_common
from tonelake.operators import components, dedupe
from tonelake.operators.components import connected_components
from tonelake.schemas import ITEMS, conform
from tonelake.sources import synthetic


def roots(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        parent[high] = low
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(110)] + [(i, i + 1) for i in range(300, 340)] + [(None, 3), (7, None)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a int, b int"), "a", "b").collect()}
    real = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    nodes = {x for e in real for x in e}
    assert got == roots(nodes, real)


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([(1, 1)], "a int, b int"), "a", "b").count() == 0


def test_clusters_like_all_pairs(spark):
    """The definition over all pairs, on the first items of the test table and some made up ones."""
    items = synthetic.items(spark, SF, near=True).filter("message_id < 250")
    text = "one two three four five six seven eight nine ten eleven twelve"
    extra = [(1, 9001, "1998-01-01", text), (2, 9002, "1998-01-02", text + " x"), (3, 9003, "1998-01-04", text), (4, 9004, "1998-01-02", ""), (5, 9005, "1998-01-02", None), (6, 9006, "1998-01-03", "a b"), (7, 9007, "1998-01-03", "a b c")]
    made = spark.createDataFrame([(c, f"c{c}", m, d, "text", t) for c, m, d, t in extra], "chat_id bigint, chat_name string, message_id bigint, date string, type string, text string")
    items = items.unionByName(conform(made, ITEMS))
    rows = dedupe.fingerprints(items).collect()
    edges = []
    for i, a in enumerate(rows):
        for b in rows[:i]:
            if a.document_fp is not None and a.document_fp == b.document_fp:
                edges.append((a.item_key, b.item_key))
            elif a.norm_text and b.norm_text and abs((a.day - b.day).days) <= 1:
                near = bin((a.simhash ^ b.simhash) & (1 << 64) - 1).count("1") <= 10
                if near and 200 * longest_common(a.norm_text, b.norm_text) >= 85 * (len(a.norm_text) + len(b.norm_text)):
                    edges.append((a.item_key, b.item_key))
    clusters = dedupe.cluster_items(items).collect()
    assert {r.item_key: r.dup_cluster_id for r in clusters} == roots([r.item_key for r in rows], edges)
    by = {}
    for r in clusters:
        by.setdefault(r.dup_cluster_id, []).append(r)
    dates = {r.item_key: r.date for r in rows}
    for group in by.values():
        assert {r.mention_channels for r in group} == {len({r.chat_id for r in group})}
        head = min(group, key=lambda r: (dates[r.item_key], r.message_id, r.chat_id))
        assert [r.item_key for r in group if r.is_cluster_head] == [head.item_key]


@pytest.mark.parametrize("blocks, limit, square", [(0, 10, 8000), (0, 10, 7), (1, 10, 8000), (2, 10, 8000), (2, 10, 5), (3, 6, 8000), (2, 0, 9), (None, 64, 8000)])
def test_every_index_gives_the_same_candidates(spark, monkeypatch, blocks, limit, square):
    monkeypatch.setattr(dedupe, "SQUARE_ROWS", square)
    rng = random.Random(4)
    rows = []
    for n in range(90):
        h = rng.getrandbits(64) if n % 3 == 0 or not rows else rows[-1][3] % 2**64
        for bit in rng.sample(range(64), rng.choice([0, 3, 9, 12])):
            h ^= 1 << bit
        rows.append((f"k{n:03}", f"text {n}" * (1 + n % 4), n % 4, h - (h >> 63 << 64)))
    made = spark.createDataFrame(rows, "item_key string, norm_text string, d int, simhash bigint")
    prints = made.withColumn("day", F.date_add(F.lit("2024-02-27").cast("date"), F.col("d")))
    got = [(r.a, r.b, r.n_a, r.n_b) for r in dedupe.candidate_pairs(prints, limit, 60, blocks=blocks).collect()]
    want = set()
    for a in rows:
        for b in rows:
            n, m = len(a[1]), len(b[1])
            if (a[2], a[0]) < (b[2], b[0]) and b[2] - a[2] <= 1 and ((a[3] ^ b[3]) & 2**64 - 1).bit_count() <= limit and 200 * min(n, m) >= 60 * (n + m):
                want.add((a[0], b[0], n, m))
    assert len(got) == len(set(got)) and set(got) == want


def test_blocks_follow_the_fullest_day():
    assert [dedupe.blocks_kept(n) for n in (0, 50_000, 50_001, 5_000_001)] == [0, 0, 2, 3]


def test_a_star_is_settled_without_a_hot_node(spark, monkeypatch):
    monkeypatch.setattr(components, "HUB_EDGES", 1000)
    edges = spark.range(1, 60_001).select(F.lit(0).cast("bigint").alias("a"), F.col("id").alias("b")).unionByName(spark.createDataFrame([(60_000, 70_000)], "a bigint, b bigint"))
    got = connected_components(edges, "a", "b")
    assert got.count() == 60_002 and got.filter("component <> 0").count() == 0


@pytest.mark.parametrize("hub, kind", [(10**6, "int"), (5, "bigint"), (3, "string")])
def test_components_of_chains_and_rings(spark, monkeypatch, hub, kind):
    monkeypatch.setattr(components, "HUB_EDGES", hub)
    rng = random.Random(6)
    chain = list(range(1000, 1400))
    rng.shuffle(chain)
    edges = [*zip(chain, chain[1:]), *((2000 + i, 2000 + (i + 1) % 50) for i in range(50)), *((3000, 3001 + i) for i in range(30)), *((3001 + i, 4000 + i) for i in range(30))]
    rows = spark.createDataFrame(edges, "a int, b int").repartition(7).select(F.col("a").cast(kind), F.col("b").cast(kind))
    got = {int(r.node): int(r.component) for r in connected_components(rows, "a", "b").collect()}
    assert got == roots({x for e in edges for x in e}, edges)


@pytest.mark.parametrize("square, short", [(24_000, 128), (3, 128), (24_000, 30), (24_000, 0)])
def test_short_texts_are_compared_where_they_meet(spark, monkeypatch, square, short):
    """All similar pairs, and the same components from links, of which there are fewer than rows."""
    monkeypatch.setattr(dedupe, "SQUARE_ROWS", square)
    monkeypatch.setattr(dedupe, "SHORT", short)
    rng = random.Random(3)
    words = "red blue green ring rod plate hot cold".split()
    rows = [(f"k{n:03}", " ".join([*rng.choices(words, k=2), "large", "size", str(rng.randrange(50))]), n % 2, rng.choice([0, 1, 3, 2**20 - 1])) for n in range(80)]
    rows = list({(r[1], r[2]): r for r in rows}.values())
    prints = spark.createDataFrame(rows, "item_key string, norm_text string, d int, simhash bigint").withColumn("day", F.date_add(F.lit("2024-02-27").cast("date"), F.col("d")))
    want = {tuple(sorted((a[0], b[0]))) for a in rows for b in rows if a[0] < b[0] and (a[3] ^ b[3]).bit_count() <= 10 and 200 * longest_common(a[1], b[1]) >= 85 * (len(a[1]) + len(b[1]))}
    pairs = [tuple(sorted(r)) for r in dedupe.similar_pairs(dedupe.candidate_pairs(prints, ratio=85, confirm="pairs"), prints).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == want
    found = dedupe.candidate_pairs(prints, ratio=85, confirm="links")
    links = [tuple(r) for r in dedupe.similar_pairs(found, prints).collect()]
    names = [r[0] for r in rows]
    assert roots(names, links) == roots(names, want)
    if square > len(rows) and short > 60:
        assert found.filter("not sure").count() == 0 and 0 < len(links) < len(want)


def test_tasks_make_forests_of_names(spark):
    edges = spark.createDataFrame([(f"é{i}", f"é{j}") for i in range(30) for j in range(i)], "u string, v string").coalesce(1)
    got = components._forests(edges).collect()
    assert len(got) == 29 and {r.v for r in got} == {"é0"}


def test_equal_texts_are_keyed_by_length(spark, monkeypatch):
    """Where nothing but equal texts counts, rows of other lengths never meet, and no subsequence is looked for."""
    seen = []
    near = dedupe.near_in_groups
    monkeypatch.setattr(dedupe, "near_in_groups", lambda rows, *more: seen.append(rows) or near(rows, *more))
    rows = [(f"k{n}", "t" * 150 + "x" * (n // 4) + "ab"[n % 2], n // 2 % 2) for n in range(40)]
    made = spark.createDataFrame(rows, "item_key string, norm_text string, d int")
    prints = made.withColumns({"simhash": F.lit(5).cast("bigint"), "day": F.date_add(F.lit("2024-02-27").cast("date"), F.col("d"))})
    monkeypatch.setattr(dedupe, "SQUARE_ROWS", 1000)
    got = {tuple(sorted(r)) for r in dedupe.similar_pairs(dedupe.candidate_pairs(prints, 3, 100.0, confirm="links"), prints, 100.0).collect()}
    assert got == {tuple(sorted((a[0], b[0]))) for a in rows for b in rows if a[1] == b[1] and a[2] < b[2]}
    assert seen[0].groupBy(*dedupe.GROUP).agg(F.countDistinct("n").alias("k")).filter("k > 1").count() == 0


@pytest.mark.parametrize("spread_out", [True, False])
def test_keys_are_dropped_where_hashes_crowd(spark, monkeypatch, spread_out):
    """Hashes that lie close together share nearly all keys: whole days are compared then, in squares, with the same pairs."""
    monkeypatch.setattr(dedupe, "KEY_STEPS", (10, 10, 10**6))
    monkeypatch.setattr(dedupe, "SIDE_ROWS", 20)
    seen, near = [], dedupe.near_in_groups
    monkeypatch.setattr(dedupe, "near_in_groups", lambda rows, limit, r, *more: seen.append((r, rows)) or near(rows, limit, r, *more))
    rng = random.Random(9)
    rows = [(f"k{n:03}", f"text {n}", n % 2, rng.getrandbits(63) if spread_out else sum(1 << b for b in rng.sample(range(60), rng.choice([1, 4, 6])))) for n in range(120)]
    prints = spark.createDataFrame(rows, "item_key string, norm_text string, d int, simhash bigint").withColumn("day", F.date_add(F.lit("2024-02-27").cast("date"), F.col("d")))
    got = [(r.a, r.b) for r in dedupe.candidate_pairs(prints).collect()]
    want = {(a[0], b[0]) for a in rows for b in rows if (a[2], a[0]) < (b[2], b[0]) and (a[3] ^ b[3]).bit_count() <= 10}
    assert len(got) == len(set(got)) and set(got) == want
    assert seen[0][0] == (2 if spread_out else 0)
    if not spread_out:
        assert seen[0][1].select("day", "i", "j").distinct().count() > 20


@pytest.mark.parametrize("work, least", [(6e11, 1e10), (2e6, 1)])
def test_pairs_are_dealt_by_length(spark, monkeypatch, work, least):
    """Every similar pair is found, also where its texts lie on both sides of a class; pairs of a square are like in length."""
    monkeypatch.setattr(dedupe, "SQUARE_WORK", work)
    monkeypatch.setattr(dedupe, "SMALL_SQUARE", least)
    monkeypatch.setattr(dedupe, "LEAST_WORK", 1)
    rng = random.Random(8)
    texts = ["".join(rng.choices("etaoin shrdlu", k=n)) for n in (1, 2, 20, 30, 31, 45, 100, 150, 225, 226, 338, 339, 500)]
    texts += [t + t[: len(t) // 5] for t in texts] + [t[:-1] + "x" for t in texts]
    rows = [(f"k{n:02}", t) for n, t in enumerate(sorted(set(texts) - {""}))]
    prints = spark.createDataFrame(rows, "item_key string, norm_text string")
    pairs = [(a[0], b[0], len(a[1]), len(b[1])) for a in rows for b in rows if a[0] < b[0]]
    given = spark.createDataFrame(pairs, "a string, b string, n_a int, n_b int")
    of = dict(rows)
    want = {(a, b) for a, b, n, m in pairs if 200 * longest_common(of[a], of[b]) >= 85 * (n + m)}
    got = [tuple(r) for r in dedupe.similar_pairs(given, prints).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 15
    sides = dedupe.sides_of_classes(given)
    assert len(sides) > 8 and (max(sides.values()) > 1) == (work < 1e7)
    none = dedupe.similar_pairs(given.limit(0), prints)
    assert none.count() == 0


@pytest.mark.parametrize("chars, most, work, at_once", [(2_000_000, 2_000, 1e12, 50_000), (1_500, 4, 1, 7), (10**9, 1, 1e6, 50_000)])
def test_long_texts_meet_in_blocks(spark, monkeypatch, chars, most, work, at_once):
    """The same pairs and components however texts are dealt to blocks and tasks; candidates, whose number grows with the square of the texts, are not written."""
    for name, value in (("BLOCK_CHARS", chars), ("BLOCK_ROWS", most), ("TASK_WORK", work), ("TASK_SIDES", 3), ("AT_ONCE", at_once), ("SHORT", 60)):
        monkeypatch.setattr(dedupe, name, value)
    written = []
    keep = dedupe.stored

    def stored(df, label):
        out = keep(df, label)
        written.append((label, out.count()))
        return out

    monkeypatch.setattr(dedupe, "stored", stored)
    rng = random.Random(12)
    base = ["".join(rng.choices("etaoin shrdlu", k=n)) for n in (30, 44, 50, 58, 61, 70, 80, 90, 150, 224, 226, 300, 330, 380)]
    texts = [t[:k] + "x" * m + t[k + m :] for t in base for k in (3, 20) for m in (0, 2, 6, 12)] + [t + t[: len(t) // 4] for t in base]
    rows = [(f"k{n:03}", n % 4, t, rng.choice([0, 1, 3, 2**20 - 1, 2**63 - 1])) for n, t in enumerate(dict.fromkeys(texts))]
    rows += [(f"l{n:03}", (n + 1) % 4, t, h) for n, (_, _, t, h) in enumerate(rows[::9])]
    rows = list({(r[1], r[2]): r for r in rows}.values())
    reps = spark.createDataFrame(rows, "rep string, d int, norm_text string, simhash bigint").withColumns({"day": F.date_add(F.lit("1969-12-30").cast("date"), F.col("d")), "n": F.length("norm_text")})
    reps = reps.withColumn("at", F.unix_date("day"))
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and abs(a[1] - b[1]) <= 1 and (a[3] ^ b[3]).bit_count() <= 10 and 200 * longest_common(a[2], b[2]) >= 85 * (len(a[2]) + len(b[2]))}
    pairs = [tuple(sorted(r)) for r in dedupe.similar_links(reps, confirm="pairs").collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == want and len(want) > 60
    links = [tuple(r) for r in dedupe.similar_links(reps).collect()]
    names = [r[0] for r in rows]
    assert roots(names, links) == roots(names, want)
    if most == 2_000:
        assert len(links) < len(want)
    prints = reps.withColumns({"chat_id": F.lit(1), "item_key": F.col("rep"), "document_fp": F.lit(None).cast("string")})
    written.clear()
    edges = [tuple(r) for r in dedupe.duplicate_edges(prints, reps.withColumn("copies", F.lit(1))).collect()]
    assert roots(names, edges) == roots(names, want)
    assert max(n for _, n in written) <= len(rows) and "candidates" not in dict(written)
    assert dedupe.similar_links(reps.limit(0)).count() == 0


def test_copies_are_one_node(spark, monkeypatch):
    """Copies of a text on a day are linked as one item, whatever links them to others: same document, no text at all, no day."""
    seen, settle = [], dedupe.connected_components
    monkeypatch.setattr(dedupe, "connected_components", lambda edges, *names: seen.append(edges.count()) or settle(edges, *names))
    texts = ["red plate of one size", "blue ring for ten rods", "cold bolts and hot ones", "red plate of one size x"]
    rows = [(n % 3, n, "1998-01-01", "text", texts[n % 3], None) for n in range(60)] + [(1, 100 + n, f"1998-01-0{2 + n}", "text", texts[3], None) for n in range(3)]
    rows += [(2, 200, "1998-01-01", "document", None, texts[0]), (2, 201, "1998-03-01", "document", "with a caption", texts[0])]
    rows += [(3, 210 + n, "1998-01-01", "document", None, "!?") for n in range(3)] + [(4, 220, None, "document", None, "!?"), (4, 221, None, "text", texts[0], None), (4, 222, None, "text", texts[0], None)]
    made = spark.createDataFrame(rows, "chat_id bigint, message_id bigint, date string, type string, text string, extracted_text string")
    items = conform(made.withColumn("extract_chars", F.length("extracted_text")), ITEMS)
    of = {r.item_key: r for r in dedupe.fingerprints(items).collect()}
    edges = []
    for a in of.values():
        for b in of.values():
            x, y = a.norm_text, b.norm_text
            near = a.day and b.day and x and y and abs((a.day - b.day).days) <= 1 and ((a.simhash ^ b.simhash) & 2**64 - 1).bit_count() <= 10
            if a.document_fp is not None and a.document_fp == b.document_fp or near and 200 * longest_common(x, y) >= 85 * (len(x) + len(y)):
                edges.append((a.item_key, b.item_key))
    got = dedupe.cluster_items(items).collect()
    assert len(got) == len(rows) and {r.item_key: r.dup_cluster_id for r in got} == roots(list(of), edges)
    assert len({r.dup_cluster_id for r in got}) == 6 and max(seen) < 10
    only = {r.item_key: r.dup_cluster_id for r in dedupe.cluster_items(items, 3, 100.0).collect()}
    assert only["3_211"] == only["4_220"] == "3_210" and only["4_221"] == "4_221" and only["1_1"] == "1_1" and only["1_4"] == "1_1"


def test_candidate_pairs_read_stored_prints(spark, monkeypatch):
    """Texts are normalised once, not again for each condition on them."""
    from tonelake.plans import queries

    labels, keep = [], queries.stored
    monkeypatch.setattr(queries, "stored", lambda df, label: labels.append(label) or keep(df, label))
    assert queries.j10_candidate_pairs(spark, SF).columns == ["a", "b"] and labels == ["prints"]
