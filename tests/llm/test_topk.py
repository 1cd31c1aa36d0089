import math

import numpy as np
import pytest
from oracle import SF

from tonelake.llm import queries, topk


def brute(rows, k=10, scale=1024):
    usable = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in usable:
        if q % 100 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in usable if i != q and len(a) == len(b))
            out += [(q, n, i, max(-(2**63), min(2**63 - 1, -s))) for n, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, **options).collect())


def vectors(n, d=8, seed=0, clusters=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, d)) * 3
    data = (centres[rng.integers(0, clusters, n)] + rng.normal(size=(n, d)) * 0.2).astype(np.float32)
    return [(i, [float(x) for x in v]) for i, v in enumerate(data)]


@pytest.mark.parametrize(("shard", "block"), [(10_000, 1000), (70, 3), (250, 2)])
def test_like_brute_force(spark, monkeypatch, shard, block):
    monkeypatch.setattr(topk, "LEAF_ROWS", 16)
    rows = vectors(900) + [(1000 + i, [0.5] * 8) for i in range(30)]
    assert run(spark, rows, shard_rows=shard, block_rows=block) == brute(rows)


def test_edges(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, []), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (None, [1.0, 1.0]), (6, [1.0, 2.0]), (7, [1.0, -2.0]), (8, [1.0, 1.0, 1.0]), (100, [1.0, 0.0]), (-100, [-0.0004, 0.3])]
    assert run(spark, rows) == brute(rows)


def test_huge_components(spark):
    rows = [(0, [3e5, 2.0]), (1, [2e5, 1.0]), (2, [1e10, 1.0]), (3, [-1e12, 5.0])]
    assert run(spark, rows) == brute(rows)
    assert len(run(spark, [(0, [3e38, 1.0]), (1, [3e38, 1.0]), (2, [-3e38, 0.0])])) == 2
    wide = spark.createDataFrame([(0, [1e308, 1.0]), (1, [1.0, 1.0]), (100, [2.0, 1.0])], "vec_id bigint, embedding array<double>")
    assert [(r.query_id, r.vec_id) for r in topk.top_k(wide).collect()] == [(100, 1)]


@pytest.mark.parametrize("components", [10**9, 300])
def test_wide_products_go_through_the_tree(spark, monkeypatch, components):
    """Products beyond doubles, ties there included, in several shards and rounds."""
    monkeypatch.setattr(topk, "LEAF_ROWS", 8)
    monkeypatch.setattr(topk, "MOST_COMPONENTS", components)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in (rng.normal(size=4) * 10.0 ** rng.integers(3, 9)).astype(np.float32)]) for i in range(300)]
    rows += [(400 + i, rows[7][1]) for i in range(15)] + [(500, rows[7][1]), (-100, [1e15, -1e15, 1e15, 1.0])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, shard_rows=40, block_rows=2) == brute(rows)


def test_clashing_columns_and_repeated_ids(spark):
    rows = vectors(150) + [(100, [1.0] * 8), (7, [2.0] * 8), (7, [2.0] * 8)]
    names = "vec_id bigint, embedding array<float>, id string, v int, shard int, block int, score string, `rank` int, floor double, query_id bigint, is_query int"
    df = spark.createDataFrame([(i, v, "x", 1, 2, 3, "y", 4, 5.0, 6, 7) for i, v in rows], names)
    found = topk.top_k(df, shard_rows=60)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    best = {}
    for r in found.collect():
        best.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.vec_id != r.query_id
    assert set(best) == {0, 100} and len(best[0]) == 10 and sum(i == 7 for i, _ in best[0]) in (0, 2, 3)
    assert topk.top_k(df.filter("vec_id = 7")).count() == 0


def test_few_and_none(spark):
    assert run(spark, []) == [] and run(spark, [(0, [1.0])]) == [] and run(spark, [(1, [1.0]), (2, [1.0])]) == []


def test_query(spark):
    from oracle import connect, spark_rows, sql_rows

    assert spark_rows(queries.op10_top_k(spark, SF)) == sql_rows(connect(SF), queries.OP10_SQL)
