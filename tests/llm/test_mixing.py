import hashlib
import math
from collections import Counter

import pytest
from oracle import SF

from tonelake.llm import mixing, queries


def inverse_poisson(mean, u):
    k, p = 0, math.exp(-mean)
    total = p
    while total <= u and k < mean + 12 * math.sqrt(mean) + 20:
        k += 1
        p = p * mean / k
        total += p
    return k


def brute_copies(rows, means, seed):
    out = Counter()
    for i, source in rows:
        parts = max(1, math.ceil(means[source] / 256))
        for part in range(parts):
            name = f"{seed}|{'' if i is None else i}" + (f"|{part}" if part else "")
            out[i, source] += inverse_poisson(means[source] / parts, int(hashlib.md5(name.encode()).hexdigest()[:13], 16) / 2**52)
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, s, f"t{i}", 1) for i, s in rows], "doc_id bigint, source string, text string, mean int")


def test_copies_like_brute_force(spark):
    rows = [(i, "big") for i in range(600)] + [(1000 + i, "small") for i in range(30)] + [(2000 + i, None) for i in range(20)] + [(None, "small"), (1001, "small")]
    weights = {"big": 0.2, "small": 0.5}
    n = {s: sum(x == s for _, x in rows) for s in ("big", "small", None)}
    means = {s: {"big": 0.2, "small": 0.5, None: 0.3}[s] * len(rows) / n[s] for s in n}
    got = mixing.mix(frame(spark, rows), weights, seed="z").select("row.*", "copy", "mix_key").collect()
    assert Counter((r.doc_id, r.source) for r in got) == +brute_copies(rows, means, "z")
    assert {r["mean"] for r in got} == {1}


def test_shares_are_met(spark):
    rows = [(i, "a" if i % 10 else "b") for i in range(20_000)]
    got = Counter(r.source for r in mixing.mixed_documents(frame(spark, rows), {"a": 0.3, "b": 0.7}).collect())
    assert abs(got["a"] / 20_000 - 0.3) < 0.02 and abs(got["b"] / 20_000 - 0.7) < 0.04


def test_large_means_and_shuffle(spark):
    """Means above what is inverted at once keep the distribution: mean and variance agree, whatever the size of the table."""
    rows = [(i, "a" if i >= 300 else "b") for i in range(4000)]
    out = mixing.mix(frame(spark, rows), {"a": 0.01, "b": 0.99}, size=30.0).cache()
    copies = Counter((r.row.doc_id, r.row.source) for r in out.collect())
    assert copies == +brute_copies(rows, {"a": 0.01 * 120_000 / 3700, "b": 0.99 * 120_000 / 300}, "mix")
    mean = 0.99 * 120_000 / 300
    found = [copies[i, "b"] for i in range(300)]
    assert mean > mixing.MOST_MEAN and abs(sum(found) / 300 - mean) < 4 * math.sqrt(mean / 300)
    assert 0.75 < sum((x - mean) ** 2 for x in found) / 300 / mean < 1.3
    keys = [r.mix_key for r in out.collect()]
    assert len(set(keys)) == len(keys)
    parts = out.selectExpr("spark_partition_id() p", "mix_key").collect()
    assert all(a.p != b.p or a.mix_key <= b.mix_key for a, b in zip(parts, parts[1:], strict=False))


def test_clashing_columns(spark, tmp_path):
    names = "doc_id bigint, source string, text string, copy int, mix_key string, Copy_ int, steps int, parts int, s string, row string, mean int, u int"
    rows = [(i, f"s{i % 3}", "t", 5, "k", 6, 7, 8, "x", "r", 9, 10) for i in range(60)]
    df = spark.createDataFrame(rows, names)
    mixed = mixing.spread(mixing.mix(df, {"s0": 0.5}), "copy", "mix_key")
    assert mixed.columns == [*df.columns, "copy__", "mix_key_"]
    mixed.write.parquet(str(tmp_path / "out"))
    assert {(r.mean, r.u, r.row) for r in mixing.mixed_documents(df).collect()} == {(9, 10, "r")}
    df.write.parquet(str(tmp_path / "documents.parquet"))
    assert queries.op5_mixing(spark, str(tmp_path)).columns == mixed.columns


@pytest.mark.parametrize("weights", [None, {}, {"gone": 1.0}, {"a": 0.0}])
def test_odd_weights_and_empty(spark, weights):
    assert mixing.mixed_documents(frame(spark, []), weights).count() == 0
    assert mixing.mixed_documents(frame(spark, [(1, "a"), (2, "b")]), weights).columns == ["doc_id", "source", "text", "mean"]


def test_query(spark):
    from oracle import connect, spark_rows, sql_rows

    assert spark_rows(queries.op5_mixing(spark, SF)) == sql_rows(connect(SF), queries.OP5_SQL)
