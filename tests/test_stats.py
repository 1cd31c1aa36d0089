import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tonelake.functions import stats


@pytest.mark.parametrize(("t", "df", "p"), [(12.706, 1, 0.05), (2.228, 10, 0.05), (2.093, 19, 0.05), (1, 1, 0.5), (0, 5, 1.0)])
def test_t_tail(t, df, p):
    assert stats.t_tail(t, df) == pytest.approx(p, abs=2e-5)


def test_normal_tail():
    assert stats.normal_tail(1.22) == pytest.approx(0.22246, abs=1e-5)
    assert stats.normal_tail(2.61) == pytest.approx(0.00905, abs=1e-5)


def test_large_df_is_normal():
    assert stats.t_tail(1.7, 1e6) == pytest.approx(stats.normal_tail(1.7), abs=1e-5)


def test_correlation_of_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (None, 4.0)], "x double, y double")
    assert df.agg(stats.correlation(F.col("x"), F.col("y")).alias("r")).first().r is None


def test_spearman_ranks(spark):
    x = [3.0, 1.0, 1.0, 2.0, 3.0, 3.0]
    got = [r.k for r in spark.createDataFrame([(v,) for v in x], "x double").select("x", stats.average_rank("x").alias("k")).orderBy("x").collect()]
    assert got == sorted(pd.Series(x).rank())


@pytest.mark.parametrize("values, parts", [(7, 4), (2000, 9), (1, 4)])
def test_rank_correlation_like_pandas(spark, values, parts):
    rng = np.random.default_rng(values)
    frame = pd.DataFrame({"x": rng.integers(0, values, 3000) / 2, "y": rng.integers(0, values, 3000) - 0.0})
    frame["y"] += frame["x"]
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        df = spark.createDataFrame(frame)
        got = stats.rank_correlation(df, "x", "y").first()
        ranks = {r.x: r["rank"] for r in stats.value_ranks(df.withColumn("c", F.lit(1)), "x", "c").collect()}
        plan = stats.rank_correlation(df, "x", "y")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert ranks == dict(zip(frame["x"], frame["x"].rank()))
    want = frame["x"].rank().corr(frame["y"].rank())
    assert got.n == 3000 and (got.rho is None if values == 1 else got.rho == pytest.approx(want, abs=1e-12))
    assert "rank(" not in plan
    assert stats.rank_correlation(df.limit(0), "x", "y").first() == (0, None)


def test_fisher(spark):
    df = spark.createDataFrame([(0.5, 20), (1.0, 20), (0.5, 3), (None, 9)], "r double, n bigint")
    lo, hi = stats.fisher_interval(F.col("r"), F.col("n"))
    rows = df.select(lo.alias("lo"), hi.alias("hi"), stats.error_bar(F.col("r"), lo).alias("bar")).collect()
    z, s = math.atanh(0.5), 1.96 / math.sqrt(17)
    assert rows[0].lo == pytest.approx(math.tanh(z - s)) and rows[0].hi == pytest.approx(math.tanh(z + s))
    assert all(r.lo is None and r.hi is None and r.bar is None for r in rows[1:])


def test_hac_against_double_sum():
    rng = np.random.default_rng(3)
    n, lags = 40, 5
    x = np.column_stack([np.ones(n), rng.normal(size=n), rng.normal(size=n)])
    y = x @ [1, 2, 3] + rng.normal(size=n)
    b, se = stats.hac(y, x, lags)
    u = y - x @ b
    s = sum(max(0, 1 - abs(i - j) / (lags + 1)) * u[i] * u[j] * np.outer(x[i], x[j]) for i in range(n) for j in range(n))
    inverse = np.linalg.inv(x.T @ x)
    assert np.allclose(se, np.sqrt(np.diag(inverse @ s @ inverse)))


def test_regression_needs_five_rows(spark):
    df = spark.createDataFrame([(i, float(i), float(i % 2)) for i in range(4)], "d int, y double, x double")
    assert stats.hac_regression(df, "y", ["x"], "d").count() == 0
    assert stats.hac_regression(df.limit(0), "y", ["x"], "d").count() == 0
