"""Statistics as column expressions, and what Spark lacks: t and normal tail probabilities and robust regression."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tonelake.session import stored

#: Groups smaller than this are flagged.
SMALL_SAMPLE = 30


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation of rows in which both are present; null if a side is constant or no row is left."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x).cast("double"), F.when(both, y).cast("double")
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def average_rank(value: str, within: list[str] | None = None) -> Column:
    """Ranks with ties sharing their mean. The window is one partition for each group: meant for label sets and daily series."""
    keys = within or []
    order = Window.partitionBy(*keys).orderBy(value) if keys else Window.partitionBy(F.lit(0)).orderBy(value)
    same = Window.partitionBy(*keys, value)
    return F.rank().over(order) + (F.count("*").over(same) - 1) / F.lit(2.0)


def value_ranks(df: DataFrame, value: str, weight: str) -> DataFrame:
    """(value, rank): the mean rank, from 1, that rows of each value share where a row stands for ``weight`` ones. Values are counted first and then cut into ranges; a
    range adds what lies before it, so no task sees them all."""
    counts = df.groupBy(value).agg(F.sum(weight).alias("n"))
    # Stored, as the ranges come from a sample and must be the same for both uses.
    dealt = stored(counts.repartitionByRange(F.col(value)).withColumn("part", F.spark_partition_id()), "ranks")
    parts = dealt.groupBy("part").agg(F.sum("n").alias("n"))
    along = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("before"))  # a row for each range
    inside = Window.partitionBy("part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("within", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(offsets), "part")
    return placed.select(value, (F.col("before") + F.col("within") + (F.col("n") + 1) / F.lit(2.0)).alias("rank"))


def rank_correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: n and the correlation of the ranks of two columns without nulls, ties sharing their mean; null if a side is constant or there is no row."""
    cells = stored(df.groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("c")), "cells")
    for side in ("x", "y"):
        cells = cells.join(value_ranks(cells.select(side, "c"), side, "c").withColumnRenamed("rank", f"r{side}"), side)
    products = {"xy": ("rx", "ry"), "xx": ("rx", "rx"), "yy": ("ry", "ry")}
    sums = cells.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), *[F.sum(F.col("c") * F.col(p) * F.col(q)).alias(name) for name, (p, q) in products.items()])
    middle = F.col("n") * ((F.col("n") + 1) / 2.0) * ((F.col("n") + 1) / 2.0)  # the mean rank is known
    spread = [F.sqrt(F.greatest(F.col(name) - middle, F.lit(0.0))) for name in ("xx", "yy")]
    return sums.select("n", F.try_divide(F.col("xy") - middle, spread[0] * spread[1]).alias("rho"))


def fisher_interval(r: Column, n: Column) -> tuple[Column, Column]:
    """95 % confidence interval of a correlation; null below four rows and for a perfect one."""
    usable = (n >= 4) & r.isNotNull() & (F.abs(r) < 1)
    safe_r = F.when(usable, r)
    step = F.lit(1.96) / F.sqrt(F.when(usable, n) - 3)
    return F.tanh(F.atanh(safe_r) - step), F.tanh(F.atanh(safe_r) + step)


def error_bar(value: Column, bound: Column) -> Column:
    """Length of an error bar, not below zero; null without a bound."""
    gap = F.abs(value - bound)
    return F.when(gap.isNotNull(), F.greatest(gap, F.lit(0.0)))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    f, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        if i == 0:
            term = 1.0
        elif i % 2 == 0:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + term * d or tiny)
        c = 1 + term / c or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * (f - 1)


def t_tail(t: float, df: float) -> float:
    """Two-sided probability of a larger t."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def normal_tail(z: float) -> float:
    """Two-sided probability of a larger z."""
    return math.erfc(abs(z) / math.sqrt(2))


@F.pandas_udf(DoubleType())
def t_probability(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(x) or pd.isna(n) or n < 1 else t_tail(float(x), float(n)) for x, n in zip(t, df, strict=True)], dtype="float64")


def t_statistic(mean: Column, deviation: Column, n: Column) -> Column:
    """One-sample t against 0; null without spread."""
    return F.try_divide(mean, deviation / F.sqrt(n.cast("double")))


def hac(y: np.ndarray, x: np.ndarray, lags: int) -> tuple[np.ndarray, np.ndarray]:
    """Least squares with Newey-West standard errors (Bartlett weights, no small-sample correction): coefficients, errors."""
    inverse = np.linalg.pinv(x.T @ x)
    b = inverse @ x.T @ y
    g = x * (y - x @ b)[:, None]
    s = g.T @ g
    for lag in range(1, min(lags, len(y) - 1) + 1):
        cross = g[lag:].T @ g[:-lag]
        s += (1 - lag / (lags + 1)) * (cross + cross.T)
    return b, np.sqrt(np.maximum(np.diag(inverse @ s @ inverse), 0))


def hac_regression(rows: DataFrame, target: str, inputs: list[str], order: str, lags: int = 5) -> DataFrame:
    """(name, coef, std_err, t, p, n): regression on a constant and ``inputs``; empty below five rows. ``rows`` is one series, a row a day."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.dropna().sort_values(order)
        out = []
        if len(frame) >= 5:
            x = np.column_stack([np.ones(len(frame)), *[frame[c].to_numpy(float) for c in inputs]])
            b, se = hac(frame[target].to_numpy(float), x, lags)
            for name, coef, err in zip(["const", *inputs], b, se, strict=True):
                t = coef / err if err > 0 else None
                out.append((name, coef, err, t, None if t is None else normal_tail(t), len(frame)))
        return pd.DataFrame(out, columns=["name", "coef", "std_err", "t", "p", "n"])

    slim = rows.select(order, target, *inputs)
    return slim.groupBy().applyInPandas(run, "name string, coef double, std_err double, t double, p double, n bigint")
