"""Agreement of scores with hand-made labels. Each measure drops nulls for itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonelake.functions.stats import rank_correlation, correlation
from tonelake.schemas import ITEM_KEY, LEVELS


def matched(gold: DataFrame, scores: DataFrame) -> DataFrame:
    """Gold rows with the same item's score: columns end in _gold and _llm."""
    sides = []
    for name, frame in (("gold", gold), ("llm", scores)):
        sides.append(frame.select(*ITEM_KEY, *[F.col(c).alias(f"{c}_{name}") for c in ("direction", "magnitude", "level")]))
    return sides[0].join(sides[1], list(ITEM_KEY))


def agreement(pairs: DataFrame) -> DataFrame:
    """One row: matches, accuracy of direction, mean absolute error of magnitude, each with its n."""
    same = (F.col("direction_gold") == F.col("direction_llm")).cast("double")
    gap = F.abs(F.col("magnitude_gold") - F.col("magnitude_llm")).cast("double")
    return pairs.agg(F.count("*").alias("n"), F.count(same).alias("n_direction"), F.avg(same).alias("accuracy"), F.count(gap).alias("n_magnitude"), F.avg(gap).alias("mae"))


def confusion(pairs: DataFrame, wide: bool = False) -> DataFrame:
    """Counts by gold and scored level, long or with a column for each level."""
    rows = pairs.filter("level_gold is not null and level_llm is not null")
    if wide:
        return rows.groupBy("level_gold").pivot("level_llm", list(LEVELS)).count().na.fill(0)
    return rows.groupBy("level_gold", "level_llm").agg(F.count("*").alias("n"))


def spearman(pairs: DataFrame) -> DataFrame:
    """One row: n and rank correlation of direction times magnitude; null below three rows."""
    rows = pairs.select((F.col("direction_gold") * F.col("magnitude_gold")).cast("double").alias("x"), (F.col("direction_llm") * F.col("magnitude_llm")).cast("double").alias("y")).dropna()
    return rank_correlation(rows, "x", "y").withColumn("rho", F.when(F.col("n") >= 3, F.col("rho")))


def rubric_agreement(pairs: DataFrame) -> DataFrame:
    """One row for two rubrics: items, share of equal directions, correlation of scores (null below three)."""
    same = (F.col("direction_a") == F.col("direction_b")).cast("double")
    out = pairs.agg(F.count("*").alias("n"), F.avg(same).alias("agreement"), correlation(F.col("score_a"), F.col("score_b")).alias("corr"))
    return out.withColumn("corr", F.when(F.col("n") >= 3, F.col("corr")))
