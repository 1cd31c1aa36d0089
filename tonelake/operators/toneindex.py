"""Daily tone indices: shrinkage, channel-demeaned and breadth, and their weighted composite."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonelake.operators.scores import index_set
from tonelake.schemas import LEVELS, METHODS

SHRINK_K = 5.0


def consensus_weight(by_consensus: bool) -> Column:
    """How much an item counts: 1, or the number of channels that carried its story."""
    return F.coalesce(F.col("mention_channels"), F.lit(1)).cast("double") if by_consensus else F.lit(1.0)


def weighted_mean(value: Column, weight: Column) -> Column:
    """Sum of value times weight over the sum of all weights, those of null values too; with no weight at all the plain mean."""
    total = F.sum(weight)
    return F.when(total != 0, F.coalesce(F.sum(value * weight), F.lit(0.0)) / F.when(total != 0, total)).otherwise(F.avg(value))


def index_of(rows: DataFrame, method: str = "shrinkage", shrink_k: float = SHRINK_K, by_consensus: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """One row a day (and per ``by``) from an index set: day, index_value, n_items, n_channels, breadth. One aggregation."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}, got {method!r}")
    w = F.col("__w")
    rows = rows.withColumn("__w", consensus_weight(by_consensus))
    value = F.col("score").cast("double")
    if method == "channel_demeaned":
        # Means are one row a channel, aggregated before any shuffle: a channel with most of the rows is no hot key.
        means = rows.groupBy("chat_id", *by).agg(F.avg("score").alias("__mean"))
        rows = rows.join(means, ["chat_id", *by])
        value = value - F.col("__mean")
    rows = rows.withColumn("__v", value)
    n = F.count("*")
    mean = weighted_mean(F.col("__v"), w)
    total = F.sum(w)
    breadth = F.try_divide(F.coalesce(F.sum(F.when(F.col("score") > 0, w)), F.lit(0.0)) - F.coalesce(F.sum(F.when(F.col("score") < 0, w)), F.lit(0.0)), total)
    shown = {"shrinkage": n / (n + F.lit(float(shrink_k))) * mean, "channel_demeaned": mean, "breadth": breadth}[method]
    return rows.groupBy("day", *by).agg(shown.alias("index_value"), n.alias("n_items"), F.countDistinct("chat_id").alias("n_channels"), breadth.alias("breadth"))


def daily_index(items: DataFrame, scores: DataFrame, *, level: str | None = None, method: str = "shrinkage", shrink_k: float = SHRINK_K, include_recap: bool = False, by_consensus: bool = False) -> DataFrame:
    return index_of(index_set(items, scores, level=level, include_recap=include_recap), method, shrink_k, by_consensus)


def level_indices(items: DataFrame, scores: DataFrame, **options) -> DataFrame:
    """The daily index of every level at once: one scan and one aggregation by day and level."""
    recap = options.pop("include_recap", False)
    rows = index_set(items, scores, include_recap=recap).filter(F.col("level").isin(*LEVELS))
    return index_of(rows, by=("level",), **options)


def parse_weights(text: str) -> dict[str, float]:
    """``macro=0.4,market=0.3`` as a dictionary."""
    return {k.strip(): float(v) for k, _, v in (part.partition("=") for part in text.split(","))}


def weighted_composite(items: DataFrame, scores: DataFrame, weights: Mapping[str, float], **options) -> DataFrame:
    """Levels blended by given weights, per day over the levels present: day, index_value, n_items. Days of zero weight are left out."""
    if unknown := set(weights) - set(LEVELS):
        raise ValueError(f"unknown level(s) in weights: {sorted(unknown)}")
    share = F.create_map(*[F.lit(x) for k, v in sorted(weights.items()) for x in (k, float(v))])
    rows = level_indices(items, scores, **options).filter(F.col("level").isin(*weights)).withColumn("share", share[F.col("level")])
    out = rows.groupBy("day").agg(F.sum(F.col("share") * F.col("index_value")).alias("value"), F.sum("share").alias("present"), F.sum("n_items").alias("n_items"))
    return out.filter("present <> 0").select("day", (F.col("value") / F.col("present")).alias("index_value"), "n_items")
