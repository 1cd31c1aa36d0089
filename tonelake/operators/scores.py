"""Reading scores: pinned and latest versions, items not scored yet, and the sets that indices and charts are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonelake.schemas import CLASSIFIER_RUBRIC, ITEM_KEY, RUBRIC

MIN_CONFIDENCE = 0.4


def score() -> Column:
    """Direction times magnitude; null if either is."""
    return F.col("direction") * F.col("magnitude")


def day(column: str = "date") -> Column:
    return F.substring(column, 1, 10)


def latest_scores(scores: DataFrame, rubric: str | None = None) -> DataFrame:
    """Scores of one rubric, or each item's latest by ``scored_at``; rows that tie for the latest all stay."""
    if rubric is not None:
        return scores.filter(F.col("rubric_version") == rubric).withColumn("score", score())
    newest = Window.partitionBy(*ITEM_KEY).orderBy(F.col("scored_at").desc())
    return scores.withColumn("__rank", F.rank().over(newest)).filter("__rank = 1").drop("__rank").withColumn("score", score())


def scored_items(items: DataFrame, scores: DataFrame) -> DataFrame:
    """Scores with their item's columns of use. Only these columns are read."""
    slim = items.select(*ITEM_KEY, "date", "is_cluster_head", "mention_channels")
    return scores.join(slim, list(ITEM_KEY))


def heads() -> Column:
    """One item per cluster, or not clustered yet."""
    return (F.col("is_cluster_head") == 1) | F.col("is_cluster_head").isNull()


def broad_set(items: DataFrame, scores: DataFrame, rubric: str = RUBRIC) -> DataFrame:
    """Cluster heads with a direction under a rubric: what charts of scores show."""
    chosen = scores.filter((F.col("rubric_version") == rubric) & F.col("direction").isNotNull())
    return scored_items(items, chosen).filter(heads()).withColumns({"day": day(), "score": score()})


def index_set(items: DataFrame, scores: DataFrame, *, level: str | None = None, include_recap: bool = False, rubric: str = RUBRIC, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """What daily indices are made of: confident enough or without confidence, no recaps unless asked for, optionally one level."""
    out = broad_set(items, scores, rubric).filter(F.col("confidence").isNull() | (F.col("confidence") >= min_confidence))
    if not include_recap:
        out = out.filter(F.col("novelty").isNull() | (F.col("novelty") != "recap"))
    return out if level is None else out.filter(F.col("level") == level)


def tagged_events(items: DataFrame, scores: DataFrame, rubric: str | None = None) -> DataFrame:
    """Scores with a ticker and a direction other than 0. All rubrics count unless one is pinned."""
    chosen = scores.filter(F.col("ticker").isNotNull() & F.col("direction").isNotNull() & (F.col("direction") != 0))
    if rubric is not None:
        chosen = chosen.filter(F.col("rubric_version") == rubric)
    return scored_items(items, chosen).select(*ITEM_KEY, "rubric_version", "ticker", "direction", F.to_date(day()).alias("event_date"))


def unscored(items: DataFrame, scores: DataFrame, rubric: str = RUBRIC, *, force: bool = False, on: str | None = None, since: str | None = None, channel: str | None = None, limit: int | None = None) -> DataFrame:
    """Items with text that a rubric has not scored, oldest first."""
    out = items.filter(F.col("text").isNotNull() | F.col("extracted_text").isNotNull())
    if not force:
        out = out.join(scores.filter(F.col("rubric_version") == rubric).select(*ITEM_KEY), list(ITEM_KEY), "left_anti")
    for wanted, test in ((on, day() == on), (since, day() >= F.lit(since)), (channel, F.col("chat_name") == channel)):
        if wanted is not None:
            out = out.filter(test)
    out = out.orderBy("date", "chat_id", "message_id")
    return out if limit is None else out.limit(limit)


def unsummarised(items: DataFrame) -> DataFrame:
    return items.filter(F.col("summary").isNull()).orderBy("date", "chat_id", "message_id")


def unscored_days(items: DataFrame) -> DataFrame:
    """Days with items that have text and no sentiment score."""
    return items.filter(F.col("sentiment_score").isNull() & F.col("text").isNotNull()).select(day().alias("day")).distinct().orderBy("day")


def migrate_legacy(items: DataFrame) -> DataFrame:
    """Old single scores of -5 to 5 as direction and magnitude: the sign, and the size rounded half to even, 3 at most."""
    old = items.filter(F.col("sentiment_score").isNotNull())
    return old.select(*ITEM_KEY, F.signum("sentiment_score").cast("int").alias("direction"), F.least(F.lit(3), F.bround(F.abs("sentiment_score")).cast("int")).alias("magnitude"), F.col("scope").alias("level"))


def rubric_pairs(scores: DataFrame, first: str = RUBRIC, second: str = CLASSIFIER_RUBRIC) -> DataFrame:
    """Items with a direction under both rubrics: each one's direction and score."""
    sides = []
    for name, rubric in (("a", first), ("b", second)):
        rows = scores.filter((F.col("rubric_version") == rubric) & F.col("direction").isNotNull())
        sides.append(rows.select(*ITEM_KEY, F.col("direction").alias(f"direction_{name}"), score().alias(f"score_{name}")))
    return sides[0].join(sides[1], list(ITEM_KEY))


def channel_labels(items: DataFrame, prefix: str = "채널") -> DataFrame:
    """(chat_id, channel): labels numbered by id over all channels that have items. One row a channel."""
    ids = items.select("chat_id").distinct()
    return ids.select("chat_id", F.concat(F.lit(prefix), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("chat_id")).cast("string")).alias("channel"))
