"""The datasets behind the report's charts and tables, and a plain HTML page of them."""

from __future__ import annotations

import html
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonelake.operators.scores import channel_labels, score
from tonelake.schemas import ITEM_KEY, LEVELS, RUBRIC


def score_histogram(broad: DataFrame) -> DataFrame:
    """(level, score, n) of scored items by level; scores are whole numbers, so each is a bin."""
    rows = broad.filter(F.col("level").isin(*LEVELS) & F.col("score").isNotNull())
    return rows.groupBy("level", "score").agg(F.count("*").alias("n"))


def level_weeks(broad: DataFrame) -> DataFrame:
    """(level, week, label, mean_score): mean by level and week from Monday; all levels and weeks that occur, empty cells null."""
    rows = broad.filter(F.col("level").isNotNull() & F.col("score").isNotNull()).withColumn("week", F.to_date(F.date_trunc("week", F.to_date("day"))))
    means = rows.groupBy("level", "week").agg(F.avg("score").alias("mean_score"))
    levels = broad.sparkSession.createDataFrame([(x,) for x in LEVELS], "level string")
    cells = means.select("week").distinct().crossJoin(F.broadcast(levels))  # four rows
    return cells.join(means, ["level", "week"], "left").select("level", "week", F.date_format("week", "MM/dd").alias("label"), "mean_score")


def channel_calibration(broad: DataFrame, items: DataFrame) -> DataFrame:
    """(chat_id, channel, avg_score, n_scored, n_total, coverage_pct) of channels with scored items."""
    scored = broad.groupBy("chat_id").agg(F.avg("score").alias("avg_score"), F.count("*").alias("n_scored"))
    totals = items.groupBy("chat_id").agg(F.count("*").alias("n_total"))
    out = scored.join(totals, "chat_id", "left").join(channel_labels(items), "chat_id", "left")
    return out.select("chat_id", "channel", "avg_score", "n_scored", "n_total", (F.col("n_scored") / F.col("n_total") * 100).alias("coverage_pct"))


def item_stats(items: DataFrame) -> DataFrame:
    """One row: items, items with text, documents and photos without a good extraction."""
    media = F.col("type").isin("document", "photo") & (F.col("extract_status").isNull() | (F.col("extract_status") != "ok"))
    return items.agg(F.count("*").alias("total_items"), F.count_if(F.col("text").isNotNull() | F.col("extracted_text").isNotNull()).alias("scorable"), F.count_if(media).alias("extract_incomplete"))


def stat_strip(items: DataFrame, scores: DataFrame, index_rows: DataFrame, index: DataFrame, rubric: str = RUBRIC) -> DataFrame:
    """One row: the report's headline numbers."""
    scored = scores.filter((F.col("rubric_version") == rubric) & F.col("direction").isNotNull()).agg(F.count("*").alias("scored"))
    valid = index_rows.agg(F.count("*").alias("n_valid"))
    median = index.agg(F.coalesce(F.median("n_items"), F.lit(0.0)).alias("median_daily_n"))
    out = item_stats(items).crossJoin(scored).crossJoin(valid).crossJoin(median)  # one row each
    return out.withColumn("coverage_pct", F.coalesce(F.try_divide(F.col("scored") * 100.0, F.col("scorable")), F.lit(0.0)))


def stock_signs(broad: DataFrame) -> DataFrame:
    """One row: positive and negative items about single stocks."""
    stock = F.col("level") == "stock"
    return broad.agg(F.count_if(stock & (F.col("score") > 0)).alias("n_positive"), F.count_if(stock & (F.col("score") < 0)).alias("n_negative"))


def recent_items(items: DataFrame, scores: DataFrame, limit: int = 150, rubric: str = RUBRIC) -> DataFrame:
    """The newest scored items, copies too, with channel labels instead of names."""
    slim = items.select(*ITEM_KEY, "date", "mention_channels")
    chosen = scores.filter((F.col("rubric_version") == rubric) & F.col("direction").isNotNull())
    top = chosen.join(slim, list(ITEM_KEY)).orderBy(F.desc("date"), *ITEM_KEY).limit(limit)
    labelled = top.join(channel_labels(items), "chat_id", "left")
    return labelled.select("date", "channel", "chat_id", "message_id", "level", "direction", "magnitude", score().alias("score"), "driver", "novelty", "mention_channels", "summary")


def searched(rows: DataFrame, channel: str | None = None, level: str | None = None, date_part: str | None = None) -> DataFrame:
    """The item table's filters: equal channel and level, part of the date."""
    out = rows
    if channel:
        out = out.filter(F.col("channel") == channel)
    if level:
        out = out.filter(F.col("level") == level)
    return out.filter(F.contains("date", F.lit(date_part))) if date_part else out


def extraction_counts(items: DataFrame) -> DataFrame:
    """(chat_name, type, extract_status, n) with the totals by status, where name and type are null: one pass over grouping sets."""
    media = items.filter(F.col("type").isin("document", "photo"))
    sets = media.groupingSets([["chat_name", "type", "extract_status"], ["extract_status"]], "chat_name", "type", "extract_status")
    return sets.agg(F.grouping("chat_name").cast("int").alias("is_total"), F.count("*").alias("n"))


def status_totals(items: DataFrame) -> DataFrame:
    """(place, extract_status, n): documents and photos by how their extraction ended, most frequent first, ties by name. One row a status."""
    counts = extraction_counts(items).filter("is_total = 1").select("extract_status", "n")
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), F.asc_nulls_last("extract_status"))
    return counts.select(F.row_number().over(order).alias("place"), "extract_status", "n").orderBy("place")


def scored_per_day(items: DataFrame, scores: DataFrame) -> DataFrame:
    """(day, rubric_version, n): how many items of each day have been scored."""
    return scores.join(items.select(*ITEM_KEY, F.substring("date", 1, 10).alias("day")), list(ITEM_KEY)).groupBy("day", "rubric_version").agg(F.count("*").alias("n"))


def write_page(datasets: dict[str, DataFrame], paths: list[str], title: str = "Report") -> None:
    """One HTML page of tables, written to each path on the driver, with every row of the datasets: these are aggregates, or limited as ``recent_items`` is."""
    parts = [f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>"]
    for name, df in datasets.items():
        head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
        rows = ["".join(f"<td>{'' if v is None else html.escape(str(v))}</td>" for v in r) for r in df.toLocalIterator()]
        parts.append(f"<h2>{html.escape(name)}</h2><table><tr>{head}</tr>" + "".join(f"<tr>{r}</tr>" for r in rows) + "</table>")
    for path in paths:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text("\n".join(parts), encoding="utf-8")
