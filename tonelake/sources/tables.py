"""Reading and changing the items, scores and prices tables, as functions from frames to frames.

Tables are Parquet; a change gives the table's new content, which the caller writes where it belongs. No function here runs a job, except
the sinks.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonelake.schemas import GOLD, ITEM_KEY, ITEMS, PRICES, SCORE_KEY, SCORES, check_values, conform, layout
from tonelake.session import stored


def read_items(spark: SparkSession, path: str) -> DataFrame:
    return conform(spark.read.parquet(path), ITEMS)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    return conform(spark.read.parquet(path), SCORES)


def read_prices(spark: SparkSession, path: str, start: str | None = None) -> DataFrame:
    return prices_since(conform(spark.read.parquet(path), PRICES), start)


def prices_since(prices: DataFrame, start: str | None = None) -> DataFrame:
    """Prices on and after a date (all without one); the bound reaches the scan."""
    return prices if start is None else prices.filter(F.col("date") >= F.lit(start).cast("date"))


def write_scores(scores: DataFrame, path: str) -> None:
    """Scores laid out by rubric, so that pinning one reads only its files."""
    check_values(scores).write.mode("overwrite").partitionBy("rubric_version").parquet(path)


def upsert(table: DataFrame, changes: DataFrame, key: tuple[str, ...], order: Column | None = None) -> DataFrame:
    """The table with rows replaced or added by key; of several changes to a key the last by ``order`` holds, and of those the last in the order of the changes' columns.

    One shuffle on the key. Columns that the changes don't have keep their values, so taking in an item again does not lose what
    was derived from it."""
    rest = F.struct(*[c for c in changes.columns if c not in key] or [F.lit(0)])
    latest = Window.partitionBy(*key).orderBy(*([order.desc()] if order is not None else []), rest.desc())
    new = changes.withColumn("__n", F.row_number().over(latest)).filter("__n = 1").drop("__n").withColumn("__changed", F.lit(True))
    joined = table.alias("old").join(new.alias("new"), list(key), "full")
    out = []
    for c in table.columns:
        if c in key:
            out.append(F.col(c))
        elif c in changes.columns:
            out.append(F.when(F.col("new.__changed"), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c))
        else:
            out.append(F.col(f"old.{c}").alias(c))
    return joined.select(*out)


def upsert_partitions(path: str, table_layout: str, changes: DataFrame, key: tuple[str, ...], by: str, order: Column | None = None) -> None:
    """Takes changes into a table stored by the partitions of ``by``: only partitions that a change falls into are read, shuffled and written anew, others keep
    their files. A row must stay in its partition; columns that the changes lack keep their values."""
    spark = changes.sparkSession
    changes = stored(changes, "changes")
    touched = F.broadcast(changes.select(by).distinct())  # a row for each partition
    old = spark.read.schema(layout(table_layout)).parquet(path).join(touched, by, "left_semi")
    # Written beside the table first, as it is read from there.
    merged = stored(upsert(old, changes, (*key, by), order), "merged")
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def upsert_items(items: DataFrame, collected: DataFrame, order: Column | None = None) -> DataFrame:
    return upsert(items, collected, ITEM_KEY, order)


def upsert_scores(scores: DataFrame, scored: DataFrame, now: Column | None = None) -> DataFrame:
    """Scores with new ones taken in; without ``scored_at`` they get the present time."""
    at = F.coalesce("scored_at", now if now is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss"))
    return upsert(scores, check_values(scored.withColumn("scored_at", at)), SCORE_KEY, F.col("scored_at"))


def update_columns(table: DataFrame, changes: DataFrame, key: tuple[str, ...] = ITEM_KEY) -> DataFrame:
    """The table with the changes' columns put in where keys match; keys that the table lacks are left out."""
    marked = changes.withColumn("__changed", F.lit(True))
    joined = table.alias("old").join(marked.alias("new"), list(key), "left")
    hit = F.coalesce(F.col("new.__changed"), F.lit(False))
    return joined.select(*[F.when(hit, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) if c in changes.columns and c not in key else (F.col(c) if c in key else F.col(f"old.{c}").alias(c)) for c in table.columns])


def update_summaries(items: DataFrame, summaries: DataFrame, now: Column | None = None) -> DataFrame:
    """Puts summary, sentiment_score, scope and topic into items and stamps them."""
    stamp = now if now is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
    changes = check_values(summaries.select(*ITEM_KEY, "summary", "sentiment_score", "scope", "topic")).withColumn("summarized_at", stamp)
    return update_columns(items, changes)


def update_extractions(items: DataFrame, extracted: DataFrame, now: Column | None = None) -> DataFrame:
    """Puts extracted_text and extract_status into items, with the text's length (0 without text)."""
    stamp = now if now is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
    changes = check_values(extracted.select(*ITEM_KEY, "extracted_text", "extract_status"))
    changes = changes.withColumns({"extract_chars": F.coalesce(F.length("extracted_text"), F.lit(0)), "extracted_at": stamp})
    return update_columns(items, changes)


def update_clusters(items: DataFrame, clusters: DataFrame) -> DataFrame:
    """Puts dup_cluster_id, is_cluster_head and mention_channels into items."""
    return update_columns(items, clusters.select(*ITEM_KEY, "dup_cluster_id", "is_cluster_head", "mention_channels"))


def reset_summaries(items: DataFrame, day: str | None = None) -> DataFrame:
    """Clears summary, sentiment_score, scope, topic and their stamp, on one day or everywhere."""
    hit = F.lit(True) if day is None else F.substring("date", 1, 10) == day
    return items.withColumns({c: F.when(~hit, F.col(c)) for c in ("summary", "sentiment_score", "scope", "topic", "summarized_at")})


def high_water_marks(items: DataFrame, channels: DataFrame | None = None) -> DataFrame:
    """(chat_id, last_id) by channel; channels without items have 0."""
    marks = items.groupBy("chat_id").agg(F.max("message_id").alias("last_id"))
    if channels is None:
        return marks
    return channels.select("chat_id").distinct().join(marks, "chat_id", "left").select("chat_id", F.coalesce("last_id", F.lit(0)).alias("last_id"))


def new_messages(messages: DataFrame, items: DataFrame, *, now: Column | None = None, backfill_days: int = 30) -> DataFrame:
    """Messages after each channel's high-water mark, with some content. A channel without items goes back ``backfill_days``.

    ``messages``: chat_id, message_id, date, text, has_photo, has_document. Marks are one row a channel."""
    marks = high_water_marks(items)
    since = F.date_sub((now if now is not None else F.current_timestamp()).cast("date"), backfill_days)
    joined = messages.join(marks, "chat_id", "left")
    fresh = F.when(F.col("last_id").isNull(), F.to_date(F.substring("date", 1, 10)) >= since).otherwise(F.col("message_id") > F.col("last_id"))
    return joined.filter(fresh).filter(has_content()).drop("last_id")


def media_path(root: str) -> Column:
    """Where a message's media are kept: by channel and month of the message, photos by message id, documents by their own name."""
    name = F.when(F.coalesce("has_photo", F.lit(False)), F.concat(F.col("message_id").cast("string"), F.lit(".jpg"))).otherwise(F.col("file_name"))
    return F.concat_ws("/", F.lit(root), F.col("chat_name"), F.substring("date", 1, 7), name)


def has_content() -> Column:
    """Whether a message has text, a photo or a document."""
    return (F.coalesce(F.length("text"), F.lit(0)) > 0) | F.coalesce("has_photo", F.lit(False)) | F.coalesce("has_document", F.lit(False))


def pending_media(items: DataFrame, *, force: bool = False, channel: str | None = None, limit: int | None = None) -> DataFrame:
    """Documents and photos not extracted yet, oldest first."""
    out = items.filter(F.col("type").isin("document", "photo"))
    if not force:
        out = out.filter(F.col("extract_status").isNull())
    if channel is not None:
        out = out.filter(F.col("chat_name") == channel)
    out = out.select("chat_id", "message_id", "chat_name", "type", "file_path", "date").orderBy("date", "chat_id", "message_id")
    return out if limit is None else out.limit(limit)


def load_channels(spark: SparkSession, path: str) -> DataFrame:
    """(chat_id, chat_name) from a JSON object of names by id. The file is small and read whole; a missing one fails."""
    text = spark.read.text(path, wholetext=True)
    names = F.from_json("value", "map<string, string>")
    return text.select(F.explode(names).alias("id", "chat_name")).select(F.col("id").cast("bigint").alias("chat_id"), "chat_name")


def channel_map(path: str) -> dict[int, str]:
    """The same on the driver, for tools that need a dictionary."""
    return {int(k): v for k, v in json.loads(Path(path).read_text(encoding="utf-8")).items()}


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Hand-made labels from CSV: rows without direction are left out, a magnitude that is no number is null."""
    return typed_gold(spark.read.csv(path, header=True, schema=layout(GOLD)))


def typed_gold(raw: DataFrame) -> DataFrame:
    number = F.expr("try_cast(direction as double)")
    out = raw.select("chat_id", "message_id", number.cast("int").alias("direction"), F.expr("try_cast(magnitude as double)").alias("magnitude"), "level")
    return out.filter(F.col("direction").isNotNull())


def gold_template(scores: DataFrame, sample_size: int = 60, seed: int = 42) -> DataFrame:
    """A sample of scored items, the same on every run, with blank answers, sorted by ids."""
    ids = scores.select("chat_id", "message_id").distinct()
    drawn = ids.orderBy(F.md5(F.concat_ws("_", F.lit(str(seed)), "chat_id", "message_id")), "chat_id", "message_id").limit(sample_size)
    blank = F.lit(None).cast("string")
    return drawn.select("chat_id", "message_id", blank.alias("direction"), blank.alias("magnitude"), blank.alias("level")).orderBy("chat_id", "message_id")


def labelled_path(path: str, label: str) -> str:
    """The path with a label behind its name's stem."""
    head, dot, suffix = path.rpartition(".")
    return f"{head}_{label}{dot}{suffix}" if dot and "/" not in suffix else f"{path}_{label}"


def write_csv(df: DataFrame, path: str, label: str | None = None) -> str:
    """One CSV file with a header in a folder; a label goes behind the name's stem. For results of report size."""
    target = labelled_path(path, label) if label else path
    df.coalesce(1).write.mode("overwrite").csv(target, header=True)
    return target


def json_records(df: DataFrame) -> DataFrame:
    """One JSON text per row, column ``record``; nulls are written."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("record"))


def pdf_texts(spark: SparkSession, path: str, reader, max_pages: int = 2) -> DataFrame:
    """(path, text) of PDF files. ``reader`` is a function of (bytes, max_pages) that gives the pages' texts; a failure gives null."""

    def run(frames):
        for frame in frames:
            out = []
            for content in frame["content"]:
                try:
                    out.append("\n".join(reader(content, max_pages)[:max_pages]).strip())
                except Exception:  # noqa: BLE001  whatever a file holds, others must go on; null says it could not be read
                    out.append(None)
            yield frame[["path"]].assign(text=out)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, text string")
