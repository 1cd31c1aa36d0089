"""Incremental collection as Structured Streaming.

The stream's checkpoint takes the place of stored high-water marks: a file of messages is read once. Within the stream, repeated messages are dropped by
their key while it is within the watermark, so state stays bounded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tonelake.functions.text import first_url, item_type
from tonelake.schemas import ITEM_KEY, ITEMS, conform, layout
from tonelake.sources.tables import has_content

MESSAGES = "chat_id bigint, chat_name string, message_id bigint, date string, text string, has_photo boolean, has_document boolean, file_path string, file_name string"


def message_stream(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """Messages from JSON files as they arrive."""
    return spark.readStream.schema(layout(MESSAGES)).option("maxFilesPerTrigger", max_files).json(path)


def collected(messages: DataFrame) -> DataFrame:
    """Items made from messages with some content; works on streams and tables alike."""
    rows = messages.filter(has_content()).withColumn("url", first_url(F.col("text")))
    rows = rows.withColumn("type", item_type(F.col("has_photo"), F.col("has_document"), F.col("url"))).withColumn("text", F.nullif("text", F.lit("")))
    return conform(rows, ITEMS)


def timed(rows: DataFrame, lateness: str) -> DataFrame:
    """Rows with ``event_time`` and a watermark on it; a stream has one watermark, so the first one set stays."""
    return rows if "event_time" in rows.columns else rows.withColumn("event_time", F.to_timestamp("date")).withWatermark("event_time", lateness)


def without_repeats(messages: DataFrame, lateness: str = "30 days") -> DataFrame:
    """A stream without messages seen before, as far back as the watermark reaches; adds ``event_time``."""
    return timed(messages, lateness).dropDuplicatesWithinWatermark([*ITEM_KEY])


def collect_into(messages: DataFrame, path: str, checkpoint: str, then: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Appends new items to a Parquet table, all that there is and then stops; ``then`` is called on each batch instead, if given."""
    writer = collected(messages).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return writer.foreachBatch(then).start() if then else writer.format("parquet").option("path", path).start()


def daily_counts(items: DataFrame, lateness: str = "2 days") -> DataFrame:
    """(day window, chat_id, n): items by day and channel from a stream, closed by the watermark."""
    return timed(items, lateness).groupBy(F.window("event_time", "1 day").alias("day"), "chat_id").agg(F.count("*").alias("n"))
