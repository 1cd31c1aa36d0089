"""Takes in new posts, and keeps for each day which of its texts were posted more than once.

    python -m jobs.ingest --documents PATH --output PATH --checkpoint PATH [--config jobs/ingest.json]

The input is a folder of Parquet files to which files are added (or a pattern, where a path is a single file), read as a file stream; the checkpoint remembers which were taken. Every run takes what is new and
ends. The output has two tables:

- ``prints``, partitioned by day and batch: a row for each post with the fingerprints of its text (SHA-256 and SimHash of the normalised text, document fingerprint). A batch
  writes its own partitions alone, so a batch that is repeated after a failure puts the same rows in the same place.
- ``texts``, partitioned by day: each text of the day, how many posts and channels had it, and the first post. Only days that a batch touched are made again, from the
  stored prints of these days.

A post that comes a second time, in the same batch or a later one, is not taken again: posts are told apart by channel and message id, and a post keeps its date. Of
rows of one batch with one key the first in the order of their columns is taken. Posts without channel, id or date are left out. How the input is dealt to files and runs makes no difference to
``texts``, nor to ``prints`` apart from the batch.
"""

from __future__ import annotations

import argparse
import logging
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.settings import load, log_to_console
from tonelake.operators import dedupe
from tonelake.schemas import ITEMS, conform
from tonelake.session import build_session, release, stored
from tonelake.sources import synthetic

LOG = logging.getLogger("jobs.ingest")
DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
PRINTS = "chat_id bigint, message_id bigint, item_key string, date string, text_sha256 string, n_chars int, simhash bigint, document_fp string, day date, batch bigint"
TEXTS = "text_sha256 string, n_posts bigint, n_channels bigint, first_key string, day date"


@dataclass(frozen=True)
class Settings:
    #: ``documents`` (the test tables' layout, which is turned into posts) or ``items`` (posts as they are).
    layout: str = "documents"
    #: Files in one batch.
    files_per_batch: int = 1000
    #: Spreads documents over five days instead of half a year.
    near_days: bool = False


def posts_of(rows: DataFrame, settings: Settings) -> DataFrame:
    posts = synthetic.as_items(rows, near=settings.near_days) if settings.layout == "documents" else conform(rows, ITEMS)
    return posts.filter("chat_id is not null and message_id is not null and date is not null")


def prints_of(posts: DataFrame) -> DataFrame:
    """A row for each post; no text leaves the task that reads it."""
    rows = dedupe.fingerprints(posts).select(
        "chat_id", "message_id", "item_key", "date", F.sha2("norm_text", 256).alias("text_sha256"), F.length("norm_text").alias("n_chars"), "simhash", "document_fp", "day"
    )
    one = rows.groupBy("chat_id", "message_id").agg(F.min(F.struct(*rows.columns)).alias("row"))
    return one.select("row.*")


def texts_of(prints: DataFrame) -> DataFrame:
    """Texts with their posts; posts without a text have none to share."""
    found = prints.filter("n_chars > 0").groupBy("day", "text_sha256")
    return found.agg(F.count("*").alias("n_posts"), F.countDistinct("chat_id").alias("n_channels"), F.min("item_key").alias("first_key")).select("text_sha256", "n_posts", "n_channels", "first_key", "day")


def replace(rows: DataFrame, path: str, *by: str) -> None:
    """Writes the partitions that the rows are in, each from these rows alone; others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def tables(spark: SparkSession, output: str) -> tuple[DataFrame, DataFrame]:
    """The stored prints and texts."""
    return spark.read.schema(PRINTS).parquet(f"{output}/prints"), spark.read.schema(TEXTS).parquet(f"{output}/texts")


def begin(spark: SparkSession, output: str) -> None:
    """Makes the folders of tables that are not there yet; what is there stays."""
    for name, layout, by in (("prints", PRINTS, ["day", "batch"]), ("texts", TEXTS, ["day"])):
        spark.createDataFrame([], layout).write.mode("append").partitionBy(*by).parquet(f"{output}/{name}")


def take(rows: DataFrame, number: int, output: str, settings: Settings) -> None:
    """One batch."""
    spark = rows.sparkSession
    fresh = stored(prints_of(posts_of(rows, settings)), "ingest")
    # Few rows: a batch has few days. They prune what is read of the table.
    days = F.broadcast(fresh.select("day").distinct())
    known = tables(spark, output)[0].filter(F.col("batch") != number).join(days, "day", "left_semi").select("day", "chat_id", "message_id")
    new = fresh.join(known, ["day", "chat_id", "message_id"], "left_anti").withColumn("batch", F.lit(number).cast("bigint"))
    replace(new.select(*spark.createDataFrame([], PRINTS).columns), f"{output}/prints", "day", "batch")
    prints = tables(spark, output)[0]
    mine = prints.filter(F.col("batch") == number)
    replace(texts_of(prints.join(F.broadcast(mine.select("day").distinct()), "day", "left_semi")), f"{output}/texts", "day")
    taken = mine.agg(F.count("*").alias("n"), F.countDistinct("day").alias("days")).first()
    LOG.info("batch %d: read %d rows, wrote %d posts of %d days", number, rows.count(), taken["n"], taken["days"])


def run(spark: SparkSession, documents: str, output: str, checkpoint: str, settings: Settings = Settings()) -> int:
    """Takes what is new in ``documents`` and says how many batches that were."""
    layout = DOCUMENTS if settings.layout == "documents" else ITEMS
    begin(spark, output)
    stream = spark.readStream.schema(layout).option("maxFilesPerTrigger", settings.files_per_batch).parquet(documents)
    done: list[int] = []

    def one(rows: DataFrame, number: int) -> None:
        take(rows, number, output, settings)
        done.append(number)

    LOG.info("reading %s", documents)
    query = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    LOG.info("%d new batches in %s", len(done), output)
    return len(done)


def result(spark: SparkSession, output: str) -> DataFrame:
    """Every post with what its day knows about its text."""
    prints, texts = tables(spark, output)
    joined = prints.join(texts, ["day", "text_sha256"], "left")
    shared = [F.coalesce("n_posts", F.lit(1)).alias("n_posts"), F.coalesce("n_channels", F.lit(1)).alias("n_channels"), F.coalesce("first_key", "item_key").alias("first_key")]
    return joined.select("item_key", "chat_id", "message_id", "date", "day", "text_sha256", "n_chars", "simhash", "document_fp", *shared)


def main(argv: Sequence[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="jobs.ingest", description=__doc__)
    for name in ("documents", "output", "checkpoint"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--config")
    a = p.parse_args(argv)
    log_to_console()
    spark = build_session("ingest")
    try:
        run(spark, a.documents, a.output, a.checkpoint, load(Settings, a.config))
    finally:
        release(spark)
        spark.stop()


if __name__ == "__main__":
    main()
