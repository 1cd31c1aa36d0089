"""Calls to a paid scorer that are kept as they come.

Requests lie in a folder, one file each, which a stream reads a few files at a time; a batch's answers are written before the stream's checkpoint moves on. After a failure
the next run goes on with the batch that was not written, so no call is repeated whose answer was kept, and at most ``at_once`` calls are under way or lost.
A repeated batch asks for what it has not written yet, so it leaves no second row. A call that failed is kept with its error and may be asked for again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.operators import scoring

REQUESTS = "request_id string, item_ids array<string>, prompt string, day string"
ANSWERS = "request_id string, day string, item_ids array<string>, response string, error string, batch bigint"


def named(requests: DataFrame) -> DataFrame:
    """Requests (day, prompt, item_ids) with an id that follows from the prompt and the items."""
    return requests.withColumn("request_id", F.sha2(F.concat_ws("\n", "prompt", "day", F.array_join("item_ids", "\n")), 256))


def _table(spark: SparkSession, path: str, layout: str, *by: str) -> DataFrame:
    spark.createDataFrame([], layout).write.mode("append").partitionBy(*by).parquet(path)  # makes the folder where there is none
    return spark.read.schema(layout).parquet(path)


def answers(spark: SparkSession, folder: str) -> DataFrame:
    """(request_id, day, item_ids, response, error): one row for each request that was asked; an answer goes before an error, the later before the earlier."""
    rows = _table(spark, f"{folder}/answers", ANSWERS, "batch")
    best = F.max_by(F.struct("day", "item_ids", "response", "error"), F.struct(F.col("error").isNull(), "batch"))
    return rows.groupBy("request_id").agg(best.alias("row")).select("request_id", "row.*")


def add_requests(requests: DataFrame, folder: str) -> int:
    """Files the requests (with ids) that are not waiting and have no answer, and says how many there are."""
    spark = requests.sparkSession
    filed = _table(spark, f"{folder}/requests", REQUESTS, "day").groupBy("request_id").agg(F.count("*").alias("times"))
    asked = _table(spark, f"{folder}/answers", ANSWERS, "batch").groupBy("request_id").agg(F.count("*").alias("asked"), F.bool_or(F.col("error").isNull()).alias("answered"))
    known = filed.join(asked, "request_id", "left")
    settled = known.filter(F.coalesce("answered", F.lit(False)) | (F.col("times") > F.coalesce("asked", F.lit(0))))
    new = requests.dropDuplicates(["request_id"]).join(settled, "request_id", "left_anti").select("request_id", "day", "item_ids", "prompt").persist()
    n = new.count()
    new.write.mode("append").option("maxRecordsPerFile", 1).partitionBy("day").parquet(f"{folder}/requests")
    new.unpersist()
    return n


def answer_waiting(spark: SparkSession, folder: str, scorer: Callable[[str], str], *, at_once: int = 1, pause: float = 0.0) -> None:
    """Asks for all requests filed and not answered yet, ``at_once`` at a time; each task rests ``pause`` seconds after a call."""

    def one(rows: DataFrame, number: int) -> None:
        done = _table(spark, f"{folder}/answers", ANSWERS, "batch").filter(F.col("batch") == number).select("request_id")
        found = scoring.ask(rows.join(F.broadcast(done), "request_id", "left_anti").repartition(at_once), scorer, pause)  # at most as many as there are in a batch
        found.withColumn("batch", F.lit(number).cast("bigint")).write.mode("append").partitionBy("batch").parquet(f"{folder}/answers")

    waiting = spark.readStream.schema(REQUESTS).option("maxFilesPerTrigger", at_once).parquet(f"{folder}/requests")
    query = waiting.writeStream.foreachBatch(one).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
