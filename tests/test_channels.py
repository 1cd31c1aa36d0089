import glob
import json
import os

import pytest
from fake_channels import PLACE, connect
from pyspark.sql import functions as F

from tonelake.schemas import ITEM_KEY, ITEMS, conform
from tonelake.sources import channels, tables
from tonelake.streaming.incremental import collect_into


def message(chat, n, day):
    return [chat, f"c{chat}", n, f"{day}T00:00:00+00:00", f"text {n}", False, False, None, None]


@pytest.fixture
def feed(spark, tmp_path):
    """Puts messages where the client finds them."""
    folder = str(tmp_path / "feed")
    os.mkdir(folder)
    with open(PLACE, "w") as f:
        f.write(folder)

    def put(rows):
        with open(os.path.join(folder, "messages.json"), "w") as f:
            json.dump(rows, f)

    spark.dataSource.register(channels.channel_messages(connect))
    put.folder = folder
    return put


def collect(spark, tmp_path, names, **options):
    stream = spark.readStream.format("channel_messages").options(channels=names, today="2024-03-31", **options).load()
    collect_into(stream, str(tmp_path / "items"), str(tmp_path / "checkpoint")).awaitTermination()
    return sorted((r.chat_id, r.message_id) for r in spark.read.parquet(str(tmp_path / "items")).collect())


def test_each_message_once_through_failures_and_new_channels(spark, tmp_path, feed):
    old = [message(1, 1, "2024-01-01"), message(1, 2, "2024-03-10"), message(1, 3, "2024-03-11"), message(2, 7, "2024-02-29"), message(2, 8, "2024-03-01")]
    feed(old)
    # Channels without a mark go back 30 days.
    assert collect(spark, tmp_path, "1,2") == [(1, 2), (1, 3), (2, 8)]
    assert collect(spark, tmp_path, "1,2") == [(1, 2), (1, 3), (2, 8)]
    feed([*old, message(1, 4, "2024-03-12"), message(2, 9, "2024-03-12")])
    down = os.path.join(feed.folder, "down")
    open(down, "w").close()
    with pytest.raises(Exception, match="no connection"):
        collect(spark, tmp_path, "1,2")
    os.remove(down)
    feed([*old, message(1, 4, "2024-03-12"), message(2, 9, "2024-03-12"), message(1, 5, "2024-03-13"), message(3, 1, "2023-01-01"), message(3, 2, "2024-03-20")])
    # The batch that failed comes first, as it was planned; what came after it follows at the latest with the next run.
    assert set(collect(spark, tmp_path, "1,2,3")) >= {(1, 2), (1, 3), (1, 4), (2, 8), (2, 9)}
    assert collect(spark, tmp_path, "1,2,3") == [(1, 2), (1, 3), (1, 4), (1, 5), (2, 8), (2, 9), (3, 2)]
    assert collect(spark, tmp_path, "1,2,3") == [(1, 2), (1, 3), (1, 4), (1, 5), (2, 8), (2, 9), (3, 2)]


def test_marks_of_a_table_are_where_the_stream_begins(spark, tmp_path, feed):
    feed([message(1, n, "2024-03-20") for n in range(1, 7)] + [message(2, 1, "2024-03-20")])
    have = conform(spark.createDataFrame([(1, 3), (1, 4)], "chat_id bigint, message_id bigint"), ITEMS)
    marks = json.dumps({str(r.chat_id): r.last_id for r in tables.high_water_marks(have).collect()})
    assert collect(spark, tmp_path, "1,2", marks=marks) == [(1, 5), (1, 6), (2, 1)]


def test_an_upsert_of_one_day_rewrites_one_partition(spark, tmp_path):
    path = str(tmp_path / "table")
    kind = "chat_id bigint, message_id bigint, text string, summary string, day string"
    spark.createDataFrame([(1, n, f"t{n}", f"s{n}", f"2024-01-0{1 + n % 3}") for n in range(12)], kind).write.partitionBy("day").parquet(path)

    def files():
        return {d: sorted(glob.glob(f"{path}/day={d}/*.parquet")) for d in ("2024-01-01", "2024-01-02", "2024-01-03", "2024-01-04")}

    before = files()
    changes = spark.createDataFrame([(1, 3, "new", "2024-01-01"), (1, 99, "added", "2024-01-01"), (1, 3, "older", "2024-01-01")], "chat_id bigint, message_id bigint, text string, day string")
    tables.upsert_partitions(path, kind, changes, ITEM_KEY, "day", order=F.col("text") == "new")
    after = files()
    assert after["2024-01-01"] != before["2024-01-01"] and all(after[d] == before[d] for d in before if d != "2024-01-01")
    rows = {r.message_id: (r.text, r.summary, r.day) for r in spark.read.schema(kind).parquet(path).collect()}
    assert len(rows) == 13 and rows[3] == ("new", "s3", "2024-01-01") and rows[99] == ("added", None, "2024-01-01") and rows[4] == ("t4", "s4", "2024-01-02")
    tables.upsert_partitions(path, kind, changes.filter("message_id = 99").withColumn("day", F.lit("2024-01-04")), ITEM_KEY, "day")
    assert len(files()["2024-01-04"]) > 0 and spark.read.schema(kind).parquet(path).count() == 14
