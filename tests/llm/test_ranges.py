import bisect
import time

from pyspark.sql import Row
from pyspark.sql import functions as F

from tonelake.llm import ranges

ODD = ["", "a", 'q"', "back\\slash", "\n", "\t\x01", "é", "￿", "\U0001f600", "{}", "null"]


def test_buckets_are_those_of_a_binary_search(spark):
    rows = [(i, ODD[i % len(ODD)] * (1 + i % 3), 2**62 - i if i % 2 else -(2**63) + i) for i in range(200)]
    df = spark.createDataFrame(rows, "id bigint, t string, n bigint")
    key = F.struct("t", "n")
    splitters = ranges.sampled_splitters(df, key, F.col("id"), 30)
    assert 1 < len(splitters) < 30
    got = {r.id: r.b for r in df.select("id", ranges.bucket_of(key, splitters, df).alias("b")).collect()}
    at = [(s.t.encode(), s.n) for s in splitters]
    assert got == {i: bisect.bisect_right(at, (t.encode(), n)) for i, t, n in rows}


def test_no_splitters(spark):
    df = spark.createDataFrame([], "id bigint")
    assert ranges.sampled_splitters(df, F.struct("id"), F.col("id"), 8) == []
    assert ranges.bucket_of(F.struct("id"), [], spark.range(3)) is not None


def test_plan_stays_small_with_many_splitters(spark):
    df = spark.range(1000)
    splitters = [Row(id=i) for i in range(0, 40_000, 2)]
    began = time.perf_counter()
    assert df.select(F.max(ranges.bucket_of(F.struct("id"), splitters, df))).first()[0] == 500
    assert time.perf_counter() - began < 60


def test_weights_even_out_bytes(spark):
    df = spark.range(400).select("id", F.when(F.col("id") < 100, 191).otherwise(1).alias("w"))
    even = [r.id for r in ranges.sampled_splitters(df, F.struct("id"), F.col("id"), 10, F.col("w"))]
    assert len(even) == 9 and sum(i < 100 for i in even) == 9 and even == sorted(set(even))
    assert [r.id for r in ranges.sampled_splitters(df, F.struct("id"), F.col("id"), 10)] == list(range(40, 400, 40))


def test_keys_within_keys(spark):
    df = spark.range(400).select("id", F.struct((F.col("id") % 7).alias("a"), F.col("id").alias("b")).alias("place"))
    key = F.struct(F.lit("x").alias("lead"), "place")
    splitters = ranges.sampled_splitters(df, key, F.col("id"), 8)
    got = {r.id: r.b for r in df.select("id", ranges.bucket_of(key, splitters, df).alias("b")).collect()}
    order = sorted(range(400), key=lambda i: (i % 7, i))
    assert len(set(got.values())) == 8 and [got[i] for i in order] == sorted(got.values())


def test_few_heavy_rows_in_a_sample(spark):
    """One row in a hundred holds half of the weight: no range has more than twice its share."""
    df = spark.range(20_000).select("id", F.xxhash64("id").alias("k"), F.when(F.col("id") % 100 == 0, 99.0).otherwise(1.0).alias("w"))
    splitters = ranges.sampled_splitters(df, F.struct("k"), F.col("id"), 20, F.col("w"))
    sums = [r.w for r in df.groupBy(ranges.bucket_of(F.struct("k"), splitters, df).alias("b")).agg(F.sum("w").alias("w")).collect()]
    assert len(sums) == 20 and max(sums) < 2 * sum(sums) / 20
