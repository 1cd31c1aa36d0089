"""Range partitioning by sampled splitters, with the bucket of each row as a column.

Spark's own range exchange doesn't tell operators which range a row fell into, so work that follows the order across
rows of different keys would need a second exchange. Here the splitters are drawn first, every row's bucket comes from
a binary search among them, and one exchange takes each bucket to its own partition. The sort key ends in a
column that tells equal rows apart, so one value that fills a third of the table is split among many buckets.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

#: Sampled keys for each bucket: they only balance the buckets, any splitters give the same result.
SAMPLES_PER_BUCKET = 40
#: Bounds of the sample that reaches the driver and of the number of buckets.
MOST_SAMPLES, MOST_BUCKETS = 100_000, 20_000
#: Steps of the hash that draws the sample: fine enough for the smallest row of a very large table.
DRAWS = 2**40


def sampled_splitters(df: DataFrame, key: Column, row_id: Column, buckets: int, weight: Column | None = None) -> list:
    """At most ``buckets`` - 1 ascending keys that cut the table into even runs, by rows or by what ``weight`` says of them. ``key`` must be a struct of
    small columns."""
    buckets = min(buckets, MOST_BUCKETS)
    wanted = min(MOST_SAMPLES, SAMPLES_PER_BUCKET * buckets)
    drawn = df.select(row_id.alias("r"), key.alias("k"), (F.lit(1) if weight is None else weight).cast("double").alias("w"))
    rows, total = (df.count(),) * 2 if weight is None else drawn.agg(F.count("*"), F.coalesce(F.sum("w"), F.lit(0.0))).first()
    if buckets < 2 or rows < 2:
        return []
    if rows > wanted:
        # Heavy rows are drawn more often and count for less, else a few of them would stand for many bytes that aren't there.
        one = total / wanted
        drawn = drawn.filter(F.pmod(F.xxhash64("r", F.lit("splitters")), F.lit(DRAWS)) < F.col("w") * F.lit(DRAWS / one)).withColumn("w", F.greatest("w", F.lit(one)))
    sample = drawn.select("k", "w").orderBy("k").limit(2 * MOST_SAMPLES).collect()
    # The first key behind each share of the whole weight.
    ends = list(accumulate(r["w"] for r in sample))
    picked = [sample[min(bisect_right(ends, ends[-1] * i / buckets), len(sample) - 1)]["k"] for i in range(1, buckets)] if sample else []
    return [k for i, k in enumerate(picked) if i == 0 or k != picked[i - 1]]


def bucket_of(key: Column, splitters: list, df: DataFrame) -> Column:
    """How many splitters are at or below the key: a binary search, so a row costs the logarithm of their number.

    They stand in the plan as one text, which is read once, when the plan is optimised; as expressions of their own a thousand would take it half a minute."""
    if not splitters:
        return F.lit(0)
    kind = df.select(key.alias("k")).schema["k"].dataType
    literal = F.from_json(F.lit(json.dumps([s.asDict(recursive=True) for s in splitters])), ArrayType(kind))
    n = len(splitters)
    steps = [2**i for i in reversed(range(n.bit_length()))]

    def step(at: Column, width: Column) -> Column:
        return F.when((at + width <= n) & (F.get(literal, at + width - 1) <= key), at + width).otherwise(at)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step)
