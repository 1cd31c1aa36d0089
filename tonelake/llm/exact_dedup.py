"""Exact deduplication by content sort, in DataFrame operations alone.

Sampled splitters cut the order (leading bytes, SHA-256, id) into even ranges; one exchange takes each row with its
text to its range, where Spark's external sort places equal texts side by side. A row is then compared in full with the
row before it. A run of equals that crosses ranges is put together from one small row for each range, so neither a
second exchange of texts nor a task with all copies of one text is needed.

Defined results: null text counts as empty, so null and empty are copies of each other. ``keep`` chooses the largest
or smallest id of a group. Rows that share both text and id (repeated rows) all count in the group's size and all but one
of them are dropped. Rows without an id sort last and stay only if no other row of the group has one. Other columns, also
those with names used here, pass through untouched. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, stored
from .ranges import bucket_of, sampled_splitters

#: Leading characters in the sort key; the SHA-256 behind them keeps equal texts together, whatever their length, and no text of another content comes between
#: them. So texts are in the order of their leading characters, and those that share them in the order of the digest.
LEAD = 24
#: Bytes that a row counts besides its text.
ROW_BYTES = 100


def exact_groups(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", normalise: Column | None = None, keep: str = "largest", buckets: int | None = None, carry: bool = False) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) for every row. ``carry`` adds ``row``, a struct of all input columns, and
    leaves out rows already known to be dropped.

    ``normalise`` is an expression over ``text`` that gives the string whose bytes are compared (the text itself)."""
    spark = df.sparkSession
    rows = df.select(df[id_col].alias("id"), F.coalesce(df[text_col], F.lit("")).alias("text"), *([F.struct(*[df[c] for c in df.columns]).alias("row")] if carry else []))
    if normalise is not None:
        rows = rows.withColumn("text", F.coalesce(normalise, F.lit("")))
    # Ids ascend in the order that puts the row to be kept first; a missing id comes last.
    whole = F.col("id").cast("bigint")
    place = F.coalesce(F.bitwise_not(whole) if keep == "largest" else whole, F.lit(2**63 - 1))
    rows = rows.withColumn("lead", F.substring("text", 1, LEAD)).withColumn("sha", F.sha2("text", 256)).withColumn("place", place)
    key = F.struct("lead", "sha", "place")
    n = buckets or shuffle_partitions(spark)
    # Ranges are even in bytes: copies of a long text stand side by side and would be many bytes for few rows.
    splitters = sampled_splitters(rows, key, F.col("id"), n, F.octet_length("text") + ROW_BYTES)
    dealt = rows.withColumn("bucket", bucket_of(key, splitters, rows)).repartitionById(len(splitters) + 1, F.col("bucket"))
    order = Window.partitionBy("bucket").orderBy("lead", "sha", "text", "place")
    fresh = F.coalesce(F.col("text") != F.lag("text").over(order), F.lit(True))
    marked = dealt.withColumn("fresh", fresh)
    slim = marked.select("bucket", "lead", "sha", "text", "place", "id", "fresh", *(["row"] if carry else []))
    nth = F.sum(F.col("fresh").cast("bigint")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    runs = slim.withColumn("run", nth).withColumn("first", F.row_number().over(order)).drop("text", "lead")
    in_run = Window.partitionBy("bucket", "run")
    runs = runs.withColumn("size", F.count("*").over(in_run)).withColumn("head", F.min(F.struct("first", "id")).over(in_run))
    # Written once (without texts, unless rows are carried): the ends of the ranges and the rows both come from it.
    return _joined(stored(runs.filter("fresh") if carry else runs, "exact"), id_col, carry)


def _joined(runs: DataFrame, id_col: str, carry: bool) -> DataFrame:
    """Runs that go on in the next ranges are given the id and the size of the whole."""
    # One row for each range: what its first and its last run are.
    edge = F.struct("run", "sha", "size", F.col("head.id").alias("id"))
    edges = runs.groupBy("bucket").agg(F.min(edge).alias("a"), F.max(edge).alias("z"))
    everything = Window.partitionBy(F.lit(0)).orderBy("bucket")
    joins = F.coalesce(F.lag("z.sha").over(everything) == F.col("a.sha"), F.lit(False))
    edges = edges.withColumn("joins", joins).withColumn("single", F.col("a.run") == F.col("z.run"))
    # A chain begins with a range's last run and goes on through first runs that join it.
    opens = (~F.col("single")) | (~F.col("joins"))
    chain_out = F.sum(opens.cast("bigint")).over(everything)  # the chain of the last run
    edges = edges.withColumn("out", chain_out)
    chain_in = F.when(F.col("joins"), F.lag("out").over(everything))
    edges = edges.withColumn("into", chain_in)
    last = edges.select(F.col("out").alias("chain"), F.col("z.size").alias("size"), F.col("z.id").alias("id"), "bucket", F.col("single"), F.col("joins"))
    parts = last.select("chain", "size", "id", "bucket").unionByName(
        edges.filter("joins and not single").select(F.col("into").alias("chain"), F.col("a.size").alias("size"), F.col("a.id").alias("id"), "bucket")
    )
    chains = parts.groupBy("chain").agg(F.sum("size").alias("whole"), F.min(F.struct("bucket", "id")).alias("lead_part"))
    total = F.col("whole"), F.col("lead_part.id")
    firsts = edges.filter("joins").select("bucket", F.col("a.run").alias("run"), F.col("into").alias("chain"))
    lasts = edges.filter("not (single and joins)").select("bucket", F.col("z.run").alias("run"), F.col("out").alias("chain"))
    fixes = firsts.unionByName(lasts).join(chains, "chain").select("bucket", "run", total[0].alias("whole"), total[1].alias("lead_id"), F.lit(True).alias("fixed"), (F.col("lead_part.bucket") != F.col("bucket")).alias("goes_on"))
    # At most two rows for each range, and ranges are at most MOST_BUCKETS: small enough to send everywhere.
    out = runs.join(F.broadcast(fixes), ["bucket", "run"], "left")
    fixed = F.coalesce(F.col("fixed"), F.lit(False))
    kept = F.col("fresh") & ~F.coalesce(F.col("goes_on"), F.lit(False))
    return out.select(
        F.col("id").alias(id_col),
        F.when(fixed, F.col("lead_id")).otherwise(F.col("head.id")).alias("keep_id"),
        F.when(fixed, F.col("whole")).otherwise(F.col("size")).alias("group_size"),
        kept.alias("kept"),
        F.col("sha").alias("text_sha256"),
        *(["row"] if carry else []),
    )


def deduplicate(df: DataFrame, **options) -> DataFrame:
    """The input's rows that stay, with the input's columns."""
    groups = exact_groups(df, carry=True, **options)
    return groups.filter("kept").select(*[F.col("row")[c].alias(c) for c in df.columns])
