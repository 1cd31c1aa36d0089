"""Daily tone indices of every level and method, and of the weighted composite, next to the market's return on the session that each day falls to.

    python -m jobs.tone_index --tables PATH --output PATH [--config jobs/tone_index.json]

``tables`` holds ``documents``, ``labels`` and ``lineitem``, from which items, scores and prices follow, or these three themselves as ``items``, ``scores`` and ``prices``
(setting ``layout``). The output is partitioned by method and level. A run replaces the partitions of the methods and levels that it is set to, from the whole tables, and
leaves others: running it again gives the same. A level without a scored item has no partition.
"""

from __future__ import annotations

import argparse
import logging
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.settings import load, log_to_console
from tonelake.operators import market, toneindex
from tonelake.schemas import LEVELS, METHODS
from tonelake.session import build_session, release, stored
from tonelake.sources import synthetic
from tonelake.sources import tables as store

LOG = logging.getLogger("jobs.tone_index")
INDEX = "day string, index_value double, n_items bigint, n_channels bigint, breadth double, session date, market_return double, n_tickers bigint, method string, level string"


@dataclass(frozen=True)
class Settings:
    #: ``documents`` (the test tables) or ``items`` (the engine's own tables).
    layout: str = "documents"
    methods: list[str] = field(default_factory=lambda: list(METHODS))
    levels: list[str] = field(default_factory=lambda: list(LEVELS))
    #: Weights of levels in the composite, which is left out where there are none.
    weights: dict[str, float] = field(default_factory=lambda: {"macro": 0.4, "market": 0.3, "stock": 0.2})
    shrink_k: float = toneindex.SHRINK_K
    include_recap: bool = False
    min_coverage: float = market.MIN_COVERAGE


def read(spark: SparkSession, tables: str, layout: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    if layout == "documents":
        return synthetic.items(spark, tables), synthetic.scores(spark, tables), synthetic.prices(spark, tables)
    return store.read_items(spark, f"{tables}/items"), store.read_scores(spark, f"{tables}/scores"), store.read_prices(spark, f"{tables}/prices")


def indices(items: DataFrame, scores: DataFrame, settings: Settings) -> DataFrame:
    """All indices in one frame: each method is one aggregation by day and level."""
    options = {"shrink_k": settings.shrink_k, "include_recap": settings.include_recap}
    shown = ["day", "index_value", "n_items", "n_channels", "breadth", "method", "level"]
    parts = []
    for method in settings.methods:
        of_levels = toneindex.level_indices(items, scores, method=method, **options).filter(F.col("level").isin(*settings.levels))
        parts.append(of_levels.withColumn("method", F.lit(method)).select(shown))
        if settings.weights:
            blend = toneindex.weighted_composite(items, scores, settings.weights, method=method, **options)
            absent = {"n_channels": F.lit(None).cast("bigint"), "breadth": F.lit(None).cast("double"), "method": F.lit(method), "level": F.lit("composite")}
            parts.append(blend.withColumns(absent).select(shown))
    return reduce(DataFrame.unionByName, parts)


def run(spark: SparkSession, tables: str, output: str, settings: Settings = Settings()) -> int:
    """Writes the indices and says how many rows these are."""
    for given, allowed in ((settings.methods, METHODS), ([*settings.levels, *settings.weights], LEVELS)):
        if unknown := set(given) - set(allowed):
            raise ValueError(f"unknown: {sorted(unknown)}")
    items, scores, prices = read(spark, tables, settings.layout)
    LOG.info("reading %s: %d items, %d scores", tables, items.count(), scores.count())
    prices = stored(prices, "prices")  # read by the calendar and the proxy
    days = stored(indices(items, scores, settings).withColumn("date", F.to_date("day")), "indices")
    rolled = market.next_trading_day(days, prices, "date").drop("date")
    proxy = market.market_proxy(prices, settings.min_coverage).select(F.col("date").alias("session"), "market_return", "n_tickers")
    # One row a day and level: small, and dealt to one file for each partition.
    found = rolled.join(proxy, "session", "left").select(*spark.createDataFrame([], INDEX).columns).repartition("method", "level")
    found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("method", "level").parquet(output)
    written = result(spark, output).filter(F.col("method").isin(*settings.methods)).groupBy("method", "level").agg(F.count("*").alias("n")).orderBy("method", "level").collect()
    for r in written:  # a row for each method and level
        LOG.info("%s/%s: %d days in %s", r["method"], r["level"], r["n"], output)
    return sum(r["n"] for r in written)


def result(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(output)


def main(argv: Sequence[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="jobs.tone_index", description=__doc__)
    for name in ("tables", "output"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--config")
    a = p.parse_args(argv)
    log_to_console()
    spark = build_session("tone_index")
    try:
        run(spark, a.tables, a.output, load(Settings, a.config))
    finally:
        release(spark)
        spark.stop()


if __name__ == "__main__":
    main()
