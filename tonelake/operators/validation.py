"""Holding an index against the market: correlation, lead and lag, robust regression, event study."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonelake.functions.stats import SMALL_SAMPLE, correlation, error_bar, fisher_interval, hac_regression, t_probability, t_statistic
from tonelake.operators.market import market_proxy, next_trading_day, session_returns, trading_calendar

EVENT_KEY = ("chat_id", "message_id", "rubric_version")
LAGS, WINDOW, HORIZONS = (-5, 5), (-5, 10), (0, 1, 3, 5, 10)


def index_series(index: DataFrame) -> DataFrame:
    """(date, index_value) of a daily index."""
    return index.select(F.to_date("day").alias("date"), "index_value")


def contemporaneous(without_recap: DataFrame, with_recap: DataFrame, proxy: DataFrame) -> DataFrame:
    """(include_recap, n, corr, small_sample, drop, recap_driven): correlation on the same day with and without recaps, and whether leaving
    them out takes away more than 0.15 of it."""
    both = index_series(without_recap).withColumn("include_recap", F.lit(False)).unionByName(index_series(with_recap).withColumn("include_recap", F.lit(True)))
    joined = both.join(proxy.select("date", "market_return"), "date").filter(F.col("index_value").isNotNull())
    rows = joined.groupBy("include_recap").agg(F.count("*").alias("n"), correlation(F.col("index_value"), F.col("market_return")).alias("corr"))
    each = [F.max(F.when(F.col("include_recap") == flag, F.abs("corr"))) for flag in (True, False)]
    drop = rows.agg((each[0] - each[1]).alias("drop"))
    out = rows.crossJoin(drop)  # one row
    return out.select("include_recap", "n", "corr", (F.col("n") < SMALL_SAMPLE).alias("small_sample"), "drop", F.coalesce(F.col("drop") > 0.15, F.lit(False)).alias("recap_driven"))


def numbered(proxy: DataFrame) -> DataFrame:
    """(date, pos, market_return): proxy rows numbered; shifts count these, not calendar sessions."""
    return proxy.select("date", "market_return", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("date")).alias("pos"))


def lead_lag(index: DataFrame, proxy: DataFrame, lags: tuple[int, int] = LAGS) -> DataFrame:
    """(k, corr, n, ci_lo, ci_hi, err_plus, err_minus): index of day t against the return k proxy rows later, for each k."""
    rows = numbered(proxy)
    later = rows.select(F.col("pos").alias("to"), F.col("market_return").alias("later"))
    every = F.explode(F.sequence(F.lit(lags[0]), F.lit(lags[1])))
    moved = rows.select("date", F.col("pos"), every.alias("k")).withColumn("to", F.col("pos") + F.col("k")).join(later, "to")
    pairs = moved.join(index_series(index), "date").filter(F.col("index_value").isNotNull())
    found = pairs.groupBy("k").agg(F.count("*").alias("n"), correlation(F.col("index_value"), F.col("later")).alias("r"))
    ks = proxy.sparkSession.range(lags[0], lags[1] + 1).select(F.col("id").cast("int").alias("k"))
    out = ks.join(found, "k", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "corr": F.when(F.col("n") >= 3, F.col("r"))})
    lo, hi = fisher_interval(F.col("corr"), F.col("n"))
    out = out.withColumns({"ci_lo": lo, "ci_hi": hi})
    return out.select("k", "corr", "n", "ci_lo", "ci_hi", error_bar(F.col("ci_hi"), F.col("corr")).alias("err_plus"), error_bar(F.col("corr"), F.col("ci_lo")).alias("err_minus"))


def next_return_regression(index: DataFrame, proxy: DataFrame, lags: int = 5) -> DataFrame:
    """Regression of the next return on the index and the present return, with Newey-West errors."""
    rows = numbered(proxy)
    following = rows.select((F.col("pos") - 1).alias("pos"), F.col("market_return").alias("return_next"))
    joined = rows.join(following, "pos").join(index_series(index), "date")
    return hac_regression(joined.select("date", "return_next", F.col("index_value").alias("index_t"), F.col("market_return").alias("return_t")), "return_next", ["index_t", "return_t"], "date", lags)


def event_paths(events: DataFrame, prices: DataFrame, proxy: DataFrame | None = None, window: tuple[int, int] = WINDOW) -> DataFrame:
    """(event columns, t0, k, car): cumulative return above the market from the window's first session to the k-th after the event.

    Events are rolled to the next session. Tickers without any price and events after the last session are left out; missing
    returns, also beyond the calendar, add nothing, and the sum goes on."""
    sessions = trading_calendar(prices)
    market = (market_proxy(prices) if proxy is None else proxy).select("date", "market_return")
    known = events.join(prices.select("ticker").distinct(), "ticker", "left_semi")
    rolled = next_trading_day(known, prices, "event_date").filter(F.col("session").isNotNull())
    placed = rolled.join(sessions.select(F.col("date").alias("session"), F.col("pos").alias("t0_pos")), "session")
    steps = placed.withColumn("k", F.explode(F.sequence(F.lit(window[0]), F.lit(window[1])))).withColumn("pos", F.col("t0_pos") + F.col("k"))
    above = session_returns(prices, sessions).join(market, "date").select("ticker", "pos", (F.col("ret") - F.col("market_return")).alias("above"))
    joined = steps.join(above, ["ticker", "pos"], "left")
    running = Window.partitionBy(*EVENT_KEY).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return joined.select(*events.columns, F.col("session").alias("t0"), "k", F.sum(F.coalesce("above", F.lit(0.0))).over(running).alias("car"))


def event_summary(paths: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """(direction, k, n, mean_car, t, p, small_sample) at the horizons, for groups of two or more."""
    rows = paths.filter(F.col("k").isin(*horizons)).groupBy("direction", "k")
    out = rows.agg(F.count("car").alias("n"), F.avg("car").alias("mean_car"), F.stddev_samp("car").alias("dev")).filter("n >= 2")
    out = out.withColumn("t", t_statistic(F.col("mean_car"), F.col("dev"), F.col("n")))
    return out.select("direction", "k", "n", "mean_car", "t", t_probability(F.col("t"), (F.col("n") - 1).cast("double")).alias("p"), (F.col("n") < SMALL_SAMPLE).alias("small_sample"))


def mean_paths(paths: DataFrame) -> DataFrame:
    """(direction, k, mean_car, n) over the whole window."""
    return paths.groupBy("direction", "k").agg(F.avg("car").alias("mean_car"), F.count("car").alias("n"))


def events_without_prices(events: DataFrame, prices: DataFrame) -> DataFrame:
    """How many events name a ticker that has no price."""
    return events.join(prices.select("ticker").distinct(), "ticker", "left_anti").agg(F.count("*").alias("skipped"))


def clipped(rows: DataFrame, index: DataFrame) -> DataFrame:
    """Market rows within the index's first and last day."""
    bounds = index_series(index).agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    return rows.crossJoin(F.broadcast(bounds)).filter(F.col("date").between(F.col("lo"), F.col("hi"))).drop("lo", "hi")  # one row


def ewma(series: DataFrame, order: str, value: str, span: int) -> DataFrame:
    """``series`` with ``ewma``: exponentially weighted mean with adjusted weights; a null value still lets weights decay.

    One pass over one daily series."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order)
        return pd.DataFrame({order: frame[order], "ewma": frame[value].astype(float).ewm(span=span, adjust=True, ignore_na=False).mean()})

    kind = dict(series.dtypes)[order]
    return series.join(series.select(order, value).groupBy().applyInPandas(run, f"`{order}` {kind}, ewma double"), order)


def compounded(proxy: DataFrame) -> DataFrame:
    """Proxy rows with ``level``: the product of 1 + return so far, zero from a total loss on."""
    so_far = Window.partitionBy(F.lit(0)).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    r = F.col("market_return")
    logs = F.sum(F.log(F.when(r != -1, F.abs(1 + r)))).over(so_far)
    signs = F.sum(F.when(r < -1, 1).otherwise(0)).over(so_far)
    lost = F.max((r == -1).cast("int")).over(so_far)
    return proxy.withColumn("level", F.when(lost == 1, 0.0).otherwise(F.exp(F.coalesce(logs, F.lit(0.0))) * F.when(signs % 2 == 1, -1.0).otherwise(1.0)))


def index_against_market(index: DataFrame, proxy: DataFrame, span: int = 9) -> DataFrame:
    """(date, index_value, ewma, n_items, market_level): the chart of both, on all days of either."""
    smooth = ewma(index.select(F.to_date("day").alias("date"), "index_value", "n_items"), "date", "index_value", span)
    level = compounded(clipped(proxy, index)).select("date", F.col("level").alias("market_level"))
    return smooth.join(level, "date", "full").select("date", "index_value", "ewma", "n_items", "market_level")
