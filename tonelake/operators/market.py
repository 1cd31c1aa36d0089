"""Prices: trading calendar, returns over sessions, an equal-weighted market proxy, and rolling dates to sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MIN_COVERAGE = 0.95


def trading_calendar(prices: DataFrame) -> DataFrame:
    """(date, pos): sessions, numbered from 0. One row a day, so one task numbers them."""
    days = prices.select("date").distinct()
    return days.select("date", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("date")) - 1).alias("pos"))


def next_trading_day(dates: DataFrame, prices: DataFrame, column: str) -> DataFrame:
    """``dates`` with ``session``: the first session on or after ``column``, null beyond the last one.

    Dates are looked up, not rows: the distinct dates meet the calendar in one pass over their union, and the result is joined back."""
    wanted = dates.select(F.col(column).alias("date")).distinct()
    calendar = prices.select("date").distinct().withColumn("session", F.col("date"))
    both = wanted.withColumn("session", F.lit(None).cast("date")).unionByName(calendar)
    coming = Window.partitionBy(F.lit(0)).orderBy("date").rangeBetween(0, Window.unboundedFollowing)
    rolled = both.withColumn("next", F.min("session").over(coming)).filter("session is null").select(F.col("date").alias("__asked"), F.col("next").alias("session")).distinct()
    return dates.join(rolled, dates[column] == F.col("__asked"), "left").drop("__asked")


def session_returns(prices: DataFrame, calendar: DataFrame | None = None) -> DataFrame:
    """(date, pos, ticker, close, ret): return on the previous session; null if the ticker has no price there or it was 0."""
    sessions = trading_calendar(prices) if calendar is None else calendar
    placed = prices.join(sessions, "date")
    one = Window.partitionBy("ticker").orderBy("pos")
    before = F.when(F.lag("pos").over(one) == F.col("pos") - 1, F.lag("close").over(one))
    return placed.withColumn("ret", F.try_divide(F.col("close"), before) - 1).select("date", "pos", "ticker", "close", "ret")


def eligible_tickers(prices: DataFrame, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """Tickers with a price on enough of the sessions."""
    sessions = prices.select(F.countDistinct("date").alias("n_sessions"))
    counts = prices.groupBy("ticker").agg(F.count("close").alias("n"))
    return counts.crossJoin(F.broadcast(sessions)).filter(F.col("n") / F.col("n_sessions") >= min_coverage).select("ticker")  # one row


def market_proxy(prices: DataFrame, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """(date, market_return, cross_sectional_vol, n_tickers) for each session with a return."""
    calendar = trading_calendar(prices)
    kept = prices.join(eligible_tickers(prices, min_coverage), "ticker", "left_semi")
    returns = session_returns(kept, calendar)
    out = returns.groupBy("date").agg(F.avg("ret").alias("market_return"), F.stddev_samp("ret").alias("cross_sectional_vol"), F.count("ret").alias("n_tickers"))
    return out.filter(F.col("market_return").isNotNull())


def proxy_summary(prices: DataFrame, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """One row: proxy days, tickers on the last one, first and last session, sessions."""
    proxy = market_proxy(prices, min_coverage).agg(F.count("*").alias("proxy_days"), F.max_by("n_tickers", "date").alias("last_tickers"))
    calendar = prices.agg(F.min("date").alias("first_session"), F.max("date").alias("last_session"), F.countDistinct("date").alias("n_sessions"))
    return proxy.crossJoin(calendar)  # one row each


def last_rows(proxy: DataFrame, n: int = 10) -> DataFrame:
    """The last rows by date, in order."""
    return proxy.orderBy(F.desc("date")).limit(n).orderBy("date")


def duplicate_prices(prices: DataFrame) -> DataFrame:
    """(date, ticker) with more than one price, which the other functions assume away."""
    return prices.groupBy("date", "ticker").agg(F.count("*").alias("n")).filter("n > 1")
