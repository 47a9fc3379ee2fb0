"""Price bars, returns, realized volatility, labels and session dates
(J1-J6).

Definitions that are ours (the reference declares them in configs only):
* J3: realized volatility at date t = sample std of the last ``n`` log
  returns (t included) x sqrt(year); null until ``n`` returns exist.
* J4: the label at date t is the volatility ``horizon`` rows ahead.
* J5: an instant at or after the close (New York) belongs to the next day,
  and a day without a bar rolls forward to the next date that has one.

Scale: bars are a partial aggregate over ticks; every window runs on the
daily bar table (one row per ticker and day), not on ticks.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import session_day
from ..session import checked_broadcast, cut_lineage


def ohlc_bars(ticks: DataFrame, entity: str = "ticker", ts: str = "ts",
              value: str = "price", freq: str = "day", tie: str | None = None) -> DataFrame:
    """OHLC + tick count per entity and period (``day``, ``week``,
    ``month``). Open/close are the first/last tick by time, and by ``tie``
    (a unique column; default: the price) among ticks of one instant."""
    at = F.struct(ts, tie or value)
    period = F.date_trunc(freq, F.col(ts)).cast("date")
    return (ticks.groupBy(F.col(entity).alias("ticker"), period.alias("date"))
            .agg(F.min_by(value, at).alias("open"), F.max(value).alias("high"),
                 F.min(value).alias("low"), F.max_by(value, at).alias("close"),
                 F.count(F.lit(1)).alias("volume")))


def log_returns(bars: DataFrame, close: str = "close") -> DataFrame:
    """``ln(close / previous close)`` per ticker by date."""
    w = Window.partitionBy("ticker").orderBy("date")
    return bars.withColumn("log_ret", F.ln(F.col(close) / F.lag(close).over(w)))


def realized_vol(returns: DataFrame, n: int = 20, year: int = 252,
                 ret: str = "log_ret") -> DataFrame:
    """Rolling sample std of the last ``n`` returns x sqrt(year)."""
    w = Window.partitionBy("ticker").orderBy("date").rowsBetween(-(n - 1), 0)
    return returns.withColumn(
        "rv", F.when(F.count(ret).over(w) == n,
                     F.stddev_samp(ret).over(w) * F.lit(math.sqrt(year))))


def vol_label(rv: DataFrame, horizon: int = 1, name: str = "rv_1d") -> DataFrame:
    """The volatility ``horizon`` rows ahead, per ticker."""
    w = Window.partitionBy("ticker").orderBy("date")
    return rv.withColumn(name, F.lead("rv", horizon).over(w))


def session_dates(df: DataFrame, bars: DataFrame, ts: str = "ts",
                  entity: str = "ticker", zone: str = "America/New_York",
                  close_hour: int = 16) -> DataFrame:
    """Adds ``session_day`` and ``trade_date`` (the first bar date at or
    after the session day for the row's entity; null past the last bar).

    The as-of table has a row for every day from an entity's first bar to its
    last, made from the bars alone; it is broadcast after a check. Days
    before the first bar count to the first bar.
    """
    rows = df.withColumn("session_day", session_day(F.col(ts), zone, close_hour))
    cal = bars.select(F.col("ticker").alias("__t"), F.col("date").alias("__bar")).distinct()
    w = Window.partitionBy("__t").orderBy("__bar")
    # the days after the bar before, up to this one
    since = F.coalesce(F.date_add(F.lag("__bar").over(w), 1), F.col("__bar"))
    asof = cut_lineage(cal.withColumn("__since", since).withColumn("__first", F.min("__bar").over(Window.partitionBy("__t")))
                       .select("__t", "__bar", "__first", F.explode(F.sequence("__since", "__bar")).alias("__day")))
    firsts = asof.select(F.col("__t").alias("__ft"), F.col("__first").alias("__fd")).distinct()
    small, _ = checked_broadcast(asof.drop("__first"))
    few, _ = checked_broadcast(firsts)
    asof = small if small is not None else asof.drop("__first")
    firsts = few if few is not None else firsts
    j = rows.join(firsts, F.col(entity) == F.col("__ft"), "left")
    j = j.join(asof, (F.col(entity) == F.col("__t")) & (F.col("session_day") == F.col("__day")), "left")
    to = F.coalesce("__bar", F.when(F.col("session_day") < F.col("__fd"), F.col("__fd")))
    return j.withColumn("trade_date", to).drop("__t", "__bar", "__day", "__ft", "__fd")


def daily_spine(daily: DataFrame, key: str = "ticker", date_col: str = "date",
                fill_zero: list[str] | None = None) -> DataFrame:
    """One row per key and calendar day between the key's first and last
    day; counters in ``fill_zero`` become 0, other values stay null."""
    span = daily.groupBy(key).agg(F.min(date_col).alias("lo"), F.max(date_col).alias("hi"))
    spine = span.select(key, F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 DAY")))
                        .alias(date_col))
    out = spine.join(daily, [key, date_col], "left")
    for c in fill_zero or []:
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(0)))
    return out
