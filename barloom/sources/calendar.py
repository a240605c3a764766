"""Trading calendar. One row per day, so every window and sort here is bounded by the number of days."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def _days(start: Column, end: Column) -> Column:
    return F.explode(F.sequence(start, end)).alias("date")


def _weekday(d: Column | str) -> Column:
    return F.weekday(d) < 5


def weekdays(spark: SparkSession, start: str, end: str, holidays: DataFrame | None = None) -> DataFrame:
    """Trading days between two dates (weekdays without holidays) with their number `trade_seq`."""
    span = spark.range(1).select(_days(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return numbered(span.where(_weekday("date")), holidays)


def weekdays_of(df: DataFrame, holidays: DataFrame | None = None, column: str = "date") -> DataFrame:
    """The weekday calendar that spans the dates of a frame."""
    ends = df.agg(F.min(column).alias("a"), F.max(column).alias("b"))
    span = ends.select(_days(F.col("a"), F.col("b")))
    return numbered(span.where(_weekday("date")), holidays)


def market_days(df: DataFrame, column: str = "date") -> DataFrame:
    """The days that occur in the data, numbered."""
    return numbered(df.select(F.col(column).alias("date")).distinct())


def numbered(days: DataFrame, holidays: DataFrame | None = None) -> DataFrame:
    if holidays is not None:
        days = days.join(holidays.select("date"), "date", "left_anti")
    return days.select(
        "date", F.row_number().over(Window.orderBy("date")).cast("bigint").alias("trade_seq"))


def beside(days: DataFrame) -> DataFrame:
    """A frame keyed by day, marked for broadcast. Unique days are bounded by the date type itself
    (3.7 million, some 60 MB), and by a few thousand in any real calendar; so joining rows to their
    day never shuffles the rows, and a day with very many rows is no hot key."""
    return F.broadcast(days)


def latest_day(calendar: DataFrame, as_of: str) -> DataFrame:
    """The newest trading day not after `as_of`."""
    return calendar.where(F.col("date") <= F.lit(as_of).cast("date")).agg(F.max("date").alias("date"))


def day_lookup(calendar: DataFrame, lookback: int = 5) -> DataFrame:
    """For every calendar day: latest trading day up to it, next one after it, and the one
    `lookback` trading days before the latest."""
    ends = calendar.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    every = ends.select(_days(F.col("a"), F.col("b"))).join(
        calendar.withColumn("trading", F.col("date")), "date", "left")
    up = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.orderBy("date").rowsBetween(1, Window.unboundedFollowing)
    marked = every.select(
        "date",
        F.last("trading", ignorenulls=True).over(up).alias("latest_trading"),
        F.first("trading", ignorenulls=True).over(after).alias("next_trading"),
        F.last("trade_seq", ignorenulls=True).over(up).alias("_seq"))
    back = calendar.select(F.col("date").alias("trading_n_ago"),
                           (F.col("trade_seq") + F.lit(lookback)).alias("_seq"))
    return marked.join(back, "_seq", "left").select(
        "date", "latest_trading", "next_trading", "trading_n_ago")


def default_range(calendar: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """First and last of the newest `days` trading days not after `as_of` (one row)."""
    return (calendar.where(F.col("date") <= F.lit(as_of).cast("date"))
            .orderBy(F.desc("date")).limit(days)
            .agg(F.min("date").alias("start_date"), F.max("date").alias("end_date"),
                 F.count(F.lit(1)).alias("trading_days")))


def session_hours(session: str) -> tuple[int, int]:
    """First open and last close, in minutes of the day, of a text like 09:31-11:30,13:01-15:00."""
    opens, closes = [], []
    for part in session.split(","):
        a, _, b = part.strip().partition("-")
        try:
            (ah, am), (bh, bm) = (x.split(":") for x in (a, b))
            opens.append(int(ah) * 60 + int(am))
            closes.append(int(bh) * 60 + int(bm))
        except ValueError:
            continue
    if not opens:
        raise ValueError(f"no trading hours in {session!r}")
    return min(opens), max(closes)


def bar_is_final(ts: Column | str, session: str = "09:31-11:30,13:01-15:00",
                 settle_hours: int = 3) -> Column:
    """True once the day's bar is settled: the given hours after the last close."""
    _, close = session_hours(session)
    minute = F.hour(ts) * 60 + F.minute(ts)
    return minute >= F.lit(close + 60 * settle_hours)


def completed_day(df: DataFrame, ts: str, calendar: DataFrame, session: str = "09:31-11:30,13:01-15:00",
                  settle_hours: int = 3) -> DataFrame:
    """For each row the newest trading day whose bar was final at that time: its own day when that
    is a settled trading day, otherwise the trading day before it."""
    look = day_lookup(calendar, 1).select("date", "latest_trading", F.col("trading_n_ago").alias("_prev"))
    own = F.col("latest_trading") == F.col("date")
    day = F.when(~own, F.col("latest_trading")).when(
        bar_is_final(ts, session, settle_hours), F.col("date")).otherwise(F.col("_prev"))
    out = df.withColumn("date", F.to_date(ts)).join(beside(look), "date", "left")
    return out.withColumn("completed_day", day).drop("latest_trading", "_prev")


def read_trading_dates(spark: SparkSession, path: str, start: str | None = None,
                       end: str | None = None, lines: bool = False) -> DataFrame:
    """JSON files with a list of dates each, or with `lines` one list a line -> numbered calendar."""
    text = spark.read.text(path, wholetext=not lines)
    days = text.select(F.explode(F.from_json("value", "array<string>")).alias("d"))
    days = days.select(F.to_date("d", "yyyy-MM-dd").alias("date")).where(F.col("date").isNotNull()).distinct()
    if start:
        days = days.where(F.col("date") >= F.lit(start).cast("date"))
    if end:
        days = days.where(F.col("date") <= F.lit(end).cast("date"))
    return numbered(days)
