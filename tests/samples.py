"""Repeatable sample frames for tests: values follow from a hash of symbol and day."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barloom.functions.numeric import to_tick
from barloom.sources.calendar import weekdays


def _unit(*parts: Column | str) -> Column:
    """A number in [0, 1) that depends only on the parts."""
    return F.pmod(F.xxhash64(*parts), F.lit(1_000_000)) / F.lit(1_000_000.0)


def _keys(spark: SparkSession, symbols: int, start: str, end: str) -> DataFrame:
    """Every symbol on every weekday: each symbol row unfolds the list of days."""
    days = weekdays(spark, start, end).agg(F.array_sort(F.collect_list("date")).alias("days"))
    ids = spark.range(symbols).select(
        F.concat(F.lpad(F.col("id").cast("string"), 6, "0"), F.lit(".XSHE")).alias("order_book_id"))
    return ids.withColumn("days", days.scalar()).select("order_book_id", F.explode("days").alias("date"))


def sample_bars(spark: SparkSession, symbols: int, start: str, end: str) -> DataFrame:
    k = _keys(spark, symbols, start, end)
    base = F.lit(20.0) + _unit("order_book_id") * 80.0
    close = to_tick(base * (F.lit(0.95) + _unit("order_book_id", "date") * 0.1))
    first = to_tick(base * (F.lit(0.95) + _unit("date", "order_book_id") * 0.1))
    volume = F.floor(_unit("order_book_id", "date", F.lit("v")) * 1e6) + 1
    return k.select(
        "order_book_id", "date", first.alias("open"),
        to_tick(F.greatest(first, close) * 1.01).alias("high"),
        to_tick(F.least(first, close) * 0.99).alias("low"), close.alias("close"),
        volume.alias("volume"), to_tick(volume * (first + close) / 2.0).alias("amount"))


def sample_values(spark: SparkSession, symbols: int, start: str, end: str,
                  fields: dict[str, tuple[float, float]]) -> DataFrame:
    """Fundamental, factor or technical columns, each between its two bounds."""
    k = _keys(spark, symbols, start, end)
    return k.select("order_book_id", "date", *[
        (F.lit(a) + _unit("order_book_id", "date", F.lit(n)) * F.lit(b - a)).alias(n)
        for n, (a, b) in fields.items()])
