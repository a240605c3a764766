"""Daily bars of trades that land in several deliveries, late ones included.

What is stored is a partial bar per symbol and day: first and last trade with their place in the order, extremes,
and sums. Partial bars merge in any order and grouping, so a late delivery touches only the months of its trades,
and the bars of two deliveries equal those of one. A delivery has a name and counts once.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from barloom.functions.numeric import as_col, to_tick
from barloom.functions.reuse import materialised
from barloom.sources import store

ID, DATE = "order_book_id", "date"


def partial_bars(ticks: DataFrame, symbol: Column | str, day: Column | str, price: Column | str, size: Column | str,
                 amount: Column | str, order_by: Sequence[Column | str]) -> DataFrame:
    """One mergeable row per symbol and day; `order_by` is a total order of the trades of a day."""
    place = F.struct(*[as_col(c).alias(f"o{i}") for i, c in enumerate(order_by)])
    rows = ticks.select(
        as_col(symbol).alias(ID), as_col(day).cast("date").alias(DATE), F.struct(place.alias("at"), as_col(price).alias("price")).alias("t"),
        as_col(price).alias("p"), as_col(size).cast("double").alias("s"), as_col(amount).cast("double").alias("a"))
    return rows.groupBy(ID, DATE).agg(
        F.min("t").alias("first"), F.max("t").alias("last"), F.max("p").alias("high"), F.min("p").alias("low"),
        F.sum("s").alias("volume"), F.sum("a").alias("amount"), F.count(F.lit(1)).alias("trades"))


def merged(partials: DataFrame) -> DataFrame:
    return partials.groupBy(ID, DATE).agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.sum("volume").alias("volume"), F.sum("amount").alias("amount"), F.sum("trades").alias("trades"))


def finished(partials: DataFrame) -> DataFrame:
    """Bars from partial bars, one per symbol and day."""
    return partials.select(
        ID, DATE, F.col("first.price").alias("open"), "high", "low", F.col("last.price").alias("close"), "volume",
        to_tick(F.col("amount")).alias("amount"), "trades")


def land(commit: store.Commit, name: str, partials: DataFrame, table: str = "partial_bars") -> list[str]:
    """Merge a delivery's partial bars into the stored ones; the months that changed, none if the delivery
    has been merged before."""
    done = commit.read("landings")
    if done is not None and not done.where(F.col("name") == name).isEmpty():
        return []
    new = materialised(partials)
    months = sorted(r["m"] for r in new.select(store.month_of().alias("m")).distinct().collect())  # bounded by the calendar
    old = commit.read(table, months) if months else None
    if months:
        commit.put(table, merged(new if old is None else old.unionByName(new)))
    mark = commit.spark.createDataFrame([(name, len(months))], "name string, months long").withColumn(DATE, F.current_date())
    store.upsert(commit, "landings", mark, keys=("name",), order=("months",))
    return months
