"""Daily bars from trades, and the clean-up of landed vendor bars."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.functions.numeric import as_col, to_tick

BAR_FIELDS = ["open", "high", "low", "close", "volume", "amount"]

# fixed values: what an instrument gets where the vendor record leaves a field out
INSTRUMENT_DEFAULTS = {
    "exchange": "CN",
    "type": "CS",
    "status": "Active",
    "listed_date": "1990-01-01",
    "de_listed_date": "",
    "sector_code": "",
    "industry_code": "",
    "board_type": "",
}


def daily_bars(
    ticks: DataFrame,
    symbol: Column | str,
    day: Column | str,
    price: Column | str,
    size: Column | str,
    amount: Column | str,
    order_by: Sequence[Column | str] | None = None,
    sequence: Column | str | None = None,
    large_from: Column | str | None = None,
) -> DataFrame:
    """OHLCV per symbol and day; with `large_from` (the size from which a trade of its symbol is large, see
    `large_order_sizes`) also the share of the amount from large trades, counted in the same pass.

    Trades of a day are put in order either by `order_by`, a total order of any columns, or by
    `sequence`, one whole number per trade, with equal numbers ordered by price (steps of 1e-4, up to
    4e13 either way); among trades equal in both any one is taken, so such an open or close is known to 1e-4.
    Everything is a mergeable aggregate, so a map task sends one row per symbol and
    day however many trades a symbol has. The second form keeps the aggregation hash-based, since its
    order is one decimal; a struct order makes Spark sort the trades of each task. Prices are never
    rebuilt from the order.
    """
    if (order_by is None) == (sequence is None):
        raise ValueError("give either order_by or sequence")
    if sequence is not None:
        tie = F.floor(F.least(F.greatest(as_col(price), F.lit(-4e13)), F.lit(4e13)) * 1e4) + F.lit(5 * 10**17)
        order = (as_col(sequence).cast("decimal(19,0)") * F.lit(10**18).cast("decimal(19,0)")).cast("decimal(38,0)")
        order = (order + F.coalesce(tie, F.lit(0)).cast("decimal(18,0)")).cast("decimal(38,0)")
    else:
        order = F.struct(*[as_col(c) for c in order_by])
    first, last = F.min_by("_p", "_o"), F.max_by("_p", "_o")
    cut = [] if large_from is None else [as_col(large_from).alias("_c")]
    share = [] if large_from is None else [
        F.when(F.col("order_book_id").isNotNull(), _large_share("_s", "_a", "_c")).alias("large_order_ratio")]
    return (
        ticks.select(
            *cut,
            as_col(symbol).alias("order_book_id"),
            as_col(day).cast("date").alias("date"),
            as_col(price).alias("_p"),
            as_col(size).cast("double").alias("_s"),
            as_col(amount).cast("double").alias("_a"),
            order.alias("_o"),
        )
        .groupBy("order_book_id", "date")
        .agg(
            first.alias("open"),
            F.max("_p").alias("high"),
            F.min("_p").alias("low"),
            last.alias("close"),
            F.sum("_s").alias("volume"),
            to_tick(F.sum("_a")).alias("amount"),
            F.count(F.lit(1)).alias("trades"),
            *share,
        )
    )


def normalise_vendor_bars(raw: DataFrame, adjust: str, frequency: str = "1d") -> DataFrame:
    """Landed vendor bars -> typed bars: renamed turnover, real dates, tolerant casts, provenance."""
    df = raw
    if "total_turnover" in df.columns and "amount" not in df.columns:
        df = df.withColumnRenamed("total_turnover", "amount")
    if "datetime" in df.columns and "date" not in df.columns:
        df = df.withColumnRenamed("datetime", "date")
    typed = {}
    for name in df.columns:
        if name == "date":
            typed[name] = F.to_date(F.col("date").cast("string").substr(1, 10))
        elif name == "volume":
            typed[name] = F.col("volume").try_cast("bigint")
        elif name not in ("order_book_id", "symbol"):
            typed[name] = F.col(name).try_cast("double")
    return df.withColumns(typed).withColumns(provenance("landed", frequency, adjust))


def provenance(source: str, frequency: str, adjust: str) -> dict[str, Column]:
    return {
        "_data_source": F.lit(source),
        "_frequency": F.lit(frequency),
        "_adjust_type": F.lit(adjust),
        "_fetch_timestamp": F.current_timestamp(),
    }


def normalise_instruments(raw: DataFrame) -> DataFrame:
    """Fill what the vendor left out and stamp the source."""
    filled = {}
    for name, default in INSTRUMENT_DEFAULTS.items():
        have = F.col(name) if name in raw.columns else F.lit(None).cast("string")
        filled[name] = F.coalesce(have, F.lit(default))
    return raw.withColumns(filled).withColumn("_data_source", F.lit("landed"))


def dual_adjusted(post: DataFrame, pre: DataFrame) -> DataFrame:
    """Post-adjusted bars with the pre-adjusted prices beside them as `*_pre`."""
    keys = ["order_book_id", "date"]
    priced = [c for c in ("open", "close", "high", "low", "vwap") if c in pre.columns]
    side = pre.select(*keys, *[F.col(c).alias(f"{c}_pre") for c in priced])
    return post.join(side, keys, "left")


def adjustment_check(dual: DataFrame) -> DataFrame:
    """Ratio post/pre of each symbol's latest row; a ratio of at least 1 is plausible."""
    latest = dual.groupBy("order_book_id").agg(
        F.max_by(F.struct("date", "close", "close_pre"), F.col("date")).alias("r")
    )
    ratio = F.try_divide(F.col("r.close"), F.col("r.close_pre"))
    return latest.select(
        "order_book_id",
        F.col("r.date").alias("date"),
        ratio.alias("adjust_ratio"),
        F.coalesce(ratio >= 1, F.lit(False)).alias("plausible"),
    )


SIZE_RANGES = 32


def _large_share(size: str, amount: str, cut: str) -> Column:
    """Aggregate: share of the amount from trades of at least the size `cut`."""
    is_large = F.coalesce(F.col(size) >= F.col(cut), F.lit(False)) | F.isnan(F.col(size).cast("double"))
    return F.try_divide(F.sum(F.when(is_large, F.col(amount)).otherwise(F.lit(0.0))), F.sum(amount))


def large_order_sizes(ticks: DataFrame, prob: float = 0.9) -> DataFrame:
    """(order_book_id, large_from): the smallest size that is larger than the symbol's p90 size; no row where none is.

    `ticks` needs order_book_id and size. A size is larger than the (interpolated) quantile exactly if more than
    floor(prob * (n - 1)) of the symbol's n trades are smaller, so the quantile itself is never looked up. Trades of
    equal size collapse before the shuffle. The numbers of smaller trades are prefix sums in ranges of sizes, moved
    by the ranges before them, so that a symbol with a third of all trades is worked off in as many tasks as there
    are ranges.
    """
    known = ticks.where(F.col("size").isNotNull() & ~F.isnan(F.col("size").cast("double")))
    probs = [k / SIZE_RANGES for k in range(1, SIZE_RANGES)]
    edges = sorted(set(known.agg(F.percentile_approx(F.col("size").cast("double"), probs, 1000)).first()[0] or ()))
    part = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e < F.col("size"))) if edges else F.lit(0)
    counts = known.groupBy("order_book_id", "size").agg(F.count(F.lit(1)).alias("_n")).withColumn("_part", part)
    inside = Window.partitionBy("order_book_id", "_part").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumn("_below", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    ranges = counts.groupBy("order_book_id", "_part").agg(F.sum("_n").alias("_k"))
    head = Window.partitionBy("order_book_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select("order_book_id", "_part", F.coalesce(F.sum("_k").over(head), F.lit(0)).alias("_before"),
                            F.sum("_k").over(Window.partitionBy("order_book_id")).alias("_total"))
    rank = F.floor(F.lit(float(prob)) * (F.col("_total") - 1).cast("double"))
    large = ranked.join(offsets, ["order_book_id", "_part"]).where(F.col("_before") + F.col("_below") > rank)
    return large.groupBy("order_book_id").agg(F.min("size").alias("large_from"))


def with_large_sizes(ticks: DataFrame, prob: float = 0.9) -> DataFrame:
    """Trades with their symbol's `large_from`. One number for each listed symbol is broadcast, so the trades are
    not shuffled and a symbol with very many of them is no hot key."""
    return ticks.join(F.broadcast(large_order_sizes(ticks, prob)), "order_book_id", "left")


def large_order_ratio(ticks: DataFrame, prob: float = 0.9) -> DataFrame:
    """Per symbol and day: share of the amount from trades larger than the symbol's p90 size. `ticks` needs
    order_book_id, date, size, amount; trades of a day collapse before the shuffle."""
    sized = with_large_sizes(ticks, prob).where(F.col("order_book_id").isNotNull())
    return sized.groupBy("order_book_id", "date").agg(_large_share("size", "amount", "large_from").alias("large_order_ratio"))
