"""Forward returns, correlations, buckets and distributions."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.functions.numeric import correlation, usable, usable_or_null
from barloom.functions.ranks import TIE_SHARE, average_rank, exact_quantiles, range_edges, rank_in_ranges, with_ranges
from barloom.functions.reuse import materialised
from barloom.functions.student import correlation_p_value
from barloom.operators.indicators import DATE, ID, by_symbol, previous
from barloom.sources.calendar import beside

# ---------------------------------------------------------------- returns


def trailing_return(df: DataFrame, n: int = 10) -> DataFrame:
    """Percent change over the last n rows of the symbol; rows without it are dropped."""
    before = previous("close", n)
    out = f"return_{n}d"
    return df.withColumn(
        out, F.try_divide(F.col("close") - before, before) * F.lit(100.0)).where(F.col(out).isNotNull())


def _closes_after(steps: Sequence[int]) -> dict[int, Column]:
    """The close exactly n trading days later. Days are unique in a symbol, so that bar is one of the next n rows in
    the order of the days: the indicators' order serves, whatever the frame's width."""
    w, today = by_symbol(), F.col("trade_seq")
    return {n: F.coalesce(*[F.when(F.lead("trade_seq", k).over(w) == today + n, F.lead("close", k).over(w))
                            for k in range(n, 0, -1)]) for n in steps}


def forward_return(df: DataFrame, calendar: DataFrame, n: int = 5, out: str | None = None,
                   drop: bool = True) -> DataFrame:
    """Return to the bar exactly n trading days later; a symbol without a bar on that day has none.

    The frame is neither joined to itself nor sorted again.
    """
    out = out or f"return_{n}d"
    dated = df.join(beside(calendar.select(DATE, "trade_seq")), DATE)
    later = _closes_after([n])[n]
    got = dated.withColumn(out, F.try_divide(later - F.col("close"), F.col("close"))).drop("trade_seq")
    return got.where(F.col(out).isNotNull()) if drop else got


def forward_returns(df: DataFrame, calendar: DataFrame, steps: Sequence[int]) -> DataFrame:
    """Returns to the bars exactly n trading days later for several n in one window pass, null where there is none."""
    dated = df.join(beside(calendar.select(DATE, "trade_seq")), DATE)
    return dated.withColumns({
        f"return_{n}d": F.try_divide(x - F.col("close"), F.col("close")) for n, x in _closes_after(steps).items()}).drop("trade_seq")


def _bars_within(days: int, need: int) -> Column:
    """Whether a bar and the next need - 1 of its symbol lie within `days` calendar days."""
    return F.coalesce(F.lead(DATE, need - 1).over(by_symbol()) <= F.date_add(F.col(DATE), days), F.lit(False))


def forward_grid(df: DataFrame, steps: int = 10, days: int = 30, need: int = 10,
                 carry: Sequence[str] = (), only_enough: bool = False) -> DataFrame:
    """Long table of returns 1..steps rows ahead within `days` calendar days; a later close of 0 is a return of -1.
    `enough` tells whether a bar has at least `need` bars (itself included) in that time; with `only_enough` the
    others go."""
    w = by_symbol()
    limit = F.date_add(F.col(DATE), days)
    ahead = [F.when(F.lead(DATE, k).over(w) <= limit, F.lead("close", k).over(w)).alias(str(k))
             for k in range(1, steps + 1)]
    base = df.select(ID, DATE, "close", *carry, _bars_within(days, need).alias("enough"), *ahead)
    if only_enough:
        base = base.where("enough")
    long = base.unpivot([ID, DATE, "close", "enough", *carry], [str(k) for k in range(1, steps + 1)], "n_days", "later")
    return long.where((F.col("close") > 0) & F.col("later").isNotNull()).select(
        ID, DATE, *carry, "enough", F.col("n_days").cast("bigint").alias("n_days"),
        ((F.col("later") - F.col("close")) / F.col("close")).alias("ret"))


def short_returns(df: DataFrame, days: int = 30, need: int = 10, legacy_offset: bool = True,
                  only_enough: bool = False) -> DataFrame:
    """3- and 5-day returns by row offset, and `enough` as in `forward_grid`. The legacy form counts the current bar
    as day one, so it looks 2 and 4 rows ahead."""
    w = by_symbol()
    shift = 1 if legacy_offset else 0
    made = {f"return_{n}d": F.try_divide(F.lead("close", n - shift).over(w) - F.col("close"), F.col("close"))
            for n in (3, 5)}
    out = df.withColumns({**made, "enough": _bars_within(days, need)}).where(F.col("close") > 0)
    return out.where("enough") if only_enough else out


def with_positions(positions: DataFrame, returns: DataFrame) -> DataFrame:
    """Positions with the forward return of the same symbol and score day."""
    r = returns.withColumnRenamed(DATE, "score_date")
    return positions.join(
        r, (positions[ID] == r[ID]) & (positions[DATE] == r["score_date"])).drop(r[ID]).drop("score_date")


def scores_with_prices(scores: DataFrame, bars: DataFrame, calendar: DataFrame, n: int) -> DataFrame:
    """Scores with the price of their day and the price exactly n trading days later."""
    w = Window.partitionBy(ID).orderBy("trade_seq").rangeBetween(n, n)
    priced = bars.join(beside(calendar.select(DATE, "trade_seq")), DATE).select(
        ID, DATE, F.col("close").alias("price"), F.first("close").over(w).alias("future_price"))
    return scores.join(priced.where(F.col("future_price").isNotNull()), [ID, DATE])


# ---------------------------------------------------------------- distributions


def distribution(df: DataFrame, column: str,
                 percents: Sequence[int] = (1, 5, 10, 25, 50, 75, 90, 95, 99)) -> DataFrame:
    """One row: count, mean, median, population deviation, extremes, skewness, excess kurtosis and
    percentiles. The moments merge; the percentiles come from exact distributed ranks."""
    df = materialised(df.select(usable_or_null(column).alias(column)).where(F.col(column).isNotNull()))
    x = F.col(column)
    moments = df.agg(
        F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"),
        F.min(x).alias("min"), F.max(x).alias("max"), F.skewness(x).alias("skew"),
        F.kurtosis(x).alias("kurtosis"))
    names = [f"p{p}" for p in percents]
    q = exact_quantiles(df, column, [p / 100.0 for p in percents], names)
    packed = q.select(F.struct(*names).alias("q")).scalar()
    out = moments.withColumn("_q", packed)
    if "p50" in names:
        out = out.withColumn("median", F.col("_q.p50"))
    return out.withColumns({n: F.col(f"_q.{n}") for n in names}).drop("_q")


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """Equal-width bins between the extremes, the last one closed; empty bins have no row."""
    df = df.where(usable(column))
    ends = df.agg(F.struct(F.min(column).alias("a"), F.max(column).alias("b")).alias("e")).scalar()
    part = F.try_divide(F.col(column) - F.col("_e.a"), F.col("_e.b") - F.col("_e.a"))
    number = F.least(F.floor(F.coalesce(part, F.lit(0.0)) * bins), F.lit(bins - 1)) + 1
    return (df.select(column).withColumn("_e", ends)
            .groupBy(number.cast("bigint").alias("bin"))
            .agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high")))


def trend_line(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
                  F.regr_count(y, x).alias("n"))


# ---------------------------------------------------------------- correlations


def indicators_long(df: DataFrame, columns: Sequence[str], target: str,
                    categories: dict[str, str] | None = None) -> DataFrame:
    """Rows (indicator, value, target) with finite values only."""
    base = df.select(F.col(target).cast("double").alias(target),
                     *[usable_or_null(c).alias(c) for c in columns]).where(usable(target))
    return base.unpivot([target], list(columns), "indicator", "value").where(F.col("value").isNotNull())


def _cells(df: DataFrame, columns: Sequence[str], *more: Column) -> DataFrame:
    """Long rows (i, x, ...): one per value of an indicator, numbered by its place in `columns`; with its range `xr`
    and the target's rank `ry` where the frame has them."""
    beside = [(prefix, name) for prefix, name in (("_r_", "xr"), ("_k_", "ry")) if f"{prefix}{columns[0]}" in df.columns]
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).alias("x"), *[F.col(f"{prefix}{c}").alias(name) for prefix, name in beside])
                      for i, c in enumerate(columns)])
    return df.select(*more, F.explode(cells).alias("c")).select("*", "c.*").drop("c")


def _named(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    names = F.array(*[F.lit(c) for c in columns])
    return df.select(F.get(names, F.col("i")).alias("indicator"), *[c for c in df.columns if c != "i"])


def pearson_by_indicator(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """(indicator, n, pearson) for every column. The rows are unfolded inside the scan and combined there: a few
    compiled sums for all indicators instead of some for each."""
    wide = df.select(usable_or_null(target).alias("_y"), *[usable_or_null(c).alias(c) for c in columns]).where(F.col("_y").isNotNull())
    one = _cells(wide, columns, F.col("_y")).groupBy("i").agg(
        F.count("x").alias("n"), correlation(F.col("x"), F.col("_y")).alias("pearson"))
    return _named(one, columns)


def _target_ranks(wide: DataFrame, columns: Sequence[str], ranges: int) -> DataFrame:
    """For each column, as `_k_<column>`, the tie-averaged rank of `_y` among the rows that have the column. The wide
    rows are shuffled once, by the range of `_y`, and serve all columns there: ranks are running counts of each
    column's values, moved by the counts of the ranges before."""
    part, tie = F.col("_r__y"), F.col("_r__y") % 2 == 0  # the rows of an even range are all ties and may lie in any task
    ranged = with_ranges(wide, range_edges(wide, ["_y"], ranges))
    head = Window.orderBy("_r__y").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_r__y").agg(*[F.count(c).alias(f"_n_{c}") for c in columns])  # one row a range
    totals = totals.select("_r__y", *[F.struct(F.coalesce(F.sum(f"_n_{c}").over(head), F.lit(0)).alias("before"),
                                               F.col(f"_n_{c}").alias("n")).alias(f"_t_{c}") for c in columns])
    salted = ranged.withColumn("_salt", F.when(tie, F.pmod(F.xxhash64(*columns), F.lit(TIE_SHARE))).otherwise(0))
    upto = Window.partitionBy("_r__y", "_salt").orderBy("_y").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    same = Window.partitionBy("_r__y", "_salt", "_y")
    counted = salted.withColumns({f"_u_{c}": F.count(c).over(upto) for c in columns}).withColumns(
        {f"_p_{c}": F.count(c).over(same) for c in columns})
    ranks = [(F.col(f"_t_{c}.before") + F.when(tie, (F.col(f"_t_{c}.n") + 1) / 2.0).otherwise(
        F.col(f"_u_{c}") - (F.col(f"_p_{c}") - 1) / 2.0)).alias(f"_k_{c}") for c in columns]
    return counted.join(F.broadcast(totals), "_r__y").select(*columns, *ranks)


def spearman_by_indicator(df: DataFrame, columns: Sequence[str], target: str, ranges: int = 64, held: bool = False) -> DataFrame:
    """(indicator, spearman): Pearson correlation of tie-averaged ranks within each indicator.

    The wide rows are shuffled once by the target's range, which ranks the target for every indicator. Then long rows
    (indicator, value, rank of the target) are shuffled once by the value's range and ranked inside the ranges. `held`
    says that `df` is cheap to read again."""
    zero = F.lit(0.0)  # so that -0.0 and 0.0 are one value
    wide = df.select((usable_or_null(target) + zero).alias("_y"), *[(usable_or_null(c) + zero).alias(c) for c in columns])
    wide = wide.where(F.col("_y").isNotNull())
    wide = wide if held else materialised(wide)  # read for the edges, the counts and the ranks
    edges = range_edges(wide, columns, ranges)
    long = _cells(with_ranges(_target_ranks(wide, columns, ranges), edges), columns).where(F.col("x").isNotNull())
    counted = _cells(with_ranges(wide, edges), columns).where(F.col("x").isNotNull())
    ranked = rank_in_ranges(long, "i", "x", "xr", "rx", counted)
    return _named(ranked.groupBy("i").agg(correlation(F.col("rx"), F.col("ry")).alias("spearman")), columns)


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: pairs, Pearson and Spearman correlation."""
    df = materialised(df.select(usable_or_null(x).alias("x"), usable_or_null(y).alias("y")).na.drop())
    ranked = average_rank(materialised(average_rank(df, "x", "rank_x")), "y", "rank_y")
    return ranked.agg(F.count(F.lit(1)).alias("n"), F.corr("x", "y").alias("pearson"),
                      F.corr("rank_x", "rank_y").alias("spearman"))


def correlation_table(df: DataFrame, categories: dict[str, Sequence[str]], target: str,
                      at_least: int = 0, with_spearman: bool = True, held: bool = False) -> DataFrame:
    """Per indicator: category, pairs, Pearson, Spearman, both p-values, stars. `held` says that `df` is cheap to read
    again."""
    columns = [c for cols in categories.values() for c in cols if c in df.columns]
    label = F.lit(None).cast("string")
    for name, cols in categories.items():
        label = F.when(F.col("indicator").isin(list(cols)), F.lit(name)).otherwise(label)
    out = pearson_by_indicator(df, columns, target).where(F.col("n") >= at_least)
    out = out.withColumn("category", label).withColumn(
        "pearson_p", correlation_p_value(F.col("pearson"), F.col("n")))
    if with_spearman:
        out = out.join(spearman_by_indicator(df, columns, target, held=held), "indicator")
        out = out.withColumn("spearman_p", correlation_p_value(F.col("spearman"), F.col("n")))
    return out.withColumn("stars", stars(F.col("pearson_p")))


def stars(p: Column) -> Column:
    return (F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise(""))


def strongest(table: DataFrame, k: int | None = None) -> DataFrame:
    """The indicators by absolute Pearson correlation; with k the first k."""
    ordered = table.orderBy(F.desc(F.abs("pearson")), F.asc("indicator"))
    return ordered if k is None else ordered.limit(k)


def strength_label(r: Column, p: Column) -> Column:
    size = F.when(F.abs(r) > 0.5, "strong").when(F.abs(r) > 0.3, "moderate").otherwise("weak")
    return F.concat(size, F.when(p < 0.05, ", significant").otherwise(", not significant"))


# ---------------------------------------------------------------- buckets


def edges_of(df: DataFrame, column: str, probs: Sequence[float], how: str = "linear") -> DataFrame:
    """One row with the exact quantiles as the array `edges`."""
    names = [f"_e{i}" for i in range(len(probs))]
    return exact_quantiles(df, column, probs, names, how=how).select(F.array(*names).alias("edges"))


def digitize(df: DataFrame, column: str, edges: DataFrame, k: int, out: str = "bucket",
             closed: str = "left") -> DataFrame:
    """Bucket 1..k+1 by k edges: one more than the number of edges at or below the value (left) or
    strictly below it (right). The edges are a single-row subquery."""
    arr, x = F.col("_edges"), F.col(column)
    hits = [(x >= F.get(arr, F.lit(i))) if closed == "left" else (x > F.get(arr, F.lit(i)))
            for i in range(k)]
    number = sum((F.coalesce(h, F.lit(False)).cast("bigint") for h in hits), F.lit(1).cast("bigint"))
    return df.withColumn("_edges", edges.scalar()).withColumn(out, number).drop("_edges")


def discretise(df: DataFrame, column: str, step: float = 0.1, out: str = "bucket") -> DataFrame:
    """Quantile number 1..1/step: the number of distinct percentile edges, from the minimum up to
    but without the maximum, that the value reaches."""
    df = df.where(usable(column))
    k = round(1 / step)
    e = edges_of(df, column, [min(i * step, 1.0) for i in range(k + 1)])
    e = e.select(F.array_distinct("edges").alias("d")).select(
        F.slice("d", F.lit(1), F.size("d") - 1).alias("edges"))
    return digitize(df, column, e, k, out).withColumn(out, F.col(out) - 1)


def bucket_returns(df: DataFrame, bucket: str, returns: Sequence[str], signal: str | None = None) -> DataFrame:
    """Per bucket: count, mean, median, population deviation of each return, range of the signal."""
    aggs = [F.count(F.lit(1)).alias("count")]
    for r in returns:
        aggs += [F.avg(r).alias(f"mean_{r}"), F.stddev_pop(r).alias(f"std_{r}")]
    if signal:
        aggs += [F.min(signal).alias("min_signal"), F.max(signal).alias("max_signal"),
                 F.avg(signal).alias("mean_signal")]
    out = df.groupBy(bucket).agg(*aggs)
    for r in returns:
        out = out.join(exact_quantiles(df, r, [0.5], [f"median_{r}"], by=[bucket]), bucket)
    return out


def decile_returns(df: DataFrame, signal: str, ret: str, buckets: int = 10) -> DataFrame:
    """Return statistics by equal-count bucket of the signal."""
    df = materialised(df.where(usable(signal) & usable(ret)).select(signal, ret))
    edges = edges_of(df, signal, [i / buckets for i in range(1, buckets)])
    marked = materialised(digitize(df, signal, edges, buckets - 1, "quantile"))
    return bucket_returns(marked, "quantile", [ret], signal)


def quintile_returns(df: DataFrame, signal: str, returns: Sequence[str]) -> DataFrame:
    """Five right-closed buckets of the signal with statistics of several returns."""
    ok = usable(signal)
    for r in returns:
        ok = ok & usable(r)
    df = materialised(df.where(ok).select(signal, *returns))
    edges = edges_of(df, signal, [0.2, 0.4, 0.6, 0.8])
    marked = materialised(digitize(df, signal, edges, 4, "quantile", closed="right"))
    return bucket_returns(marked, "quantile", returns, signal)


def quartile_means(df: DataFrame, signal: str, ret: str) -> DataFrame:
    """Mean return of the four quarters, each closed at both ends (edge rows count in two)."""
    df = materialised(df.where(usable(signal) & usable(ret)).select(signal, ret))
    e = edges_of(df, signal, [0.0, 0.25, 0.5, 0.75, 1.0])
    marked = df.withColumn("_e", e.scalar())
    x = F.col(signal)
    return marked.agg(*[
        F.avg(F.when(x.between(F.get("_e", F.lit(i)), F.get("_e", F.lit(i + 1))), F.col(ret))).alias(f"q{i + 1}")
        for i in range(4)])


def rsi_surface(grid: DataFrame, rsi: str = "rsi_14") -> DataFrame:
    """Median and population deviation of the return per ten-point RSI bin and holding length."""
    cells = grid.where(usable(rsi) & (F.col(rsi) >= 0) & (F.col(rsi) < 100)).select(
        (F.floor(F.col(rsi) / 10) * 10 + 5).cast("bigint").alias("rsi_center"), "n_days", "ret")
    cells = materialised(cells)
    spread = cells.groupBy("rsi_center", "n_days").agg(
        F.count(F.lit(1)).alias("count"), F.stddev_pop("ret").alias("std"))
    mid = exact_quantiles(cells, "ret", [0.5], ["median"], by=["rsi_center", "n_days"])
    return spread.join(mid, ["rsi_center", "n_days"])


def best_buckets(stats: DataFrame, mean: str, high: float = 1.5, low: float = 0.8) -> DataFrame:
    """One row: best and worst bucket, the best with a high, a low, and an extreme signal."""
    row = F.struct("quantile", F.col(mean).alias("mean_return"))
    order = F.struct(F.col(mean), F.col("quantile"))

    def best(cond: Column) -> Column:
        return F.max_by(F.col("quantile"), F.when(cond, order))

    return stats.agg(
        F.max_by(row, order).alias("b"), F.min_by(row, order).alias("w"),
        best(F.col("min_signal") >= high).alias("best_high"),
        best(F.col("max_signal") <= low).alias("best_low"),
        best(F.col("quantile") >= 8).alias("best_extreme"),
    ).select(F.col("b.quantile").alias("best"), F.col("b.mean_return").alias("best_return"),
             F.col("w.quantile").alias("worst"), F.col("w.mean_return").alias("worst_return"),
             "best_high", "best_low", "best_extreme")


# ---------------------------------------------------------------- score validation


def score_thresholds(df: DataFrame, score: str, ret: str,
                     probs: Sequence[float] = (0.1, 0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """For each nearest-rank quantile of the score: rows at or above it and their mean return."""
    df = materialised(df.select(score, ret))
    e = edges_of(df, score, probs, how="nearest")
    marked = df.withColumn("_e", e.scalar())
    one = marked.agg(*[
        F.struct(F.lit(float(p)).alias("prob"), F.first(F.get("_e", F.lit(i))).alias("threshold"),
                 F.count(F.when(F.col(score) >= F.get("_e", F.lit(i)), 1)).alias("rows"),
                 F.avg(F.when(F.col(score) >= F.get("_e", F.lit(i)), F.col(ret))).alias("mean_return")
                 ).alias(f"t{i}") for i, p in enumerate(probs)])
    return one.select(F.inline(F.array(*[F.col(f"t{i}") for i in range(len(probs))])))


def top_and_bottom(df: DataFrame, score: str, ret: str, k: int = 50) -> DataFrame:
    """Mean return, share of gains and of losses among the k best and the k worst scores."""
    cols = df.select(ID, score, ret)
    top = cols.orderBy(F.desc_nulls_last(score), F.asc(ID)).limit(k).withColumn("side", F.lit("top"))
    low = cols.orderBy(F.asc_nulls_last(score), F.asc(ID)).limit(k).withColumn("side", F.lit("bottom"))
    return top.unionByName(low).groupBy("side").agg(
        F.count(F.lit(1)).alias("n"), F.avg(ret).alias("mean_return"),
        F.avg((F.col(ret) > 0).cast("double")).alias("share_positive"),
        F.avg((F.col(ret) < 0).cast("double")).alias("share_negative"))


# ---------------------------------------------------------------- market and angles

# fixed values: half-open angle bands from -90 to 90
ANGLE_BANDS = (-90, -45, -30, -15, 15, 30, 45, 90)


def angle_bands(df: DataFrame, angle: str) -> DataFrame:
    """Rows per angle band and their share."""
    x = F.col(angle)
    label = F.lit(None).cast("string")
    for a, b in zip(ANGLE_BANDS, ANGLE_BANDS[1:]):
        label = F.when((x >= a) & (x < b), F.lit(f"{a}..{b}")).otherwise(label)
    banded = df.where(usable(angle)).select(label.alias("band")).where(F.col("band").isNotNull())
    counts = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy()  # at most seven rows
    return counts.withColumn("share", F.col("n") / F.sum("n").over(w))


def angle_trends(latest: DataFrame, angle: str) -> DataFrame:
    """Five trend classes of the latest angles; the values 10 and -10 count in two classes."""
    x = F.col(angle)
    return latest.where(usable(angle)).agg(
        F.count(F.lit(1)).alias("symbols"),
        F.count(F.when(x > 30, 1)).alias("strong_up"),
        F.count(F.when(x.between(10, 30), 1)).alias("up"),
        F.count(F.when(x.between(-10, 10), 1)).alias("flat"),
        F.count(F.when(x.between(-30, -10), 1)).alias("down"),
        F.count(F.when(x < -30, 1)).alias("strong_down"))


def mean_angle_trends(df: DataFrame, angle: str, edge: float = 10.0) -> DataFrame:
    """Mean angle per symbol, then the number of symbols that go up, down or sideways."""
    mean = df.where(usable(angle)).groupBy(ID).agg(F.avg(angle).alias("m"))
    kind = F.when(F.col("m") > edge, "up").when(F.col("m") < -edge, "down").otherwise("sideways")
    out = mean.groupBy(kind.alias("trend")).agg(F.count(F.lit(1)).alias("symbols"))
    w = Window.partitionBy()  # at most three rows
    return out.withColumn("share", F.col("symbols") / F.sum("symbols").over(w))


def steepest(df: DataFrame, angle: str, above: float = 40.0, k: int = 5) -> DataFrame:
    """Symbols with the largest angles above a bound."""
    return (df.where(usable(angle) & (F.col(angle) > above)).groupBy(ID)
            .agg(F.max(angle).alias("max_angle"), F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("max_angle"), F.asc(ID)).limit(k))


def market_trend(df: DataFrame) -> DataFrame:
    """Mean, deviation and count of the closes per day, with the change of the mean. The lag runs
    over one row per day."""
    days = df.groupBy(DATE).agg(
        F.avg("close").alias("avg_price"), F.stddev_samp("close").alias("price_std"),
        F.count("close").alias("stock_count"))
    before = F.lag("avg_price").over(Window.orderBy(DATE))
    return days.withColumn(
        "change_pct", F.try_divide(F.col("avg_price") - before, before) * F.lit(100.0))


def market_change(df: DataFrame) -> DataFrame:
    """Change of the daily mean close from the first to the last day."""
    days = df.groupBy(DATE).agg(F.avg("close").alias("m"))
    ends = days.agg(F.min_by("m", DATE).alias("first_mean"), F.max_by("m", DATE).alias("last_mean"))
    return ends.withColumn("change_pct", F.try_divide(
        F.col("last_mean") - F.col("first_mean"), F.col("first_mean")) * F.lit(100.0))


def regime(df: DataFrame, edge: float = 0.001) -> DataFrame:
    """Overall mean daily return and the market verdict."""
    change = F.try_divide(F.col("close") - previous("close"), previous("close"))
    r = df.select(change.alias("ret")).where(F.col("ret").isNotNull())
    one = r.agg(F.avg("ret").alias("mean_return"), F.count(F.lit(1)).alias("n"))
    m = F.col("mean_return")
    return one.withColumn("regime", F.when(m < -edge, "bear").when(m > edge, "bull").otherwise("sideways"))


def daily_mean_returns(df: DataFrame) -> DataFrame:
    change = F.try_divide(F.col("close") - previous("close"), previous("close"))
    r = df.select(DATE, change.alias("ret")).where(F.col("ret").isNotNull())
    return r.groupBy(DATE).agg(F.avg("ret").alias("avg_return"), F.count(F.lit(1)).alias("stock_count"))


def symbol_returns(df: DataFrame, at_least: int = 20, edge: float = 0.05) -> DataFrame:
    """First-to-last return of every symbol and its class; `enough` tells whether it has at least so many bars."""
    ends = df.groupBy(ID).agg(
        F.count(F.lit(1)).alias("bars"), F.min_by("close", DATE).alias("first_close"),
        F.max_by("close", DATE).alias("last_close"))
    r = F.try_divide(F.col("last_close") - F.col("first_close"), F.col("first_close"))
    kind = F.when(r > edge, "bullish").when(r < -edge, "bearish").otherwise("sideways")
    return ends.withColumns({"total_return": r, "trend": kind, "enough": F.col("bars") >= at_least})


def majority(returns: DataFrame) -> DataFrame:
    """Classes of the symbols with enough bars, and the larger side."""
    returns = returns.where("enough")
    up, down = F.count(F.when(F.col("trend") == "bullish", 1)), F.count(F.when(F.col("trend") == "bearish", 1))
    one = returns.agg(up.alias("bullish"), down.alias("bearish"),
                      F.count(F.when(F.col("trend") == "sideways", 1)).alias("sideways"))
    return one.withColumn("verdict", F.when(F.col("bullish") > F.col("bearish"), "BULLISH")
                          .when(F.col("bearish") > F.col("bullish"), "BEARISH").otherwise("MIXED"))


def adjustment_spread(df: DataFrame) -> DataFrame:
    """Per symbol, over the latest bar of each adjust type: spread of close (also in percent),
    volume and amount."""
    last = df.groupBy(ID, "adjust_type").agg(
        F.max_by(F.struct("close", "volume", "amount"), F.col(DATE)).alias("r"))

    def spread(c: str) -> Column:
        return F.max(f"r.{c}") - F.min(f"r.{c}")

    return last.groupBy(ID).agg(
        F.count(F.lit(1)).alias("types"), spread("close").alias("close_spread"),
        (F.try_divide(spread("close"), F.max("r.close")) * F.lit(100.0)).alias("close_spread_pct"),
        spread("volume").alias("volume_spread"), spread("amount").alias("amount_spread")
    ).where(F.col("types") >= 2)


def mean_returns(df: DataFrame, columns: Sequence[str], cohort: Column) -> DataFrame:
    """Mean of each return column over all rows and over a cohort, with the cohort's share."""
    aggs = []
    for c in columns:
        aggs += [F.avg(c).alias(f"mean_{c}"), F.avg(F.when(cohort, F.col(c))).alias(f"cohort_{c}")]
    return df.agg(*aggs, F.avg(F.coalesce(cohort, F.lit(False)).cast("double")).alias("cohort_share"))
