"""Missing trading days: finding them, filling them, and judging the result.

Fill rows are made from the row next to the gap (its following or preceding neighbour comes from one
window by symbol), so nothing is joined and the work grows with the rows that are added.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from barloom.operators.clean import merge_update
from barloom.operators.indicators import DATE, ID, by_symbol
from barloom.sources.calendar import beside

NOT_VALUES = (ID, DATE, "symbol", "exchange")


def value_columns(df: DataFrame) -> list[str]:
    """Numeric columns that are no identifiers."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in NOT_VALUES]


def _weekdays_between(after: Column, before: Column) -> Column:
    """Array of the weekdays strictly between two dates (null or empty when there are none)."""
    inner = F.when(F.datediff(before, after) > 1,
                   F.sequence(F.date_add(after, 1), F.date_sub(before, 1)))
    return F.filter(inner, lambda d: F.weekday(d) < 5)


def _first_date() -> Column:
    return F.min(DATE).over(Window.partitionBy(ID))


def _within(days: Column, first: Column, max_fill_days: int | None) -> Column:
    if max_fill_days is None:
        return days
    return F.filter(days, lambda d: d <= F.date_add(first, max_fill_days))


def missing_dates(df: DataFrame, max_fill_days: int | None = None) -> DataFrame:
    """(symbol, missing weekday) between a symbol's first and last bar; with `max_fill_days` only up to so
    many calendar days after the first."""
    w = by_symbol()
    gaps = df.select(
        ID, F.col(DATE).alias("_d"), F.lead(DATE).over(w).alias("_n"), _first_date().alias("_f"))
    days = _within(_weekdays_between(F.col("_d"), F.col("_n")), F.col("_f"), max_fill_days)
    return gaps.select(ID, F.explode(days).alias(DATE))


def complete(df: DataFrame, method: str = "forward", max_fill_days: int | None = None) -> DataFrame:
    """All rows plus one row per missing weekday; `is_filled` marks the added ones.

    forward copies the bar before the gap, backward the one after it, linear takes the middle of
    both for numeric columns (one side where the other is null) and the earlier bar for the rest.
    """
    if method not in ("forward", "backward", "linear"):
        raise ValueError(f"unknown fill method {method!r}")
    w = by_symbol()
    rest = [c for c in df.columns if c not in (ID, DATE)]
    here = F.struct(*rest)
    if method == "backward":
        neighbour = F.lag(DATE).over(w)
        after, before = F.col("_n"), F.col(DATE)
    else:
        neighbour = F.lead(DATE).over(w)
        after, before = F.col(DATE), F.col("_n")
    base = df.withColumns({"_n": neighbour, "_f": _first_date()})
    if method == "linear":
        base = base.withColumn("_o", F.lead(here).over(w))
        numeric = set(value_columns(df))
        made = []
        for c in rest:
            a, b = F.col(c), F.col(f"_o.{c}")
            kind = df.schema[c].dataType
            mid = ((a.cast("double") + b.cast("double")) / F.lit(2.0)).cast(kind)
            made.append((F.coalesce(mid, a, b) if c in numeric else a).alias(c))
        fill = F.struct(*made)
    else:
        fill = here
    days = _within(_weekdays_between(after, before), F.col("_f"), max_fill_days)
    filled = F.transform(F.coalesce(days, F.array().cast("array<date>")), lambda d: F.struct(
        d.alias(DATE), F.lit(True).alias("is_filled")))
    own = F.array(F.struct(F.col(DATE).alias(DATE), F.lit(False).alias("is_filled")))
    rows = base.select(ID, here.alias("_own"), fill.alias("_fill"),
                       F.explode(F.concat(own, filled)).alias("_e"))
    return rows.select(
        ID, F.col(f"_e.{DATE}").alias(DATE),
        *[F.when(F.col("_e.is_filled"), F.col(f"_fill.{c}")).otherwise(F.col(f"_own.{c}")).alias(c)
          for c in rest],
        F.col("_e.is_filled").alias("is_filled"))


def _cells(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in (DATE, "is_filled")]


def fill_quality(df: DataFrame, completed: DataFrame) -> DataFrame:
    """Per symbol: (1 - share of null cells) x (added rows / missing days), between 0 and 1."""
    cells = _cells(completed)
    nulls = sum((F.col(c).isNull().cast("int") for c in cells[1:]), F.col(cells[0]).isNull().cast("int"))
    want = missing_dates(df).groupBy(ID).agg(F.count(F.lit(1)).alias("expected"))
    have = completed.groupBy(ID).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(nulls).alias("nulls"),
        F.count(F.when(F.col("is_filled"), 1)).alias("added"))
    rate = F.when(F.col("expected") > 0, F.col("added") / F.col("expected")).otherwise(F.lit(1.0))
    ratio = F.col("nulls") / (F.col("rows") * F.lit(len(cells)))
    q = (F.lit(1.0) - ratio) * rate
    return (have.join(want, ID, "left").na.fill(0, ["expected"])
            .withColumn("quality", F.least(F.greatest(q, F.lit(0.0)), F.lit(1.0))))


def continuity_quality(completed: DataFrame) -> DataFrame:
    """Per symbol: 0.7 (1 - filled / rows) + 0.3 share of gaps of at most three days; 1 when
    nothing was missing."""
    gap = F.datediff(F.col(DATE), F.lag(DATE).over(by_symbol()))
    g = completed.withColumn("_gap", gap).groupBy(ID).agg(
        F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("is_filled"), 1)).alias("missing"),
        F.avg((F.col("_gap") <= 3).cast("double")).alias("_cont"))
    cont = F.coalesce(F.col("_cont"), F.lit(1.0))
    q = F.lit(0.7) * (F.lit(1.0) - F.col("missing") / F.col("rows")) + F.lit(0.3) * cont
    return g.select(
        ID, "rows", "missing", cont.alias("continuity"),
        F.when(F.col("missing") == 0, F.lit(1.0)).otherwise(
            F.least(F.greatest(q, F.lit(0.0)), F.lit(1.0))).alias("quality"))


def complete_checked(df: DataFrame, method: str = "forward", max_fill_days: int | None = None,
                     threshold: float = 0.8) -> DataFrame:
    """Fill every symbol; where the share of non-null cells is below the threshold keep only the
    original rows. Every missing day gets a row, so that share is the quality."""
    done = complete(df, method, max_fill_days)
    cells = _cells(done)
    nulls = sum((F.col(c).isNull().cast("int") for c in cells[1:]), F.col(cells[0]).isNull().cast("int"))
    w = Window.partitionBy(ID)
    quality = F.lit(1.0) - F.sum(nulls).over(w) / (F.count(F.lit(1)).over(w) * F.lit(len(cells)))
    return done.withColumn("quality", quality).where(
        ~F.col("is_filled") | (F.col("quality") >= threshold))


def completion_records(df: DataFrame, method: str = "forward", max_fill_days: int | None = None,
                       threshold: float = 0.8) -> DataFrame:
    """Result record per symbol: rows before, rows added, quality, success."""
    q = fill_quality(df, complete(df, method, max_fill_days))
    return q.select(
        ID, (F.col("rows") - F.col("added")).alias("original_rows"), "expected", "added", "quality",
        (F.col("quality") >= threshold).alias("success"))


# ---------------------------------------------------------------- against a trading calendar


def missing_market_days(df: DataFrame, calendar: DataFrame) -> DataFrame:
    """Calendar days inside the data's range on which no symbol has a bar."""
    have = df.select(DATE).distinct()
    ends = have.agg(F.min(DATE).alias("a"), F.max(DATE).alias("b"))
    return calendar.select(DATE).join(have, DATE, "left_anti").where(
        F.col(DATE).between(ends.select("a").scalar(), ends.select("b").scalar()))


def missing_per_symbol(df: DataFrame, calendar: DataFrame) -> DataFrame:
    """(symbol, trading day) for every calendar day without a bar, also before the first and after
    the last one. Gaps are ranges of the day number between neighbouring bars; no symbol x day
    product is built. A row with day number 0 per symbol stands before the calendar, so that a
    symbol with bars outside trading days only misses every day."""
    last = calendar.agg(F.max("trade_seq").alias("m"))
    seqs = df.select(ID, DATE).join(beside(calendar), DATE).select(ID, "trade_seq")
    start = df.select(ID).distinct().withColumn("trade_seq", F.lit(0).cast("bigint"))
    after = F.lead("trade_seq").over(Window.partitionBy(ID).orderBy("trade_seq"))
    gaps = seqs.unionByName(start).withColumn("_n", after).withColumn("_last", last.scalar())
    stop = F.coalesce(F.col("_n"), F.col("_last") + 1) - 1
    inner = F.when(stop > F.col("trade_seq"), F.sequence(F.col("trade_seq") + 1, stop))
    return (gaps.select(ID, F.explode(inner).alias("trade_seq"))
            .join(beside(calendar), "trade_seq").select(ID, DATE))


def completeness(df: DataFrame, calendar: DataFrame, symbols: DataFrame) -> DataFrame:
    """Per expected symbol the number of missing days and their list; a symbol without any bar
    misses the whole calendar. The list is bounded by the calendar."""
    gaps = missing_per_symbol(df, calendar).groupBy(ID).agg(
        F.count(F.lit(1)).alias("missing_days"),
        F.array_join(F.array_sort(F.collect_list(F.col(DATE).cast("string"))), ",").alias("days"))
    total = calendar.agg(F.count(F.lit(1)).alias("n"))
    seen = df.select(ID).distinct().withColumn("_seen", F.lit(True))
    return (symbols.select(ID).join(seen, ID, "left").join(gaps, ID, "left")
            .withColumn("_all", total.scalar())
            .select(ID, F.col("_seen").isNull().alias("absent"),
                    F.when(F.col("_seen").isNull(), F.col("_all"))
                    .otherwise(F.coalesce("missing_days", F.lit(0))).alias("missing_days"),
                    F.col("days")))


def integrity(df: DataFrame, calendar: DataFrame, symbols: DataFrame) -> DataFrame:
    """One row: rows, days and symbols present, days and symbols missing, whether to sync all."""
    have = df.agg(F.count(F.lit(1)).alias("existing_records"),
                  F.countDistinct(DATE).alias("existing_dates"),
                  F.countDistinct(ID).alias("existing_symbols"), F.max(DATE).alias("latest_date"))
    days = calendar.select(DATE).join(df.select(DATE).distinct(), DATE, "left_anti").agg(F.count(F.lit(1)))
    syms = symbols.select(ID).join(df.select(ID).distinct(), ID, "left_anti").agg(F.count(F.lit(1)))
    return have.withColumns({
        "missing_dates": days.scalar(), "missing_symbols": syms.scalar(),
        "needs_full_sync": F.col("existing_records") == 0})


def completion_range(df: DataFrame, calendar: DataFrame, as_of: str, max_fill_days: int = 30) -> DataFrame:
    """Dates to fetch: nothing stored -> the last days; the calendar is ahead -> from the day after
    the newest bar; otherwise from the first to the last missing day (nulls when complete)."""
    latest = calendar.where(F.col(DATE) <= F.lit(as_of).cast("date")).agg(F.max(DATE).alias("d"))
    gaps = missing_market_days(df, calendar).agg(F.min(DATE).alias("a"), F.max(DATE).alias("b"))
    have, goal = F.col("_have"), F.col("_goal")
    one = df.agg(F.max(DATE).alias("_have")).withColumns({
        "_goal": F.coalesce(latest.scalar(), F.lit(as_of).cast("date")),
        "_a": gaps.select("a").scalar(), "_b": gaps.select("b").scalar()})
    return one.select(
        F.when(have.isNull(), F.date_sub(goal, max_fill_days)).when(goal > have, F.date_add(have, 1))
        .otherwise(F.col("_a")).alias("start_date"),
        F.when(have.isNull() | (goal > have), goal).otherwise(F.col("_b")).alias("end_date"))


def sync_window(df: DataFrame, calendar: DataFrame, full_days: int = 30, fallback_days: int = 7) -> DataFrame:
    """Full sync: the newest `full_days` trading days. Incremental: from the newest stored day (or
    the last `fallback_days`) to the end of the calendar."""
    ends = calendar.agg(F.max("trade_seq").alias("m"), F.max(DATE).alias("e"))

    def back(n: int) -> Column:
        """First of the newest n trading days."""
        edge = ends.select("m").scalar()
        return (calendar.where(F.col("trade_seq") > edge - F.lit(n)).agg(F.min(DATE).alias("d"))
                .scalar())

    one = df.agg(F.count(F.lit(1)).alias("_n"), F.max(DATE).alias("_have")).withColumns({
        "_full": back(full_days), "_some": back(fallback_days), "_end": ends.select("e").scalar()})
    empty = F.col("_n") == 0
    return one.select(
        F.when(empty, F.col("_full")).otherwise(F.coalesce("_have", "_some")).alias("start_date"),
        F.col("_end").alias("end_date"),
        F.when(empty, "full_sync").otherwise("incremental_sync").alias("sync_type"))


def is_roughly_complete(df: DataFrame, symbols: DataFrame, days: int = 5, share: float = 0.8) -> DataFrame:
    """Coarse report: enough rows for `days` days of every symbol (one row)."""
    n = symbols.agg(F.count(F.lit(1)).alias("s"))
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("symbols", n.scalar()).withColumn(
        "complete", F.col("rows") >= F.lit(share) * F.lit(days) * F.col("symbols"))


def top_up(df: DataFrame, fetched: DataFrame) -> DataFrame:
    """Merge the fetched rows, however many are stored; `is_roughly_complete` reports whether a fetch
    was due."""
    return merge_update(df, fetched)


def dates_without_future(df: DataFrame, as_of: str, days: int = 5) -> DataFrame:
    """Days whose day + `days` has no bars, split into ones already past and still to come."""
    have = df.select(DATE).distinct()
    later = have.select(F.date_sub(DATE, days).alias(DATE))
    target = F.date_add(F.col(DATE), days)
    return have.join(later, DATE, "left_anti").select(
        DATE, target.alias("target_date"),
        F.when(target <= F.lit(as_of).cast("date"), "past").otherwise("future").alias("kind"))


def still_missing(wanted: DataFrame, df: DataFrame) -> DataFrame:
    """How many of the wanted days are still absent (one row)."""
    left = wanted.select(DATE).distinct().join(df.select(DATE).distinct(), DATE, "left_anti")
    return left.agg(F.count(F.lit(1)).alias("missing")).withColumn("filled", F.col("missing") == 0)
