"""As-of joins, manifest tables and the incremental daily job, on the given tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barloom.functions.formulas import fundamental_ratios
from barloom.functions.numeric import rounded
from barloom.functions.reuse import little_disk, materialised, scratch_folder
from barloom.operators import indicators, sketches
from barloom.operators.asof import asof_join
from barloom.plans import daily
from barloom.plans.bindings import event_bars, instruments, symbol_code, table, trade_bars, trade_days
from barloom.plans.q_io import _PLAIN
from barloom.plans.registry import cte, query, sql
from barloom.plans.shape import shape
from barloom.plans.sqltext import full
from barloom.sources import landings, store, tables
from barloom.sources.bars import dual_adjusted

K = "order_book_id date"
KS = "order_book_id, date"

# ---------------------------------------------------------------- reports joined as of a day

cte("reports", f"""SELECT order_book_id, CAST(q + INTERVAL 3 MONTH AS DATE) + 30 AS date, RND4(a / n) AS eps, RND4(s / n) AS bvps
FROM (SELECT order_book_id, date_trunc('quarter', date) AS q, sum(floor(amount / size * 100 + 0.5)) AS a, sum(size) AS s, count(*) AS n
 FROM ticks GROUP BY 1, 2) WHERE n > 2""", "ticks")


def quarter_reports(spark: SparkSession, sf: str) -> DataFrame:
    """Per symbol and quarter with more than two trades two values, published 30 days after the quarter: whole
    cents summed, so that any order of rows gives the same sum."""
    li = table(spark, sf, "lineitem")
    quarter = F.trunc(F.col("l_shipdate").cast("date"), "quarter").alias("q")
    cents = F.floor(F.col("l_extendedprice") / F.col("l_quantity") * F.lit(100) + F.lit(0.5)).cast("double")
    one = li.groupBy("l_suppkey", quarter).agg(F.sum(cents).alias("a"), F.sum("l_quantity").alias("s"), F.count(F.lit(1)).alias("n"))
    return one.where("n > 2").select(
        symbol_code(F.col("l_suppkey")).alias("order_book_id"), F.date_add(F.add_months("q", 3), 30).alias("date"),
        rounded(F.col("a") / F.col("n"), 4).alias("eps"), rounded(F.col("s") / F.col("n"), 4).alias("bvps"))


cte("barfacts", f"""SELECT b.order_book_id, b.date, b.close, r.date AS report_date, r.eps, r.bvps FROM bars b
ASOF LEFT JOIN reports r ON b.order_book_id = r.order_book_id AND b.date >= r.date""", "bars", "reports")


@query("asof_reports", "E11 A23 I6", sql(
    f"SELECT {KS}, close, report_date, eps, bvps, RND6(close / nullif(eps, 0)) AS pe_ratio, RND6(close / nullif(bvps, 0)) AS pb_ratio FROM barfacts", "barfacts"))
def asof_reports(spark: SparkSession, sf: str) -> DataFrame:
    bars = trade_bars(spark, sf).select("order_book_id", "date", "close")
    df = fundamental_ratios(asof_join(bars, quarter_reports(spark, sf), ["order_book_id"], "date", time_out="report_date"))
    return shape(df, f"{K} close report_date eps bvps pe_ratio pb_ratio", 6, "close eps bvps")


@query("asof_tolerance", "E11 A23", sql(
    f"SELECT {KS}, close, CASE WHEN date - report_date <= 45 THEN report_date END AS report_date, CASE WHEN date - report_date <= 45 THEN eps END AS eps FROM barfacts", "barfacts"))
def asof_tolerance(spark: SparkSession, sf: str) -> DataFrame:
    bars = trade_bars(spark, sf).select("order_book_id", "date", "close")
    # short ranges: most bars take the value that an earlier range carries over
    return asof_join(bars, quarter_reports(spark, sf).drop("bvps"), ["order_book_id"], "date", tolerance_days=45, width=16,
                     time_out="report_date")


@query("asof_forward", "E11 A23", sql(
    f"""SELECT b.order_book_id, b.date, b.close, r.date AS next_report, r.eps FROM bars b
    ASOF LEFT JOIN reports r ON b.order_book_id = r.order_book_id AND b.date <= r.date""", "bars", "reports"))
def asof_forward(spark: SparkSession, sf: str) -> DataFrame:
    bars = trade_bars(spark, sf).select("order_book_id", "date", "close")
    return asof_join(bars, quarter_reports(spark, sf).drop("bvps"), ["order_book_id"], "date", direction="forward", width=32,
                     time_out="next_report")


# ---------------------------------------------------------------- tables behind a manifest

_CUT = "(SELECT max(date) FROM bars) - 400"
cte("landed", f"SELECT {KS}, close, volume FROM bars WHERE date <= {_CUT}", "bars")


def _stored_bars(spark: SparkSession, sf: str, base: str) -> DataFrame:
    """Bars up to 400 days before the newest, committed; all bars are returned."""
    bars = trade_bars(spark, sf).select("order_book_id", "date", "close", "volume")
    cut = bars.agg(F.date_sub(F.max("date"), 400).alias("d")).scalar()
    first = store.Commit(spark, base, "20240130_180000")
    first.put("bars", bars.where(F.col("date") <= cut))
    first.publish()
    return bars


def _doubled(bars: DataFrame) -> DataFrame:
    """What lands later: the newest 500 days with doubled volume, so 100 stored days are corrected."""
    cut = bars.agg(F.date_sub(F.max("date"), 500).alias("d")).scalar()
    return bars.where(F.col("date") > cut).withColumn("volume", F.col("volume") * 2)


_UPSERTED = "SELECT order_book_id, date, close, CASE WHEN date > (SELECT max(date) FROM bars) - 500 THEN volume * 2 ELSE volume END AS volume FROM bars"


@query("store_upsert", "D5 D19 A4", sql(_UPSERTED, "bars"))
def store_upsert(spark: SparkSession, sf: str) -> DataFrame:
    base = scratch_folder(spark, "store")
    bars = _stored_bars(spark, sf, base)
    second = store.Commit(spark, base, "20240131_180000")
    store.upsert(second, "bars", _doubled(bars))
    second.publish()
    return store.read(spark, base, "bars").select("order_book_id", "date", "close", "volume")


@query("store_versions", "A19 A20", sql(
    f"""SELECT 'old' AS version, {KS}, volume FROM landed WHERE date >= {_CUT} - 60
    UNION ALL SELECT 'new', {KS}, volume FROM ({_UPSERTED}) WHERE date >= {_CUT} - 60""", "bars", "landed"))
def store_versions(spark: SparkSession, sf: str) -> DataFrame:
    base = scratch_folder(spark, "store")
    bars = _stored_bars(spark, sf, base)
    second = store.Commit(spark, base, "20240131_180000")
    store.upsert(second, "bars", _doubled(bars))
    second.publish()
    start = str(bars.agg(F.date_sub(F.max("date"), 460)).first()[0])
    both = [store.read(spark, base, "bars", start=start, as_of=s).select(F.lit(v).alias("version"), "order_book_id", "date", "volume")
            for v, s in (("old", "20240130_180000"), ("new", None))]
    return both[0].unionByName(both[1])


@query("store_catalogue", "A12 A14 A19", sql(
    """SELECT 'bars' AS "table", CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT strftime(date, '%Y-%m')) AS BIGINT) AS months,
    min(date) AS first_day, max(date) AS last_day, '20240131_180000' AS stamp, CAST(2 AS BIGINT) AS versions FROM bars
    UNION ALL SELECT 'events', count(*), count(DISTINCT strftime(date, '%Y-%m')), min(date), max(date), '20240131_180000', 1 FROM ebars""", "bars", "ebars"))
def store_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    base = scratch_folder(spark, "store")
    bars = _stored_bars(spark, sf, base)
    second = store.Commit(spark, base, "20240131_180000")
    store.upsert(second, "bars", _doubled(bars))
    second.put("events", event_bars(spark, sf))
    second.publish()
    return store.tables(spark, base)


@query("store_compacted", "A15 A25", sql(
    f"SELECT {KS}, close, volume FROM landed WHERE order_book_id IN ('000003.XSHE', '000007.XSHG')", "landed"))
def store_compacted(spark: SparkSession, sf: str) -> DataFrame:
    base = scratch_folder(spark, "store")
    _stored_bars(spark, sf, base)
    again = store.Commit(spark, base, "20240131_180000")
    store.compact(again, "bars", file_rows=50_000)
    again.publish()
    store.vacuum(spark, base, "bars")
    return store.read(spark, base, "bars").where(F.col("order_book_id").isin("000003.XSHE", "000007.XSHG"))


@query("store_retained", "A16", sql(f"SELECT {KS}, close, volume FROM landed WHERE date >= {_CUT} - 200", "bars", "landed"))
def store_retained(spark: SparkSession, sf: str) -> DataFrame:
    base = scratch_folder(spark, "store")
    bars = _stored_bars(spark, sf, base)
    later = store.Commit(spark, base, "20240131_180000")
    store.drop_before(later, "bars", str(bars.agg(F.date_sub(F.max("date"), 600)).first()[0]))
    later.publish()
    store.vacuum(spark, base, "bars")
    return store.read(spark, base, "bars")


# ---------------------------------------------------------------- buckets, sketches, deliveries

_SMA5 = full("avg", "close", 5)


def _bucketed(df: DataFrame, kind: str) -> DataFrame:
    spark = df.sparkSession
    path = scratch_folder(spark, "bucketed")
    name = f"{kind}_{path[-12:]}"
    tables.save_bucketed(df, name, path, 8)
    return spark.table(name)


@query("bucketed_sma", "A3 A4 G1", sql(f"SELECT {KS}, close, RND4({_SMA5}) AS sma_5 FROM bars", "bars"))
def bucketed_sma(spark: SparkSession, sf: str) -> DataFrame:
    bars = _bucketed(trade_bars(spark, sf).select("order_book_id", "date", "close"), "bars")
    return shape(indicators.sma(bars, (5,)), f"{K} close sma_5", 4, "close")


@query("bucketed_dual_adjust", "A3 A4 E4", sql(f"SELECT {KS}, close, close / 2 AS close_pre FROM bars", "bars"))
def bucketed_dual_adjust(spark: SparkSession, sf: str) -> DataFrame:
    bars = trade_bars(spark, sf).select("order_book_id", "date", "close")
    post, pre = _bucketed(bars, "post"), _bucketed(bars.withColumn("close", F.col("close") / 2), "pre")
    return dual_adjusted(post, pre)


@query("many_symbols", "A25", sql(f"""SELECT {KS}, close FROM landed WHERE order_book_id IN
 (SELECT order_book_id FROM instruments WHERE market_cap > 0) AND order_book_id <> '000003.XSHE'""", "landed", "instruments"))
def many_symbols(spark: SparkSession, sf: str) -> DataFrame:
    base = scratch_folder(spark, "lake")
    bars = trade_bars(spark, sf).select("order_book_id", "date", "close")
    tables.save_table(bars, base, "bars")
    wanted = [r[0] for r in instruments(spark, sf).where("market_cap > 0").select("order_book_id").collect()]  # the list of a user
    cut = str(bars.agg(F.date_sub(F.max("date"), 400)).first()[0])
    return tables.load_market_data(spark, base, [s for s in wanted if s != "000003.XSHE"], end=cut)


_PROFILED = ("close", "volume", "order_book_id")


@query("sketched_files", "A29 F36", sql(" UNION ALL ".join(
    f"""SELECT '{c}' AS "column", CAST(count(*) AS BIGINT) AS rows, count(*) FILTER ({c} IS NULL) AS nulls, {e} AS low, {h} AS high,
    CAST(count(DISTINCT {c}) AS BIGINT) AS exact_distinct, true AS distinct_near, true AS median_near FROM bars"""
    for c, e, h in (("close", "min(close)", "max(close)"), ("volume", "min(volume)", "max(volume)"),
                    ("order_book_id", "CAST(NULL AS DOUBLE)", "CAST(NULL AS DOUBLE)"))), "bars"))
def sketched_files(spark: SparkSession, sf: str) -> DataFrame:
    """Files of even years are sketched first, then those of the others; the united sketches beside exact values: distinct
    counts within four standard deviations, and the rank of the median within the stated error."""
    base = scratch_folder(spark, "drops")
    bars = trade_bars(spark, sf).select("order_book_id", "date", "close", "volume").withColumn("year", F.year("date"))
    bars.write.partitionBy("year").parquet(f"{base}/bars")
    sketches.sketch_new_files(spark, f"{base}/bars/year=???[02468]/*.parquet", f"{base}/sketches", _PROFILED)
    sketches.sketch_new_files(spark, f"{base}/bars/year=*/*.parquet", f"{base}/sketches", _PROFILED)
    found = sketches.united(spark, f"{base}/sketches")
    back = spark.read.parquet(f"{base}/bars")
    middle = found.groupBy().agg(*[F.max(F.when(F.col("column") == c, F.col("p50"))).alias(c) for c in ("close", "volume")])
    m = middle.select(F.struct("close", "volume").alias("m")).scalar()
    exact = back.withColumn("m", m).agg(
        *[F.countDistinct(c).alias(f"d_{c}") for c in _PROFILED],
        *[F.avg((F.col(c) <= F.col(f"m.{c}")).cast("double")).alias(f"at_{c}") for c in ("close", "volume")],
        *[F.avg((F.col(c) < F.col(f"m.{c}")).cast("double")).alias(f"below_{c}") for c in ("close", "volume")])
    rank = lambda c: (F.col(f"below_{c}") <= 0.5 + sketches.RANK_ERROR) & (F.col(f"at_{c}") >= 0.5 - sketches.RANK_ERROR)
    one = exact.select(F.inline(F.array(*[F.struct(
        F.lit(c).alias("column"), F.col(f"d_{c}").alias("exact_distinct"),
        (rank(c) if c != "order_book_id" else F.lit(True)).alias("median_near")) for c in _PROFILED])))
    near = F.abs(F.col("distinct") - F.col("exact_distinct")) <= 4 * sketches.DISTINCT_ERROR * F.col("exact_distinct")
    return found.join(one, "column").select(
        "column", "rows", "nulls", "low", "high", "exact_distinct", near.alias("distinct_near"), "median_near")


@query("bars_landed", "A28", sql("SELECT * FROM ebars", "ebars"))
def bars_landed(spark: SparkSession, sf: str) -> DataFrame:
    """Every third event lands late, one delivery is sent twice."""
    base = scratch_folder(spark, "landed")
    events = table(spark, sf, "events").select("user_id", "ts", "event_id", "value", F.lit(1.0).alias("one"))
    late = F.col("event_id") % 3 == 0
    for k, (name, part) in enumerate((("first", events.where(~late)), ("late", events.where(late)), ("first", events.where(~late)))):
        commit = store.Commit(spark, base, f"2024013{k}_180000")
        landings.land(commit, name, landings.partial_bars(part, "user_id", "ts", "value", "one", "value", ["ts", "event_id"])
                      .withColumn("order_book_id", symbol_code(F.col("order_book_id"))))
        commit.publish()
    return landings.finished(store.read(spark, base, "partial_bars"))


# ---------------------------------------------------------------- the daily job

cte("members", """SELECT order_book_id FROM instruments WHERE status = 'Active' AND NOT regexp_matches(order_book_id, 'XHKG')
 AND NOT regexp_matches(symbol, 'ST|PT|\\*')""", "instruments")
_DAILY = f"""SELECT s.order_book_id, s.date, s.trend_score, s.capital_score - s.score_institution + 1 AS capital_score,
 RND4(least(greatest(least(greatest({_PLAIN}, 0), 100) * s.factor, 0), 100)) AS composite_score, f.report_date, f.eps,
 RND4(s.close / nullif(f.eps, 0)) AS pe_ratio, CAST({{warnings}} AS BIGINT) AS _data_quality_warnings, CAST({{count}} AS BIGINT) AS _calculation_count
FROM scored3 s JOIN barfacts f USING (order_book_id, date) {{more}} WHERE s.order_book_id IN (SELECT order_book_id FROM members)"""
# one warning, of the industry that the scorer does not list, where a scored member has it
_ODD = "(SELECT max(CASE WHEN industry = '综合' THEN 1 ELSE 0 END) FROM {rows} JOIN instruments USING (order_book_id) WHERE order_book_id IN (SELECT order_book_id FROM members))"
_COLUMNS = f"{K} trend_score capital_score composite_score report_date eps pe_ratio _data_quality_warnings _calculation_count"
EVERY_DAY = 1_000_000


def _rounded(df: DataFrame) -> DataFrame:
    return shape(df, _COLUMNS, 4, "eps")


@query("daily_full_run", "L3 A20 E1 E11 H17", sql(
    _DAILY.format(warnings=_ODD.format(rows="bars"), count="1", more=""), "scored3", "barfacts", "members", "bars"))
def daily_full_run(spark: SparkSession, sf: str) -> DataFrame:
    base = scratch_folder(spark, "daily")
    days = materialised(trade_days(spark, sf))  # read several times
    daily.update(spark, base, trade_bars(spark, sf), instruments(spark, sf), days, quarter_reports(spark, sf),
                 "20240131_180000", full_days=EVERY_DAY)
    return _rounded(store.read(spark, base, "scores"))


cte("since", f"""SELECT order_book_id, min(date) AS since FROM (SELECT {KS} FROM bars UNION ALL SELECT {KS} FROM reports)
 WHERE date > {_CUT} GROUP BY 1""", "bars", "reports")
_LATER = "(SELECT * FROM bars JOIN since USING (order_book_id) WHERE bars.date >= since)"


@query("daily_incremental", "L3 L2 D17 D18 D19 A20 H17 J7", sql(
    _DAILY.format(
        warnings=f"CASE WHEN s.date >= n.since THEN {_ODD.format(rows=_LATER)} ELSE {_ODD.format(rows='landed')} END",
        count="CASE WHEN s.date >= n.since THEN 2 ELSE 1 END", more="LEFT JOIN since n ON n.order_book_id = s.order_book_id"),
    "scored3", "barfacts", "members", "bars", "landed", "since"))
def daily_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs, the second with 400 more days: the same scores as one run over everything."""
    base = scratch_folder(spark, "daily")
    with little_disk(spark) as copied:
        # both runs read what the trades give, so that is made once
        bars, reports, days = (copied(make(spark, sf)) for make in (trade_bars, quarter_reports, trade_days))
        listed = instruments(spark, sf)
        cut = days.agg(F.date_sub(F.max("date"), 400).alias("d")).scalar()  # the days of the bars

        def before(df: DataFrame) -> Column:
            return df.where(F.col("date") <= cut)

        daily.update(spark, base, before(bars), listed, days, before(reports), "20240130_180000", full_days=EVERY_DAY)
        daily.update(spark, base, bars, listed, days, reports, "20240131_180000", full_days=EVERY_DAY)
    return _rounded(store.read(spark, base, "scores"))
