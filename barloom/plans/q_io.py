"""Files, named tables, snapshots and whole jobs: written to the shared folder and read back."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from barloom.functions.reuse import little_disk, scratch_folder
from barloom.operators import indicators as ind
from barloom.plans import jobs, q_research  # noqa: F401  (SQL pieces of the study are used here)
from barloom.plans.bindings import (
    event_bars, event_days, factors_long, instruments, trade_bars, trade_days)
from barloom.plans.q_data import _stored, factor_pivot
from barloom.plans.registry import cte, query, sql
from barloom.plans.shape import shape
from barloom.sources import bars as bar_source, calendar, tables

KS = "order_book_id, date"
BAR_SCHEMA = "order_book_id string, date date, close double, volume double"


def _small(spark: SparkSession, sf: str) -> DataFrame:
    return event_bars(spark, sf).select("order_book_id", "date", "close", "volume")


@query("file_formats", "A1 A2 A11", sql(" UNION ALL ".join(
    f"SELECT '{f}' AS format, {KS}, close, volume FROM ebars" for f in ("parquet", "csv", "json")), "ebars"))
def file_formats(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for fmt in ("parquet", "csv", "json"):
        path = f"{scratch_folder(spark, 'files')}/bars.{fmt}"
        tables.save(_small(spark, sf), path)
        back = tables.load(spark, path, BAR_SCHEMA).select(
            F.lit(fmt).alias("format"), "order_book_id", "date", "close", "volume")
        out = back if out is None else out.unionByName(back)
    return out


@query("table_partitioned", "A3 A4 A5 A6 A25", sql(
    f"SELECT {KS}, close, strftime(date, '%Y-%m') AS month FROM bars WHERE date BETWEEN DATE '1996-03-10' AND DATE '1999-08-20'", "bars"))
def table_partitioned(spark: SparkSession, sf: str) -> DataFrame:
    base = scratch_folder(spark, "lake")
    bars = trade_bars(spark, sf).withColumn("month", F.date_format("date", "yyyy-MM"))
    tables.save_table(bars, base, "bars", partition_by=["month"])
    return tables.route(spark, {"symbols": None, "start": "1996-03-10", "end": "1999-08-20"}, base).select(
        "order_book_id", "date", "close", F.col("month").cast("string").alias("month"))


@query("table_join_types", "A25 E2", sql(f"SELECT {KS}, close, view FROM ebars FULL JOIN wide USING (order_book_id, date)", "ebars", "wide"))
def table_join_types(spark: SparkSession, sf: str) -> DataFrame:
    base = scratch_folder(spark, "lake")
    tables.save_table(_small(spark, sf), base, "bars")
    tables.save_table(factor_pivot(spark, sf), base, "factors")
    df = tables.route(spark, {"data_types": ["bars", "factors"]}, base)
    return df.select("order_book_id", "date", "close", "view")


@query("table_facts", "A12 A13 A14", sql(
    "SELECT 'bars' AS \"table\", CAST(count(*) AS BIGINT) AS rows, 4 AS columns, 'order_book_id:string,date:date,close:double,volume:double' AS types, 'bars' AS listed FROM ebars", "ebars"))
def table_facts(spark: SparkSession, sf: str) -> DataFrame:
    base = scratch_folder(spark, "lake")
    tables.save_table(_small(spark, sf), base, "bars")
    tables.record_metadata(spark, base, "bars")
    listed = ",".join(tables.list_tables(spark, base))
    return tables.latest_metadata(spark, base).select("table", "rows", "columns", "types", F.lit(listed).alias("listed"))


@query("table_compacted", "A15", sql(f"SELECT {KS}, close, volume FROM ebars", "ebars"))
def table_compacted(spark: SparkSession, sf: str) -> DataFrame:
    base = scratch_folder(spark, "lake")
    tables.save_table(_small(spark, sf).repartition(16), base, "bars")
    return spark.read.parquet(tables.compact(spark, base, "bars"))


@query("json_table", "A17", sql(f"SELECT {KS}, close, volume FROM ebars", "ebars"))
def json_table(spark: SparkSession, sf: str) -> DataFrame:
    base = scratch_folder(spark, "lake")
    _small(spark, sf).write.json(f"{base}/landed")
    tables.json_to_table(spark, f"{base}/landed", base, "bars", lines=True)
    return tables.load_table(spark, base, "bars").select(
        "order_book_id", F.col("date").cast("date").alias("date"), "close", "volume")


@query("trading_dates_json", "A27", sql("SELECT * FROM cal", "cal"))
def trading_dates_json(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{scratch_folder(spark, 'dates')}/days"
    year = event_days(spark, sf).groupBy(F.year("date")).agg(  # a list is bounded by the days of a year
        F.to_json(F.sort_array(F.collect_list(F.col("date").cast("string")))).alias("value"))
    year.select("value").write.text(path)
    return calendar.read_trading_dates(spark, path, lines=True)


@query("table_symbols", "A25 A6", sql(
    f"SELECT {KS}, close FROM bars WHERE order_book_id IN ('000003.XSHE', '000007.XSHG', '000008.XHKG')", "bars"))
def table_symbols(spark: SparkSession, sf: str) -> DataFrame:
    base = scratch_folder(spark, "lake")
    tables.save_table(trade_bars(spark, sf), base, "bars")
    wanted = ["000003.XSHE", "000007.XSHG", "000008.XHKG"]
    return tables.route(spark, {"symbols": wanted, "start": None, "end": None}, base).select("order_book_id", "date", "close")


@query("table_retained", "A16", sql(f"SELECT {KS}, close, volume FROM ebars WHERE date >= DATE '2024-01-30' - 10", "ebars"))
def table_retained(spark: SparkSession, sf: str) -> DataFrame:
    base = scratch_folder(spark, "retained")
    tables.save_table(_small(spark, sf), base, "bars", partition_by=["date"])
    tables.drop_expired(spark, base, "bars", 10, "2024-01-30")
    return tables.load_table(spark, base, "bars")


@query("clean_files", "A18", sql(
    f"SELECT {KS}, close, CAST(volume AS DOUBLE) AS volume FROM bars UNION ALL SELECT {KS}, close, volume FROM ebars UNION ALL SELECT {KS}, close, volume FROM ebars WHERE volume > 2", "bars", "ebars"))
def clean_files(spark: SparkSession, sf: str) -> DataFrame:
    base = scratch_folder(spark, "batch")
    cols = ["order_book_id", "date", "close", "volume"]
    events = event_bars(spark, sf)
    for name, df in (("trades", trade_bars(spark, sf)), ("events", events), ("again", events.where("volume > 2"))):
        text = df.select("order_book_id", "date", "close", F.col("volume").cast("string").alias("volume"))
        text.write.parquet(f"{base}/{name}.parquet")
    tables.clean_files(spark, [f"{base}/{n}.parquet" for n in ("trades", "events", "again")], f"{base}/out", ["volume"])
    return spark.read.parquet(f"{base}/out").select(*cols)


@query("snapshots", "A19 A20", sql(f"SELECT {KS}, close, '20240131_180000' AS snapshot_ts FROM ebars WHERE volume > 2", "ebars"))
def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    base = scratch_folder(spark, "lake")
    small = _small(spark, sf)
    tables.write_snapshot(small, base, "scores", "20240130_180000")
    tables.write_snapshot(small.where("volume > 2"), base, "scores", "20240131_180000")
    return tables.latest_snapshot(spark, base, "scores").select("order_book_id", "date", "close", "snapshot_ts")


@query("latest_file", "A19", sql(f"SELECT {KS}, close, volume FROM ebars WHERE volume > 3", "ebars"))
def latest_file(spark: SparkSession, sf: str) -> DataFrame:
    base = scratch_folder(spark, "drops")
    small = _small(spark, sf)
    small.write.parquet(f"{base}/scores_20240130_090000.parquet")
    small.where("volume > 3").write.parquet(f"{base}/scores_20240131_090000.parquet")
    return tables.latest_file(spark, f"{base}/scores_*.parquet")


@query("file_profiles", "A29", sql(
    "SELECT 'all' AS kind, CAST(count(*) AS BIGINT) AS rows, CAST(count(*) AS BIGINT) AS with_id, coalesce(bool_or(order_book_id = '000007.XSHG'), false) AS has_symbol FROM ebars "
    "UNION ALL SELECT 'busy', count(*), count(*) FILTER (close > 10), coalesce(bool_or(CASE WHEN close > 10 THEN order_book_id END = '000007.XSHG'), false) FROM ebars WHERE volume > 3", "ebars"))
def file_profiles(spark: SparkSession, sf: str) -> DataFrame:
    base = scratch_folder(spark, "drops")
    small = _small(spark, sf)
    small.write.parquet(f"{base}/all.parquet")
    small.where("volume > 3").withColumn(
        "order_book_id", F.when(F.col("close") > 10, F.col("order_book_id"))).write.parquet(f"{base}/busy.parquet")
    per = tables.profile_files(spark, f"{base}/*.parquet", "000007.XSHG")
    kind = F.regexp_extract("file", r"/(all|busy)\.parquet/", 1)
    return per.groupBy(kind.alias("kind")).agg(
        F.sum("rows").alias("rows"), F.sum("with_id").alias("with_id"), F.bool_or("has_symbol").alias("has_symbol"))


@query("vendor_bars", "A22", sql(
    f"SELECT {KS}, close, CASE WHEN trades > 3 THEN NULL ELSE CAST(volume AS BIGINT) END AS volume, amount, '1d' AS _frequency, 'post' AS _adjust_type FROM ebars", "ebars"))
def vendor_bars(spark: SparkSession, sf: str) -> DataFrame:
    raw = event_bars(spark, sf).select(
        "order_book_id", F.concat(F.col("date").cast("string"), F.lit(" 00:00:00")).alias("datetime"),
        F.col("close").cast("string").alias("close"),
        F.when(F.col("trades") > 3, "n/a").otherwise(F.col("trades").cast("string")).alias("volume"),
        F.col("amount").alias("total_turnover"))
    df = bar_source.normalise_vendor_bars(raw, "post")
    return df.select("order_book_id", "date", "close", "volume", "amount", "_frequency", "_adjust_type")


# ---------------------------------------------------------------- whole jobs

# without order-size share, industry and size: that sub-score is 1 and no factor applies
_PLAIN = "trend_score * 0.45e0 + (capital_score - score_institution + 1) * 0.24e0 + technical_score * 0.18e0 + risk_score * 0.15e0"


@query("stock_analysis", "L1 B9", sql(f"SELECT {KS}, trend_score, risk_score, RND4({_PLAIN}) AS composite_score FROM scored2", "scored2"))
def stock_analysis(spark: SparkSession, sf: str) -> DataFrame:
    base = scratch_folder(spark, "job")
    with little_disk(spark):
        trade_bars(spark, sf).write.option("compression", "zstd").parquet(f"{base}/bars.parquet")
    jobs.analyse(spark, f"{base}/bars.parquet", out=f"{base}/scores.parquet")
    back = tables.load(spark, f"{base}/scores.parquet")
    return shape(back, "order_book_id date trend_score risk_score composite_score")


@query("data_sync", "L2 C2 D17 D18 D19", sql(
    f"""SELECT e.order_book_id, e.date, CASE WHEN f.order_book_id IS NOT NULL THEN e.close * 2 ELSE e.close END AS close FROM ebars e
    LEFT JOIN (SELECT * FROM ebars WHERE date >= (SELECT max(date) FROM stored) AND order_book_id IN (SELECT order_book_id FROM instruments WHERE status = 'Active'
      AND NOT regexp_matches(order_book_id, 'XHKG') AND NOT regexp_matches(symbol, 'ST|PT|\\*'))) f ON f.order_book_id = e.order_book_id AND f.date = e.date
    LEFT JOIN stored s ON s.order_book_id = e.order_book_id AND s.date = e.date WHERE f.order_book_id IS NOT NULL OR s.order_book_id IS NOT NULL""", "ebars", "stored", "instruments"))
def data_sync(spark: SparkSession, sf: str) -> DataFrame:
    cols = ["order_book_id", "date", "close"]
    landed = event_bars(spark, sf).select(*cols).withColumn("close", F.col("close") * 2)
    merged, _ = jobs.sync(_stored(spark, sf).select(*cols), landed, instruments(spark, sf), event_days(spark, sf))
    return merged


@query("factor_sync", "L4", sql(f"SELECT {KS}, click, view FROM (SELECT * FROM wide WHERE click IS NOT NULL OR view IS NOT NULL)", "wide"))
def factor_sync(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.sync_factors(factors_long(spark, sf), ["click", "view"])


@query("signal_study", "L5 F13 F14 F15 F16", sql(q_research.CORRELATIONS, "ptail", "spears", "spearman_tail"))
def signal_study(spark: SparkSession, sf: str) -> DataFrame:
    """The job over the indicators of the catalogue, all that have a category."""
    b = trade_bars(spark, sf)
    wanted = [c for cols in q_research.CATEGORIES.values() for c in cols]
    scores = ind.calculate_indicators(b).select("order_book_id", "date", "close", *wanted)
    df = jobs.signal_study(scores, None, trade_days(spark, sf), 5, q_research.CATEGORIES)
    return shape(df, "category indicator n pearson pearson_p spearman spearman_p stars", 6)
