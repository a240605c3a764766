"""Cleaning, completion, calendar, joins, quality, schema and SQL queries over the given tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barloom.functions.numeric import rounded
from barloom.operators import clean, complete, indicators as ind, joins, pools, quality, schema
from barloom.plans.bindings import (
    FACTOR_NAMES, INDUSTRIES, code_sql, event_bars, event_days, factors_long, instruments, symbol_code, table,
    trade_bars, trade_ticks)
from barloom.plans.q_indicators import scored_bars
from barloom.plans.registry import cte, query, sql
from barloom.plans.shape import shape
from barloom.plans.sqltext import full, lag, rnd
from barloom.sources import bars as bar_source, calendar as cal, tables

K = "order_book_id date"
KS = "order_book_id, date"
OHLCV = "open high low close volume amount"

# ---------------------------------------------------------------- instruments, universe, factors


@query("instruments", "A8 A21", sql("SELECT * FROM instruments", "instruments"))
def q_instruments(spark: SparkSession, sf: str) -> DataFrame:
    return instruments(spark, sf)


@query("instruments_filled", "A21 C14", sql(
    """SELECT order_book_id, symbol, exchange, type, status, '1990-01-01' AS listed_date, '' AS de_listed_date, '' AS sector_code,
    '' AS industry_code, '' AS board_type, 'landed' AS _data_source, (SELECT count(*) FROM instruments) AS _total FROM instruments""", "instruments"))
def instruments_filled(spark: SparkSession, sf: str) -> DataFrame:
    raw = instruments(spark, sf).drop("industry", "market_cap")
    full_rows = bar_source.normalise_instruments(raw)
    return clean.with_provenance(full_rows, {}, total="_total")


@query("universe_filter", "C2", sql(
    r"""SELECT order_book_id, symbol, status FROM instruments WHERE status = 'Active'
    AND regexp_matches(order_book_id, '\.(XSHG|XSHE)$') AND NOT regexp_matches(symbol, 'ST|PT|\*')""", "instruments"))
def universe_filter(spark: SparkSession, sf: str) -> DataFrame:
    return clean.universe(instruments(spark, sf)).select("order_book_id", "symbol", "status")


@query("factors_by_name", "A7", sql("SELECT * FROM factors WHERE factor_name IN ('click', 'view')", "factors"))
def factors_by_name(spark: SparkSession, sf: str) -> DataFrame:
    return joins.select_factors(factors_long(spark, sf), ["click", "view"])


_WIDE = ", ".join(f"max(CASE WHEN factor_name = '{n}' THEN factor_value END) AS {n}" for n in FACTOR_NAMES)
cte("wide", f"SELECT {KS}, {_WIDE} FROM factors GROUP BY {KS}", "factors")


@query("factor_pivot", "A23 A24 L4", sql("SELECT * FROM wide", "wide"))
def factor_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return joins.wide_factors(factors_long(spark, sf), FACTOR_NAMES)


@query("factor_fields", "A24", sql(f"SELECT {KS}, click, purchase, CAST(NULL AS DOUBLE) AS refund FROM wide", "wide"))
def factor_fields(spark: SparkSession, sf: str) -> DataFrame:
    return joins.select_fields(factor_pivot(spark, sf), ["click", "purchase", "refund"])


# ---------------------------------------------------------------- filters and projections


@query("date_range", "C1 A6 B13", sql(
    f"SELECT {KS}, close FROM bars WHERE date BETWEEN DATE '1997-01-01' AND DATE '1998-06-30'", "bars"))
def q_date_range(spark: SparkSession, sf: str) -> DataFrame:
    return clean.date_range(trade_bars(spark, sf), "1997-01-01", "1998-06-30").select("order_book_id", "date", "close")


@query("completed_days", "C17", sql(f"SELECT {KS}, close FROM bars WHERE date < DATE '2000-01-01'", "bars"))
def completed_days(spark: SparkSession, sf: str) -> DataFrame:
    return clean.completed_only(trade_bars(spark, sf), "2000-01-01").select("order_book_id", "date", "close")


@query("abnormal_filter", "C8", sql(
    f"SELECT {KS}, open, high, low, close FROM bars WHERE least(open, high, low, close) >= 0.1e0 AND greatest(open, high, low, close) <= 10000", "bars"))
def abnormal_filter(spark: SparkSession, sf: str) -> DataFrame:
    return clean.drop_abnormal(trade_bars(spark, sf)).select("order_book_id", "date", "open", "high", "low", "close")


@query("abnormal_removed", "C8", sql(
    """SELECT order_book_id, CAST(count(*) AS BIGINT) AS bad_rows, concat_ws(',',
      max(CASE WHEN open < 0.1e0 OR open > 10000 THEN 'open' END), max(CASE WHEN high < 0.1e0 OR high > 10000 THEN 'high' END),
      max(CASE WHEN low < 0.1e0 OR low > 10000 THEN 'low' END), max(CASE WHEN close < 0.1e0 OR close > 10000 THEN 'close' END)) AS columns
    FROM bars WHERE least(open, high, low, close) < 0.1e0 OR greatest(open, high, low, close) > 10000 GROUP BY order_book_id""", "bars"))
def abnormal_removed(spark: SparkSession, sf: str) -> DataFrame:
    return clean.removed_symbols(trade_bars(spark, sf))


@query("finite_filter", "C7", sql(f"SELECT {KS}, RND6(volume_ratio) AS volume_ratio FROM ind WHERE volume_ratio > 0", "ind"))
def finite_filter(spark: SparkSession, sf: str) -> DataFrame:
    return shape(clean.finite_only(ind.volume_ratio(trade_bars(spark, sf)), "volume_ratio", True), f"{K} volume_ratio", 6)


@query("rsi_valid", "C12", sql(
    f"SELECT {KS}, {rnd('rsi_6 rsi_10 rsi_14')} FROM ind WHERE rsi_6 BETWEEN 0 AND 100 AND rsi_10 BETWEEN 0 AND 100 AND rsi_14 BETWEEN 0 AND 100", "ind"))
def rsi_valid(spark: SparkSession, sf: str) -> DataFrame:
    return shape(clean.valid_rsi(ind.rsi(trade_bars(spark, sf), (6, 10, 14))), f"{K} rsi_6 rsi_10 rsi_14")


@query("steep_cohort", "C13", sql(
    f"""SELECT {KS}, RND4(ma10_angle) AS ma10_angle FROM (SELECT *, max(CASE WHEN ma10_angle <> 0 THEN date END) OVER () AS last_day FROM ind)
    WHERE ma10_angle > 1 AND date BETWEEN last_day - 30 AND last_day""", "ind"))
def steep_cohort(spark: SparkSession, sf: str) -> DataFrame:
    return shape(clean.steep_slopes(ind.ma_angles(trade_bars(spark, sf), (10,))), f"{K} ma10_angle")


@query("casts", "C3 C4 C5 C6 J11", sql(
    f"""SELECT {KS}, close, TRY_CAST(CASE WHEN close > 50 THEN 'n/a' ELSE CAST(volume AS VARCHAR) END AS DOUBLE) AS volume,
    CAST(CAST(floor(open) AS FLOAT) AS DOUBLE) AS open FROM ebars""", "ebars"))
def casts(spark: SparkSession, sf: str) -> DataFrame:
    text = F.when(F.col("close") > 50, "n/a").otherwise(F.col("volume").cast("string"))
    df = event_bars(spark, sf).withColumns({
        "volume": text, "date": F.col("date").cast("string"), "open": F.floor("open").cast("double")})
    df = clean.to_floats(clean.to_doubles(clean.parse_dates(df), ["volume"]), ["open"])
    df = clean.reorder(df, ["order_book_id", "date", "close"])
    return df.select("order_book_id", "date", "close", "volume", F.col("open").cast("double").alias("open"))


@query("standard_names", "J10", sql(f"SELECT {KS}, volume, amount FROM ebars", "ebars"))
def q_standard_names(spark: SparkSession, sf: str) -> DataFrame:
    df = event_bars(spark, sf).withColumnsRenamed(
        {"order_book_id": "code", "date": "trade_date", "volume": "vol", "amount": "turnover"})
    return clean.standard_names(df).select("order_book_id", "date", "volume", "amount")


@query("align_schema", "C16 E8", sql(
    f"SELECT {KS}, close, CAST(NULL AS DOUBLE) AS vwap, CAST(NULL AS VARCHAR) AS note FROM ebars UNION ALL SELECT {KS}, close, NULL, NULL FROM bars",
    "bars", "ebars"))
def align_schema(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import types as T

    target = T.StructType.fromDDL("order_book_id string, date date, close double, vwap double, note string")
    return joins.union_rows(clean.align(event_bars(spark, sf), target), clean.align(trade_bars(spark, sf), target))


# ---------------------------------------------------------------- nulls, duplicates, merging

cte("li", f"""SELECT {code_sql('l_suppkey')} AS order_book_id, CAST(l_shipdate AS DATE) AS date, l_orderkey AS k1, l_linenumber AS k2,
 l_partkey AS k3, l_extendedprice AS amount, l_quantity AS size FROM lineitem""")


def _trade_rows(spark: SparkSession, sf: str) -> DataFrame:
    t = trade_ticks(spark, sf)
    return t.select(symbol_code(F.col("order_book_id")).alias("order_book_id"), "date",
                    F.col("l_orderkey").alias("k1"), F.col("l_linenumber").alias("k2"),
                    F.col("l_partkey").alias("k3"), "amount", "size")


_DEDUP = "row_number() OVER (PARTITION BY order_book_id, date ORDER BY k1 {d}, k2 {d}, k3 {d}, amount {d}, size {d})"


@query("dedup_last", "D3", sql(f"SELECT * FROM li QUALIFY {_DEDUP.format(d='DESC')} = 1", "li"))
def dedup_last(spark: SparkSession, sf: str) -> DataFrame:
    return clean.dedup(_trade_rows(spark, sf), ["k1", "k2", "k3", "amount", "size"])


@query("dedup_first", "D1 D2", sql(f"SELECT * FROM li QUALIFY {_DEDUP.format(d='ASC')} = 1", "li"))
def dedup_first(spark: SparkSession, sf: str) -> DataFrame:
    return clean.clean(_trade_rows(spark, sf), ["k1", "k2", "k3", "amount", "size"])


@query("duplicate_keys", "D4 J9", sql(
    "SELECT CAST(count(*) AS BIGINT) AS duplicated_keys, CAST(sum(n - 1) AS BIGINT) AS extra_rows FROM (SELECT count(*) AS n FROM li GROUP BY order_book_id, date HAVING count(*) > 1)", "li"))
def q_duplicate_keys(spark: SparkSession, sf: str) -> DataFrame:
    return clean.duplicate_keys(_trade_rows(spark, sf))


@query("key_violations", "J9", sql(
    f"SELECT {KS}, 'view' AS factor_name, CAST(count(*) AS BIGINT) AS n FROM ticks GROUP BY {KS} HAVING count(*) > 1", "ticks"))
def q_key_violations(spark: SparkSession, sf: str) -> DataFrame:
    rows = _trade_rows(spark, sf).withColumn("factor_name", F.lit("view"))
    return schema.key_violations(rows, schema.TABLES["factors"])


@query("drop_null_rows", "D1", sql(f"SELECT {KS}, click, error, purchase, signup, view FROM wide WHERE click IS NOT NULL AND error IS NOT NULL AND purchase IS NOT NULL AND signup IS NOT NULL AND view IS NOT NULL", "wide"))
def q_drop_null_rows(spark: SparkSession, sf: str) -> DataFrame:
    return clean.drop_null_rows(factor_pivot(spark, sf))


@query("merge_update", "D5 D19 E8", sql(
    f"""SELECT {KS}, CASE WHEN date >= DATE '2000-01-01' THEN RND4(close * 2) ELSE close END AS close FROM bars""", "bars"))
def q_merge_update(spark: SparkSession, sf: str) -> DataFrame:
    old = trade_bars(spark, sf).select("order_book_id", "date", "close").where(F.col("date") < "2000-06-01")
    new = trade_bars(spark, sf).where(F.col("date") >= "2000-01-01").select(
        "order_book_id", "date", rounded(F.col("close") * 2, 4).alias("close"))
    return clean.merge_update(old, new)


# ---------------------------------------------------------------- completion of event bars

cte("miss", f"""
SELECT order_book_id, CAST(d AS DATE) AS date FROM (SELECT order_book_id, unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS d
  FROM ebars GROUP BY order_book_id HAVING count(*) >= 2) WHERE isodow(d) < 6
EXCEPT SELECT {KS} FROM ebars""", "ebars")
cte("filled_f", f"""
SELECT m.order_book_id, m.date, e.open, e.close, e.volume, e.trades, true AS is_filled FROM miss m JOIN ebars e ON e.order_book_id = m.order_book_id
  AND e.date = (SELECT max(x.date) FROM ebars x WHERE x.order_book_id = m.order_book_id AND x.date < m.date)
UNION ALL SELECT {KS}, open, close, volume, trades, false FROM ebars""", "miss", "ebars")
cte("filled_b", f"""
SELECT m.order_book_id, m.date, e.open, e.close, e.volume, e.trades, true AS is_filled FROM miss m JOIN ebars e ON e.order_book_id = m.order_book_id
  AND e.date = (SELECT min(x.date) FROM ebars x WHERE x.order_book_id = m.order_book_id AND x.date > m.date)
UNION ALL SELECT {KS}, open, close, volume, trades, false FROM ebars""", "miss", "ebars")


def _slim(spark: SparkSession, sf: str) -> DataFrame:
    return event_bars(spark, sf).select("order_book_id", "date", "open", "close", "volume", "trades")


@query("missing_dates", "D6", sql("SELECT * FROM miss", "miss"))
def q_missing_dates(spark: SparkSession, sf: str) -> DataFrame:
    return complete.missing_dates(event_bars(spark, sf))


@query("missing_dates_capped", "D6", sql(
    "SELECT m.* FROM miss m JOIN (SELECT order_book_id, min(date) AS f FROM ebars GROUP BY 1) USING (order_book_id) WHERE m.date <= f + 10", "miss", "ebars"))
def missing_dates_capped(spark: SparkSession, sf: str) -> DataFrame:
    return complete.missing_dates(event_bars(spark, sf), 10)


@query("ffill", "D7 E11", sql("SELECT * FROM filled_f", "filled_f"))
def ffill(spark: SparkSession, sf: str) -> DataFrame:
    return complete.complete(_slim(spark, sf), "forward")


@query("bfill", "D8 E11", sql("SELECT * FROM filled_b", "filled_b"))
def bfill(spark: SparkSession, sf: str) -> DataFrame:
    return complete.complete(_slim(spark, sf), "backward")


@query("midpoint_fill", "D9 D13", sql(
    f"""SELECT {KS}, RND4((f.open + b.open) / 2) AS open, RND4((f.close + b.close) / 2) AS close, RND4((f.volume + b.volume) / 2) AS volume,
    CAST(trunc((f.trades + b.trades) / 2) AS BIGINT) AS trades, f.is_filled FROM filled_f f JOIN filled_b b USING (order_book_id, date)""", "filled_f", "filled_b"))
def midpoint_fill(spark: SparkSession, sf: str) -> DataFrame:
    return shape(complete.complete(_slim(spark, sf), "linear"), f"{K} open close volume trades is_filled")


cte("wide_ff", f"""
SELECT m.order_book_id, m.date, e.click, e.error, e.purchase, e.signup, e.view, true AS is_filled FROM miss m JOIN wide e ON e.order_book_id = m.order_book_id
  AND e.date = (SELECT max(x.date) FROM wide x WHERE x.order_book_id = m.order_book_id AND x.date < m.date)
UNION ALL SELECT {KS}, click, error, purchase, signup, view, false FROM wide""", "miss", "wide")
_NULLS = " + ".join(f"(CASE WHEN {n} IS NULL THEN 1 ELSE 0 END)" for n in FACTOR_NAMES)
cte("fillq", f"""SELECT order_book_id, count(*) - count(*) FILTER (is_filled) AS original_rows, count(*) FILTER (is_filled) AS expected,
 count(*) FILTER (is_filled) AS added, 1 - sum({_NULLS}) / (count(*) * 6.0::DOUBLE) AS quality FROM wide_ff GROUP BY 1""", "wide_ff")


@query("fill_quality", "D10 D12", sql(
    "SELECT order_book_id, original_rows, expected, added, RND6(quality) AS quality, quality >= 0.55e0 AS success FROM fillq", "fillq"))
def fill_quality(spark: SparkSession, sf: str) -> DataFrame:
    df = complete.completion_records(factor_pivot(spark, sf), threshold=0.55)
    return shape(df, "order_book_id original_rows expected added quality success", 6)


@query("complete_checked", "D12", sql(
    f"SELECT {KS}, click, view, is_filled, RND6(quality) AS quality FROM wide_ff JOIN fillq USING (order_book_id) WHERE NOT is_filled OR quality >= 0.55e0", "wide_ff", "fillq"))
def complete_checked(spark: SparkSession, sf: str) -> DataFrame:
    df = complete.complete_checked(factor_pivot(spark, sf), threshold=0.55)
    return shape(df, f"{K} click view is_filled quality", 6)


@query("continuity", "D11", sql(
    f"""SELECT order_book_id, rows, missing, RND6(cont) AS continuity, RND6(CASE WHEN missing = 0 THEN 1 ELSE 0.7e0 * (1 - missing / rows::DOUBLE) + 0.3e0 * cont END) AS quality
    FROM (SELECT order_book_id, count(*) AS rows, count(*) FILTER (is_filled) AS missing,
      coalesce(avg(CASE WHEN gap <= 3 THEN 1.0 WHEN gap IS NOT NULL THEN 0.0 END), 1) AS cont
      FROM (SELECT *, date - {lag('date')} AS gap FROM filled_f) GROUP BY 1)""", "filled_f"))
def continuity(spark: SparkSession, sf: str) -> DataFrame:
    df = complete.continuity_quality(complete.complete(_slim(spark, sf)))
    return shape(df, "order_book_id rows missing continuity quality", 6)


# ---------------------------------------------------------------- calendar and synchronisation

cte("cal", "SELECT CAST(d AS DATE) AS date, row_number() OVER (ORDER BY d) AS trade_seq FROM (SELECT unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS d FROM ebars) WHERE isodow(d) < 6", "ebars")
cte("alldays", "SELECT CAST(d AS DATE) AS date FROM (SELECT unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS d FROM cal)", "cal")


@query("calendar", "K1", sql("SELECT * FROM cal", "cal"))
def calendar(spark: SparkSession, sf: str) -> DataFrame:
    return event_days(spark, sf)


@query("calendar_nth", "K2 K3 K4 K7", sql(
    """SELECT a.date, (SELECT max(c.date) FROM cal c WHERE c.date <= a.date) AS latest_trading, (SELECT min(c.date) FROM cal c WHERE c.date > a.date) AS next_trading,
    (SELECT max(c.date) FROM cal c WHERE c.trade_seq = (SELECT max(x.trade_seq) FROM cal x WHERE x.date <= a.date) - 5) AS trading_n_ago FROM alldays a""", "cal", "alldays"))
def calendar_nth(spark: SparkSession, sf: str) -> DataFrame:
    return cal.day_lookup(calendar(spark, sf), 5)


@query("default_range", "K5 K2", sql(
    "SELECT min(date) AS start_date, max(date) AS end_date, CAST(count(*) AS BIGINT) AS trading_days FROM (SELECT date FROM cal WHERE date <= DATE '2024-01-28' ORDER BY date DESC LIMIT 15)", "cal"))
def default_range(spark: SparkSession, sf: str) -> DataFrame:
    return cal.default_range(calendar(spark, sf), "2024-01-28", 15)


@query("completed_day", "K6 K7", sql(
    """SELECT CAST(e.ts AS DATE) AS date, CASE WHEN c.date IS NULL THEN (SELECT max(x.date) FROM cal x WHERE x.date <= CAST(e.ts AS DATE))
      WHEN hour(e.ts) >= 18 THEN CAST(e.ts AS DATE) ELSE (SELECT max(x.date) FROM cal x WHERE x.date < CAST(e.ts AS DATE)) END AS completed_day, CAST(count(*) AS BIGINT) AS events
    FROM events e LEFT JOIN cal c ON c.date = CAST(e.ts AS DATE) GROUP BY 1, 2""", "cal"))
def completed_day(spark: SparkSession, sf: str) -> DataFrame:
    df = cal.completed_day(table(spark, sf, "events").select("ts"), "ts", calendar(spark, sf))
    return df.groupBy("date", "completed_day").agg(F.count(F.lit(1)).alias("events"))


# the stored part of the event bars, as if the newest days had not arrived and one day was lost
_LAST = "(SELECT max(CAST(ts AS DATE)) FROM events)"
_LOST = "(SELECT max(date) FROM cal WHERE date <= (SELECT max(CAST(ts AS DATE)) FROM events) - 20)"
cte("stored", f"SELECT * FROM ebars WHERE date <= {_LAST} - 11 AND date <> {_LOST}", "ebars", "cal")


def _last_day(spark: SparkSession, sf: str, back: int = 0) -> Column:
    """The newest day of the events, or some days before it."""
    day = table(spark, sf, "events").agg(F.date_sub(F.max(F.col("ts").cast("date")), back).alias("d"))
    return day.scalar()


def _stored(spark: SparkSession, sf: str) -> DataFrame:
    """Without the newest eleven days and without one trading day twenty days back."""
    lost = calendar(spark, sf).where(F.col("date") <= _last_day(spark, sf, 20)).agg(F.max("date").alias("d")).scalar()
    return event_bars(spark, sf).where((F.col("date") <= _last_day(spark, sf, 11)) & (F.col("date") != lost))


def _day_text(spark: SparkSession, sf: str, back: int) -> str:
    return str(spark.range(1).select(_last_day(spark, sf, back).alias("d")).first()["d"])


@query("missing_market_days", "D15 E10", sql(
    "SELECT date FROM cal WHERE date BETWEEN (SELECT min(date) FROM stored) AND (SELECT max(date) FROM stored) AND date NOT IN (SELECT date FROM stored)", "cal", "stored"))
def missing_market_days(spark: SparkSession, sf: str) -> DataFrame:
    return complete.missing_market_days(_stored(spark, sf), calendar(spark, sf))


@query("completion_range", "D14", sql(
    "SELECT (SELECT max(date) FROM stored) + 1 AS start_date, (SELECT max(date) FROM cal WHERE date <= " + _LAST + " - 2) AS end_date", "cal", "stored"))
def completion_range(spark: SparkSession, sf: str) -> DataFrame:
    return complete.completion_range(_stored(spark, sf), calendar(spark, sf), _day_text(spark, sf, 2))


@query("completion_range_inside", "D14", sql(
    f"""SELECT min(date) AS start_date, max(date) AS end_date FROM cal
    WHERE date BETWEEN (SELECT min(date) FROM stored) AND {_LAST} - 11 AND date NOT IN (SELECT date FROM stored)""", "cal", "stored"))
def completion_range_inside(spark: SparkSession, sf: str) -> DataFrame:
    return complete.completion_range(_stored(spark, sf), calendar(spark, sf), _day_text(spark, sf, 11))


@query("missing_per_symbol", "D16", sql(
    f"SELECT s.order_book_id, cal.date FROM (SELECT DISTINCT order_book_id FROM stored) s, cal EXCEPT SELECT {KS} FROM stored", "cal", "stored"))
def missing_per_symbol(spark: SparkSession, sf: str) -> DataFrame:
    return complete.missing_per_symbol(_stored(spark, sf), calendar(spark, sf))


cte("absent", """SELECT s.order_book_id, cal.date FROM (SELECT DISTINCT order_book_id FROM ebars) s, cal
 EXCEPT SELECT order_book_id, date FROM stored WHERE volume > 4""", "ebars", "cal", "stored")


@query("completeness_report", "D16", sql(
    """SELECT s.order_book_id, p.order_book_id IS NULL AS absent, coalesce(m.n, 0) AS missing_days, CASE WHEN p.order_book_id IS NULL THEN NULL ELSE m.days END AS days
    FROM (SELECT DISTINCT order_book_id FROM ebars) s LEFT JOIN (SELECT DISTINCT order_book_id FROM stored WHERE volume > 4) p USING (order_book_id)
    LEFT JOIN (SELECT order_book_id, count(*) AS n, string_agg(CAST(date AS VARCHAR), ',' ORDER BY date) AS days FROM absent GROUP BY 1) m USING (order_book_id)""",
    "ebars", "stored", "absent"))
def completeness_report(spark: SparkSession, sf: str) -> DataFrame:
    some = _stored(spark, sf).where(F.col("volume") > 4)
    return complete.completeness(some, calendar(spark, sf), event_bars(spark, sf).select("order_book_id").distinct())


@query("integrity", "D17", sql(
    """SELECT (SELECT count(*) FROM stored) AS existing_records, (SELECT count(DISTINCT date) FROM stored) AS existing_dates, (SELECT count(DISTINCT order_book_id) FROM stored) AS existing_symbols,
    (SELECT max(date) FROM stored) AS latest_date, (SELECT count(*) FROM cal WHERE date NOT IN (SELECT date FROM stored)) AS missing_dates,
    (SELECT count(*) FROM instruments WHERE order_book_id NOT IN (SELECT order_book_id FROM stored)) AS missing_symbols, false AS needs_full_sync""", "cal", "stored", "instruments"))
def integrity(spark: SparkSession, sf: str) -> DataFrame:
    return complete.integrity(_stored(spark, sf), calendar(spark, sf), instruments(spark, sf))


@query("sync_window", "D18 L2", sql(
    "SELECT (SELECT max(date) FROM stored) AS start_date, (SELECT max(date) FROM cal) AS end_date, 'incremental_sync' AS sync_type", "cal", "stored"))
def sync_window(spark: SparkSession, sf: str) -> DataFrame:
    return complete.sync_window(_stored(spark, sf), calendar(spark, sf))


@query("sync_window_full", "D18", sql(
    "SELECT (SELECT min(date) FROM (SELECT date FROM cal ORDER BY date DESC LIMIT 12)) AS start_date, (SELECT max(date) FROM cal) AS end_date, 'full_sync' AS sync_type", "cal"))
def sync_window_full(spark: SparkSession, sf: str) -> DataFrame:
    return complete.sync_window(event_bars(spark, sf).where("volume < 0"), calendar(spark, sf), 12)


@query("coarse_gate", "D19", sql(
    "SELECT count(*) AS rows, (SELECT count(*) FROM instruments) AS symbols, count(*) >= 0.8e0 * 5 * (SELECT count(*) FROM instruments) AS complete FROM stored", "stored", "instruments"))
def coarse_gate(spark: SparkSession, sf: str) -> DataFrame:
    return complete.is_roughly_complete(_stored(spark, sf), instruments(spark, sf))


@query("top_up", "D19 L2", sql(f"SELECT {KS}, close FROM ebars", "ebars"))
def top_up(spark: SparkSession, sf: str) -> DataFrame:
    cols = ["order_book_id", "date", "close"]
    return complete.top_up(_stored(spark, sf).select(*cols), event_bars(spark, sf).select(*cols))


@query("dates_without_future", "D20", sql(
    """SELECT DISTINCT s.date, s.date + 5 AS target_date, CASE WHEN s.date + 5 <= """ + _LAST + """ - 8 THEN 'past' ELSE 'future' END AS kind
    FROM stored s WHERE s.date + 5 NOT IN (SELECT date FROM stored)""", "stored"))
def dates_without_future(spark: SparkSession, sf: str) -> DataFrame:
    return complete.dates_without_future(_stored(spark, sf), _day_text(spark, sf, 8))


@query("still_missing", "D21", sql(
    "SELECT count(*) AS missing, count(*) = 0 AS filled FROM cal WHERE date NOT IN (SELECT date FROM stored)", "cal", "stored"))
def still_missing(spark: SparkSession, sf: str) -> DataFrame:
    return complete.still_missing(calendar(spark, sf), _stored(spark, sf))


# ---------------------------------------------------------------- joins

_TECH = f"SELECT {KS}, {full('avg', 'close', 5)} AS sma_5, close * 1 AS close FROM ebars"
cte("tech", _TECH, "ebars")


@query("merge_all", "E1 C15", sql(
    f"""SELECT {KS}, e.close, w.click, w.view, RND4(t.sma_5) AS sma_5, t.close AS close_technical
    FROM ebars e LEFT JOIN wide w USING (order_book_id, date) LEFT JOIN tech t USING (order_book_id, date)""", "ebars", "wide", "tech"))
def merge_all(spark: SparkSession, sf: str) -> DataFrame:
    bars = event_bars(spark, sf)
    tech = ind.sma(bars, (5,)).select("order_book_id", "date", "sma_5", "close")
    df = joins.merge_all(bars, factor_pivot(spark, sf), tech)
    return shape(df, f"{K} close click view sma_5 close_technical")


cte("buys", f"SELECT {KS}, factor_value AS purchase FROM factors WHERE factor_name = 'purchase'", "factors")
cte("views", f"SELECT {KS}, factor_value AS view FROM factors WHERE factor_name = 'view'", "factors")


@query("full_outer", "E2 A25", sql(f"SELECT {KS}, purchase, view FROM buys FULL JOIN views USING (order_book_id, date)", "buys", "views"))
def full_outer(spark: SparkSession, sf: str) -> DataFrame:
    f = factors_long(spark, sf).select("order_book_id", "date", "factor_name", "factor_value")
    buys = f.where("factor_name = 'purchase'").select("order_book_id", "date", F.col("factor_value").alias("purchase"))
    views = f.where("factor_name = 'view'").select("order_book_id", "date", F.col("factor_value").alias("view"))
    return joins.outer_on_common(buys, views)


@query("side_by_side", "E3", sql(
    """SELECT CAST(coalesce(a.n, b.n) AS BIGINT) AS ordinal, c_custkey, s_suppkey FROM (SELECT CAST(c_custkey AS DOUBLE) AS c_custkey, row_number() OVER (ORDER BY c_custkey) AS n FROM customer) a
    FULL JOIN (SELECT CAST(s_suppkey AS DOUBLE) AS s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS n FROM supplier) b ON a.n = b.n"""))
def side_by_side(spark: SparkSession, sf: str) -> DataFrame:
    return joins.side_by_side(table(spark, sf, "customer").select("c_custkey"), "c_custkey",
                              table(spark, sf, "supplier").select("s_suppkey"), "s_suppkey")


# pre-adjusted bars: the same prices divided by a factor that changes at the turn of each quarter
_FACTOR = "(1 + quarter(date) / 4.0::DOUBLE)"
cte("dual", f"""SELECT b.*, p.close_pre, p.open_pre FROM ebars b LEFT JOIN (SELECT {KS}, floor(close / 1.25e0 * 100 + 0.5e0) / 100 AS close_pre,
 floor(open / 1.25e0 * 100 + 0.5e0) / 100 AS open_pre FROM ebars WHERE trades > 1) p USING (order_book_id, date)""", "ebars")


def _pre(spark: SparkSession, sf: str) -> DataFrame:
    from barloom.functions.numeric import to_tick

    post = event_bars(spark, sf).where("trades > 1")
    return post.withColumns({c: to_tick(F.col(c) / F.lit(1.25)) for c in ("open", "high", "low", "close")})


@query("dual_adjust", "E4", sql(f"SELECT {KS}, open, close, open_pre, close_pre FROM dual", "dual"))
def dual_adjust(spark: SparkSession, sf: str) -> DataFrame:
    df = bar_source.dual_adjusted(event_bars(spark, sf), _pre(spark, sf))
    return df.select("order_book_id", "date", "open", "close", "open_pre", "close_pre")


@query("dual_sma", "G20", sql(
    f"SELECT {KS}, RND4({full('avg', 'close', 3)}) AS sma_3, RND4({full('avg', 'close_pre', 3)}) AS pre_sma_3 FROM dual", "dual"))
def dual_sma(spark: SparkSession, sf: str) -> DataFrame:
    df = bar_source.dual_adjusted(event_bars(spark, sf), _pre(spark, sf))
    df = ind.run(df, ind.sma.stages((3,)), ind.sma.stages((3,), "close_pre", "pre_sma"))
    return shape(df, f"{K} sma_3 pre_sma_3")


@query("adjust_ratio", "F33", sql(
    f"""SELECT {KS}, RND6(close / nullif(close_pre, 0)) AS adjust_ratio, coalesce(close / nullif(close_pre, 0) >= 1, false) AS plausible
    FROM dual QUALIFY row_number() OVER (PARTITION BY order_book_id ORDER BY date DESC) = 1""", "dual"))
def adjust_ratio(spark: SparkSession, sf: str) -> DataFrame:
    df = bar_source.adjustment_check(bar_source.dual_adjusted(event_bars(spark, sf), _pre(spark, sf)))
    return shape(df, f"{K} adjust_ratio plausible", 6)


@query("display_scores", "H21", sql(
    """SELECT order_book_id, date, close, close_pre, RND4(least(100, greatest(0, close / 1000 * 20))) AS display_score,
    row_number() OVER (ORDER BY close DESC, order_book_id) AS rank FROM (SELECT * FROM dual QUALIFY row_number() OVER (PARTITION BY order_book_id ORDER BY date DESC) = 1)
    QUALIFY rank <= 50""", "dual"))
def display_scores(spark: SparkSession, sf: str) -> DataFrame:
    from barloom.operators import scoring

    dual = bar_source.dual_adjusted(event_bars(spark, sf), _pre(spark, sf))
    latest = pools.latest_per_symbol(dual, ["close", "close_pre"])
    scored = scoring.display_score(latest)
    top = pools.pool(scored.withColumn("rank_by", F.col("close")), "watch", "rank_by").select("order_book_id", "rank")
    return shape(scored.join(top, "order_book_id"), f"{K} close close_pre display_score rank")


@query("adjust_spread", "F32", sql(
    """SELECT order_book_id, CAST(2 AS BIGINT) AS types, RND4(greatest(a.close, b.close) - least(a.close, b.close)) AS close_spread,
      RND4((greatest(a.close, b.close) - least(a.close, b.close)) / greatest(a.close, b.close) * 100) AS close_spread_pct,
      RND4(abs(a.volume - b.volume)) AS volume_spread, RND4(abs(a.amount - b.amount)) AS amount_spread
    FROM (SELECT * FROM ebars QUALIFY row_number() OVER (PARTITION BY order_book_id ORDER BY date DESC) = 1) a JOIN
      (SELECT order_book_id, date, floor(close / 1.25e0 * 100 + 0.5e0) / 100 AS close, volume, amount FROM ebars WHERE trades > 1 QUALIFY row_number() OVER (PARTITION BY order_book_id ORDER BY date DESC) = 1) b
    USING (order_book_id)""", "ebars"))
def adjust_spread(spark: SparkSession, sf: str) -> DataFrame:
    from barloom.operators import research

    both = event_bars(spark, sf).withColumn("adjust_type", F.lit("post")).unionByName(
        _pre(spark, sf).withColumn("adjust_type", F.lit("pre")))
    return shape(research.adjustment_spread(both),
                 "order_book_id types close_spread close_spread_pct volume_spread amount_spread")


cte("twosrc", f"SELECT {KS}, close AS close_a, floor(amount / volume * 100 + 0.5e0) / 100 AS close_b, amount AS amount_a, amount AS amount_b FROM bars", "bars")


def _second_source(spark: SparkSession, sf: str) -> DataFrame:
    from barloom.functions.numeric import to_tick

    return trade_bars(spark, sf).withColumn("close", to_tick(F.col("amount") / F.col("volume")))


@query("reconcile", "E7", sql(
    f"SELECT {KS}, close_a, close_b, RND4(abs(close_a - close_b)) AS close_diff, RND4(abs(close_a - close_b)) AS max_diff, abs(close_a - close_b) > 0.015e0 AS differs FROM twosrc", "twosrc"))
def reconcile(spark: SparkSession, sf: str) -> DataFrame:
    df = joins.reconcile(trade_bars(spark, sf), _second_source(spark, sf), ["close", "amount"], 0.015)
    return shape(df, f"{K} close_a close_b close_diff max_diff differs")


@query("reconcile_summary", "E7", sql(
    """SELECT order_book_id, CAST(count(*) AS BIGINT) AS rows, count(*) FILTER (abs(close_a - close_b) > 0.015e0) AS differing, RND4(max(abs(close_a - close_b))) AS largest,
    arg_max(date, (abs(close_a - close_b), date)) AS largest_on FROM twosrc GROUP BY 1""", "twosrc"))
def reconcile_summary(spark: SparkSession, sf: str) -> DataFrame:
    df = joins.reconcile(trade_bars(spark, sf), _second_source(spark, sf), ["close", "amount"], 0.015)
    return shape(joins.reconcile_summary(df), "order_book_id rows differing largest largest_on")


@query("common_dates", "E9", sql("SELECT CAST(l_shipdate AS DATE) AS date FROM lineitem INTERSECT SELECT CAST(o_orderdate AS DATE) FROM orders"))
def common_dates(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select(F.col("l_shipdate").cast("date").alias("date"))
    o = table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("date"))
    return joins.common_dates(li, o)


@query("absent_dates", "E10", sql("SELECT CAST(o_orderdate AS DATE) AS date FROM orders EXCEPT SELECT CAST(l_shipdate AS DATE) FROM lineitem"))
def absent_dates(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select(F.col("l_shipdate").cast("date").alias("date"))
    o = table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("date"))
    return joins.absent(o, li, "date")


# ---------------------------------------------------------------- lookups


@query("latest_per_symbol", "F6 B8", sql(
    f"SELECT {KS}, close, volume FROM bars QUALIFY row_number() OVER (PARTITION BY order_book_id ORDER BY date DESC) = 1", "bars"))
def latest_per_symbol(spark: SparkSession, sf: str) -> DataFrame:
    return pools.latest_per_symbol(trade_bars(spark, sf), ["close", "volume"])


@query("latest_non_null", "F6", sql(
    f"SELECT order_book_id, {', '.join(f'arg_max({n}, date) FILTER ({n} IS NOT NULL) AS {n}' for n in FACTOR_NAMES)} FROM wide GROUP BY 1", "wide"))
def latest_non_null(spark: SparkSession, sf: str) -> DataFrame:
    return pools.latest_non_null(factor_pivot(spark, sf), FACTOR_NAMES)


@query("stock_details", "B8", sql(
    f"""SELECT {KS}, close, volume, click, view FROM (SELECT * FROM ebars QUALIFY row_number() OVER (PARTITION BY order_book_id ORDER BY date DESC) = 1)
    LEFT JOIN wide USING (order_book_id, date)""", "ebars", "wide"))
def stock_details(spark: SparkSession, sf: str) -> DataFrame:
    df = pools.details(event_bars(spark, sf), factor_pivot(spark, sf), ["close", "volume"])
    return df.select("order_book_id", "date", "close", "volume", "click", "view")


@query("resolve_codes", "C10", sql(
    f"""SELECT code, order_book_id FROM (SELECT DISTINCT regexp_replace(order_book_id, '\\..*', '') AS code, order_book_id FROM bars) WHERE order_book_id NOT LIKE '%.XHKG'""", "bars"))
def resolve_codes(spark: SparkSession, sf: str) -> DataFrame:
    known = trade_bars(spark, sf).select("order_book_id")
    codes = instruments(spark, sf).select(F.substring_index("order_book_id", ".", 1).alias("code"))
    return pools.resolve_codes(codes, known)


@query("search_codes", "C11", sql(
    "SELECT DISTINCT order_book_id FROM instruments WHERE lower(order_book_id) LIKE '%3.xs%'", "instruments"))
def search_codes(spark: SparkSession, sf: str) -> DataFrame:
    return pools.search_codes(instruments(spark, sf), "3.XS")


# ---------------------------------------------------------------- quality


@query("null_report", "F1 F4 F10", sql(" UNION ALL ".join(
    f"SELECT '{c}' AS column, '{t}' AS data_type, CAST(count(*) AS BIGINT) AS rows, CAST(count(*) - count({c}) AS BIGINT) AS nulls, RND4(count({c}) / count(*)::DOUBLE * 100) AS completeness FROM wide"
    for c, t in [("order_book_id", "string"), ("date", "date"), *[(n, "double") for n in FACTOR_NAMES]]), "wide"))
def null_report(spark: SparkSession, sf: str) -> DataFrame:
    return shape(quality.null_report(factor_pivot(spark, sf)), "column data_type rows nulls completeness")


@query("quality_score", "F1 F2", sql(
    f"SELECT count(*) AS rows, CAST(7 AS BIGINT) AS columns, CAST(sum({_NULLS}) AS BIGINT) AS null_cells, RND6(1 - sum({_NULLS}) / (count(*) * 7.0::DOUBLE)) AS quality, RND6((1 - sum({_NULLS}) / (count(*) * 7.0::DOUBLE)) * 100) AS quality_pct FROM wide", "wide"))
def quality_score(spark: SparkSession, sf: str) -> DataFrame:
    return shape(quality.quality_score(factor_pivot(spark, sf)), "rows columns null_cells quality quality_pct", 6)


@query("tables_report", "F3", sql(
    """SELECT source, rows, columns, RND4(least(100, (SELECT (SELECT count(*) FROM bars) + (SELECT count(*) FROM factors) + (SELECT count(*) FROM instruments)) / 10000.0::DOUBLE * 100)) AS coverage_score FROM
    (SELECT 'market' AS source, (SELECT count(*) FROM bars) AS rows, CAST(9 AS BIGINT) AS columns UNION ALL SELECT 'factors', (SELECT count(*) FROM factors), 5 UNION ALL SELECT 'instruments', (SELECT count(*) FROM instruments), 7)""",
    "bars", "factors", "instruments"))
def tables_report(spark: SparkSession, sf: str) -> DataFrame:
    df = quality.tables_report({"market": trade_bars(spark, sf), "factors": factors_long(spark, sf),
                                "instruments": instruments(spark, sf)})
    return shape(df, "source rows columns coverage_score")


@query("panel_completeness", "F9", sql(
    "SELECT count(*) AS rows, count(DISTINCT order_book_id) AS symbols, count(DISTINCT date) AS dates, RND6(count(*) / (count(DISTINCT order_book_id) * count(DISTINCT date))::DOUBLE) AS completeness FROM ebars", "ebars"))
def panel_completeness(spark: SparkSession, sf: str) -> DataFrame:
    return shape(quality.panel_completeness(event_bars(spark, sf)), "rows symbols dates completeness", 6)


@query("profile", "F36", sql(
    "SELECT count(*) AS rows, count(DISTINCT order_book_id) AS symbols, count(DISTINCT date) AS dates, min(date) AS first_date, max(date) AS last_date FROM bars", "bars"))
def profile(spark: SparkSession, sf: str) -> DataFrame:
    return quality.profile(trade_bars(spark, sf))


@query("profile_approximate", "F36", sql("SELECT count(*) AS rows, true AS symbols_close, true AS dates_close FROM bars", "bars"))
def profile_approximate(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each sketch lies within four times its stated error of the exact count."""
    bars = trade_bars(spark, sf)
    exact = quality.profile(bars).select(F.col("symbols").alias("s"), F.col("dates").alias("d"))
    both = quality.approximate_profile(bars, 0.02).withColumns({
        "s": exact.select("s").scalar(), "d": exact.select("d").scalar()})
    return both.select("rows", (F.abs(F.col("symbols") - F.col("s")) <= 0.08 * F.col("s")).alias("symbols_close"),
                       (F.abs(F.col("dates") - F.col("d")) <= 0.08 * F.col("d")).alias("dates_close"))


@query("symbol_summary", "F37", sql(
    "SELECT order_book_id, RND4(avg(close)) AS mean_close, max(close) AS max_close, min(close) AS min_close, RND4(avg(volume)) AS mean_volume, sum(volume) AS total_volume FROM bars GROUP BY 1", "bars"))
def symbol_summary(spark: SparkSession, sf: str) -> DataFrame:
    return shape(quality.symbol_summary(trade_bars(spark, sf)),
                 "order_book_id mean_close max_close min_close mean_volume total_volume", 4,
                 "max_close min_close total_volume")


_PRICES = " UNION ALL ".join(f"SELECT order_book_id, '{c}' AS price_column, {c} AS p FROM both_bars" for c in ("open", "high", "low", "close"))
_RULES = [("too_high", "> 10000"), ("too_low", "< 0.1e0"), ("not_positive", "<= 0")]
cte("both_bars", f"SELECT {KS}, open, high, low, close FROM bars UNION ALL SELECT 'E' || order_book_id, date, open - 0.5e0, high, low - 0.5e0, close FROM ebars", "bars", "ebars")
cte("prices", _PRICES, "both_bars")
cte("abnormal", " UNION ALL ".join(
    f"SELECT order_book_id, price_column, '{r}' AS rule, count(*) AS n, min(p) AS min_price, max(p) AS max_price, avg(p) AS mean_price FROM prices WHERE p {c} GROUP BY 1, 2" for r, c in _RULES), "prices")


def _both_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Trade bars (some above the upper bound) and shifted event bars (some at or below zero)."""
    cols = ["order_book_id", "date", "open", "high", "low", "close"]
    low = event_bars(spark, sf).withColumns({
        "order_book_id": F.concat(F.lit("E"), "order_book_id"), "open": F.col("open") - F.lit(0.5),
        "low": F.col("low") - F.lit(0.5)})
    return trade_bars(spark, sf).select(*cols).unionByName(low.select(*cols))


@query("abnormal_prices", "F7 I11", sql(f"SELECT order_book_id, price_column, rule, n, {rnd('min_price max_price mean_price')} FROM abnormal", "abnormal"))
def abnormal_prices(spark: SparkSession, sf: str) -> DataFrame:
    return shape(quality.abnormal_prices(_both_bars(spark, sf)),
                 "order_book_id price_column rule n min_price max_price mean_price")


@query("abnormal_totals", "F8", sql(
    "SELECT 'rule' AS kind, rule AS name, CAST(sum(n) AS BIGINT) AS n FROM abnormal GROUP BY 2 UNION ALL SELECT 'column', price_column, CAST(sum(n) AS BIGINT) FROM abnormal GROUP BY 2", "abnormal"))
def abnormal_totals(spark: SparkSession, sf: str) -> DataFrame:
    return quality.abnormal_totals(_both_bars(spark, sf))


_BAD = "(greatest(open, high, low, close) > 10000 OR least(open, high, low, close) < 0.1e0)"


@query("abnormal_symbols", "F8", sql(
    f"SELECT order_book_id, count(*) AS bars, count(*) FILTER ({_BAD}) AS abnormal, RND4(count(*) FILTER ({_BAD}) / count(*)::DOUBLE * 100) AS abnormal_pct FROM both_bars GROUP BY 1 HAVING count(*) FILTER ({_BAD}) > 0 ORDER BY abnormal DESC, order_book_id LIMIT 20", "both_bars"))
def abnormal_symbols(spark: SparkSession, sf: str) -> DataFrame:
    return shape(quality.abnormal_symbols(_both_bars(spark, sf)), "order_book_id bars abnormal abnormal_pct")


@query("abnormal_summary", "F8", sql(
    f"SELECT count(*) AS symbols, count(*) FILTER (a > 0) AS abnormal_symbols, CAST(sum(a) AS BIGINT) AS abnormal_bars, RND4(count(*) FILTER (a > 0) / count(*)::DOUBLE * 100) AS abnormal_pct FROM (SELECT order_book_id, count(*) FILTER ({_BAD}) AS a FROM both_bars GROUP BY 1)", "both_bars"))
def abnormal_summary(spark: SparkSession, sf: str) -> DataFrame:
    return shape(quality.abnormal_summary(_both_bars(spark, sf)), "symbols abnormal_symbols abnormal_bars abnormal_pct")


@query("scorer_warnings", "J7", sql(
    f"""SELECT 'nulls' AS kind, 'volume' AS detail WHERE (SELECT avg(CASE WHEN trades <= 1 THEN 1.0 ELSE 0.0 END) FROM ebars) > 0.1
    UNION ALL SELECT 'unknown_industry', '综合' WHERE (SELECT count(*) FROM instruments WHERE industry = '综合') > 0""", "ebars", "instruments"))
def scorer_warnings(spark: SparkSession, sf: str) -> DataFrame:
    bars = event_bars(spark, sf).withColumn("volume", F.when(F.col("trades") > 1, F.col("volume")))
    inst = instruments(spark, sf).select("industry")
    rows = bars.select("open", "high", "low", "close", "volume").withColumn("industry", F.lit(None).cast("string"))
    return quality.scorer_warnings(
        rows, INDUSTRIES[:-1]).unionByName(quality.scorer_warnings(inst, INDUSTRIES[:-1]).where("kind = 'unknown_industry'"))


# ---------------------------------------------------------------- schema checks


@query("schema_check", "J1 J2", sql(
    """SELECT 'missing' AS kind, 'symbol' AS "column", 'string' AS detail, CAST(0 AS BIGINT) AS "values"
    UNION ALL SELECT 'extra', 'source', 'bigint', count(*) FILTER (factor_name = 'view') FROM factors
    UNION ALL SELECT 'type', 'factor_value', 'string for float64', count(*) FROM factors""", "factors"))
def schema_check(spark: SparkSession, sf: str) -> DataFrame:
    df = factors_long(spark, sf).withColumns({"factor_value": F.col("factor_value").cast("string"), "source": F.when(F.col("factor_name") == "view", 1).cast("bigint")})
    return schema.check_schema(df, schema.TABLES["factors"])


@query("field_validity", "J6", sql(
    """SELECT 'order_book_id' AS column, count(*) AS rows, CAST(0 AS BIGINT) AS bad_nulls, CAST(0 AS BIGINT) AS bad_types FROM factors
    UNION ALL SELECT 'date', count(*), 0, 0 FROM factors UNION ALL SELECT 'factor_name', count(*), count(*) FILTER (factor_name = 'error'), 0 FROM factors
    UNION ALL SELECT 'factor_value', count(*), 0, count(*) FILTER (factor_value > 1) FROM factors UNION ALL SELECT 'factor_category', count(*), 0, 0 FROM factors""", "factors"))
def field_validity(spark: SparkSession, sf: str) -> DataFrame:
    df = factors_long(spark, sf).withColumns({
        "factor_name": F.when(F.col("factor_name") != "error", F.col("factor_name")),
        "factor_value": F.when(F.col("factor_value") > 1, "many").otherwise("1")})
    return schema.field_validity(df, schema.TABLES["factors"])


@query("schema_compliance", "J12", sql(
    """SELECT 2 / 4.0::DOUBLE AS score, c AS column, c <> 'low' AS present, c <> 'low' AS type_fits, RND6(s) AS null_share, c IN ('order_book_id', 'close') AS accepted
    FROM (SELECT 'order_book_id' AS c, CAST(0 AS DOUBLE) AS s UNION ALL SELECT 'close', CAST(0 AS DOUBLE) UNION ALL SELECT 'low', CAST(NULL AS DOUBLE)
      UNION ALL SELECT 'volume', (SELECT count(*) FILTER (trades <= 4) / count(*)::DOUBLE FROM ebars))""", "ebars"))
def schema_compliance(spark: SparkSession, sf: str) -> DataFrame:
    want = schema.user_schema("slim", {"order_book_id": "string", "close": "float64", "low": "float64", "volume": "float64"})
    df = event_bars(spark, sf).drop("low").withColumn("volume", F.when(F.col("trades") > 4, F.col("volume")))
    return shape(schema.compliance(df, want), "score column present type_fits null_share accepted", 6, "score")


@query("gate", "J4 J5", sql(f"SELECT {KS}, close FROM ebars", "ebars"))
def gate(spark: SparkSession, sf: str) -> DataFrame:
    return schema.gate(event_bars(spark, sf)).select("order_book_id", "date", "close")


@query("coerce_types", "J11", sql(f"SELECT {KS}, factor_name, CASE WHEN factor_value > 1 THEN NULL ELSE factor_value END AS factor_value FROM factors", "factors"))
def coerce_types(spark: SparkSession, sf: str) -> DataFrame:
    df = factors_long(spark, sf).withColumn("factor_value", F.when(F.col("factor_value") > 1, "many").otherwise("1.0"))
    df = schema.coerce(df, schema.TABLES["factors"])
    return df.select("order_book_id", F.to_date("date").alias("date"), "factor_name", "factor_value")


# ---------------------------------------------------------------- fundamentals and SQL


@query("fundamental_ratios", "I6", sql(
    """SELECT p_partkey, RND4(p_retailprice / nullif(p_size - 10, 0)) AS pe_ratio, RND4(p_retailprice / p_size) AS pb_ratio FROM part"""))
def fundamental_ratios(spark: SparkSession, sf: str) -> DataFrame:
    from barloom.functions.formulas import fundamental_ratios as ratios

    p = table(spark, sf, "part").select(
        "p_partkey", F.col("p_retailprice").alias("close"), (F.col("p_size") - 10).alias("eps"), F.col("p_size").alias("bvps"))
    return shape(ratios(p), "p_partkey pe_ratio pb_ratio")


@query("sql_params", "B1 B2 B13 A9", sql(
    f"SELECT {KS}, close FROM bars WHERE close BETWEEN 1000 AND 2000 AND date >= DATE '1999-01-01'", "bars"))
def sql_params(spark: SparkSession, sf: str) -> DataFrame:
    import datetime

    trade_bars(spark, sf).createOrReplaceTempView("barloom_bars")
    tables.create_view(spark, "barloom_recent", "SELECT order_book_id, date, close FROM barloom_bars WHERE date >= DATE '1999-01-01'")
    return tables.run_sql(spark, "SELECT * FROM barloom_recent WHERE close BETWEEN :low AND :high AND date >= :since",
                          {"low": 1000, "high": 2000, "since": datetime.date(1999, 1, 1)})


@query("sql_positional", "B1 A10", sql(
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000"))
def sql_positional(spark: SparkSession, sf: str) -> DataFrame:
    tables.query_file(spark, f"{sf}/orders.parquet", ["o_orderkey", "o_totalprice", "o_orderstatus"],
                      "o_totalprice > 100000").createOrReplaceTempView("barloom_orders")
    return tables.run_sql(spark, "SELECT o_orderkey, o_totalprice FROM barloom_orders WHERE o_orderstatus = ?", ["F"])


@query("table_stats", "B4", sql(
    "SELECT 'barloom_events' AS table, count(*) AS rows, 6 AS columns, 'event_id,ts,user_id,event_type,value,props' AS names FROM events"))
def table_stats(spark: SparkSession, sf: str) -> DataFrame:
    tables.register(spark, "barloom_events", f"{sf}/events.parquet")
    return tables.describe_table(spark, "barloom_events")


_EVENT_TYPES = {"event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": "string", "value": "double", "props": "string"}


@query("table_types", "B3", sql(" UNION ALL ".join(
    f"SELECT '{c}' AS field, '{t}' AS type, count({c}) AS filled FROM events" for c, t in _EVENT_TYPES.items())))
def table_types(spark: SparkSession, sf: str) -> DataFrame:
    tables.register(spark, "barloom_typed_events", f"{sf}/events.parquet")
    types = tables.column_types(spark, "barloom_typed_events")
    counted = spark.table("barloom_typed_events").agg(*[F.count(c).alias(c) for c in types])
    rows = F.array(*[F.struct(F.lit(c).alias("field"), F.lit(t).alias("type"), F.col(c).alias("filled")) for c, t in types.items()])
    return counted.select(F.inline(rows))


@query("top_performers", "B14", sql(
    """SELECT date, n, RND4(mean_score) AS mean_score, max_score FROM (SELECT date, count(*) AS n, avg(composite_score) AS mean_score, max(composite_score) AS max_score FROM scores GROUP BY date HAVING count(*) >= 10)
    ORDER BY RND4(mean_score) DESC, date LIMIT 20""", "scores"))
def top_performers(spark: SparkSession, sf: str) -> DataFrame:
    scored_bars(spark, sf).select("date", "composite_score").createOrReplaceTempView("barloom_scores")
    df = tables.run_sql(spark, """WITH daily AS (SELECT date, count(*) AS n, avg(composite_score) AS mean_score, max(composite_score) AS max_score
      FROM barloom_scores GROUP BY date HAVING count(*) >= 10) SELECT * FROM daily""")
    return shape(df, "date n mean_score max_score").orderBy(F.desc("mean_score"), "date").limit(20)


@query("batch_sql", "B5", sql("SELECT count(*) AS n FROM nation"))
def batch_sql(spark: SparkSession, sf: str) -> DataFrame:
    tables.register(spark, "barloom_nation", f"{sf}/nation.parquet")
    good, bad = tables.batch_sql(spark, [("SELECT count(*) AS n FROM barloom_nation", None), ("SELECT * FROM no_such_table", None)])
    assert bad.columns == []
    return good
