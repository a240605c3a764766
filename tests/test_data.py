from __future__ import annotations

import json

import numpy as np
import pytest
from conftest import day, make_bars
from pyspark.sql import functions as F

import samples
from barloom.operators import clean, complete, joins, pools, quality, schema
from barloom.sources import bars as bar_source, calendar as cal, tables


def gap3(spark):
    return spark.createDataFrame(
        [("A", day("2025-09-10"), 100.0, 1000000), ("A", day("2025-09-12"), 102.0, 1200000),
         ("A", day("2025-09-13"), 101.0, 1100000)], "order_book_id string, date date, close double, volume bigint")


@pytest.mark.parametrize("method, close, volume", [
    ("forward", 100.0, 1000000), ("backward", 102.0, 1200000), ("linear", 101.0, 1100000)])
def test_fill(spark, method, close, volume):
    df = gap3(spark)
    added = complete.complete(df, method).where("is_filled").collect()
    assert [(r.date, r.close, r.volume) for r in added] == [(day("2025-09-11"), close, volume)]
    q = complete.fill_quality(df, complete.complete(df, method)).first()
    assert (q.added, q.expected, q.quality) == (1, 1, 1.0)
    assert complete.continuity_quality(complete.complete(df, method)).first().quality == pytest.approx(0.825)


def test_fill_linear_takes_the_other_side_of_a_null(spark):
    df = spark.createDataFrame([("A", day("2024-01-01"), None, "x"), ("A", day("2024-01-03"), 5.0, "y")],
                               "order_book_id string, date date, close double, note string")
    row = complete.complete(df, "linear").where("is_filled").first()
    assert (row.close, row.note) == (5.0, "x")


def test_nothing_to_fill(spark):
    one = gap3(spark).limit(1)
    assert complete.missing_dates(one).count() == 0
    assert complete.complete(one).count() == 1
    with pytest.raises(ValueError):
        complete.complete(one, "cubic")


def test_low_quality_keeps_the_original_rows(spark):
    df = spark.createDataFrame(
        [("A", day("2024-01-01"), None, None), ("A", day("2024-01-04"), None, 1.0), ("B", day("2024-01-01"), 1.0, 1.0),
         ("B", day("2024-01-04"), 1.0, 1.0)], "order_book_id string, date date, x double, y double")
    kept = complete.complete_checked(df).groupBy("order_book_id").count().collect()
    assert {r.order_book_id: r["count"] for r in kept} == {"A": 2, "B": 4}
    rec = {r.order_book_id: r.success for r in complete.completion_records(df).collect()}
    assert rec == {"A": False, "B": True}


def test_missing_per_symbol_counts_symbols_without_trading_days(spark):
    days = cal.weekdays(spark, "2024-01-01", "2024-01-07")
    df = spark.createDataFrame([("A", day("2024-01-02")), ("A", day("2024-01-04")), ("W", day("2024-01-06"))],
                               "order_book_id string, date date")
    got = {(r.order_book_id, str(r.date)) for r in complete.missing_per_symbol(df, days).collect()}
    assert got == {("A", "2024-01-01"), ("A", "2024-01-03"), ("A", "2024-01-05"),
                   *{("W", f"2024-01-0{i}") for i in range(1, 6)}}
    rep = {r.order_book_id: (r.absent, r.missing_days) for r in complete.completeness(
        df, days, spark.createDataFrame([("A",), ("W",), ("Z",)], "order_book_id string")).collect()}
    assert rep == {"A": (False, 3), "W": (False, 5), "Z": (True, 5)}


def test_completion_range(spark):
    days = cal.weekdays(spark, "2024-01-01", "2024-01-31")
    empty = gap3(spark).where("false")
    row = complete.completion_range(empty, days, "2024-01-21")
    assert [str(x) for x in row.first()] == ["2023-12-20", "2024-01-19"]
    full = days.select(F.lit("A").alias("order_book_id"), "date")
    assert list(complete.completion_range(full, days, "2024-01-31").first()) == [None, None]


# ---------------------------------------------------------------- calendar


def test_calendar_lookups(spark):
    holidays = spark.createDataFrame([(day("2024-01-10"),)], "date date")
    days = cal.weekdays(spark, "2024-01-01", "2024-01-31", holidays)
    assert days.count() == 22
    look = {str(r.date): r for r in cal.day_lookup(days, 2).collect()}
    sat = look["2024-01-13"]
    assert (str(sat.latest_trading), str(sat.next_trading), str(sat.trading_n_ago)) == ("2024-01-12", "2024-01-15", "2024-01-09")
    assert str(cal.latest_day(days, "2024-01-14").first().date) == "2024-01-12"
    r = cal.default_range(days, "2024-01-14", 3).first()
    assert (str(r.start_date), str(r.end_date), r.trading_days) == ("2024-01-09", "2024-01-12", 3)


def test_completed_day(spark):
    days = cal.weekdays(spark, "2024-01-08", "2024-01-12")
    ts = spark.createDataFrame([("2024-01-09 17:59:00",), ("2024-01-09 18:00:00",), ("2024-01-13 10:00:00",)], "t string")
    got = cal.completed_day(ts.select(F.col("t").cast("timestamp").alias("ts")), "ts", days).orderBy("ts").collect()
    assert [str(r.completed_day) for r in got] == ["2024-01-08", "2024-01-09", "None"]
    assert cal.session_hours("09:31-11:30,13:01-15:00") == (571, 900)
    with pytest.raises(ValueError):
        cal.session_hours("whenever")


def test_dates_from_json(spark, tmp_path):
    (tmp_path / "days.json").write_text(json.dumps(["2024-01-03", "2024-01-02", "2024-02-01"]))
    got = cal.read_trading_dates(spark, str(tmp_path / "days.json"), end="2024-01-31").collect()
    assert [(str(r.date), r.trade_seq) for r in got] == [("2024-01-02", 1), ("2024-01-03", 2)]


# ---------------------------------------------------------------- cleaning


def test_dedup_with_a_hot_key(spark):
    df = spark.range(30000).select(
        F.when(F.col("id") < 20000, "A").otherwise(F.concat(F.lit("S"), F.col("id").cast("string"))).alias("order_book_id"),
        F.lit("2024-01-01").cast("date").alias("date"), F.col("id").alias("v"))
    out = clean.dedup(df, ["v"])
    assert out.count() == 10001 and out.where("order_book_id = 'A'").first().v == 19999
    assert clean.dedup(df, ["v"], "first").where("order_book_id = 'A'").first().v == 0
    dup = clean.duplicate_keys(df).first()
    assert (dup.duplicated_keys, dup.extra_rows) == (1, 19999)


def test_abnormal_bounds(spark):
    df = make_bars(spark, {"A": [10000.0, 10000.01, 0.1, 0.0999, 0.0, -1.0, None]})
    df = df.withColumns({c: F.col("close") for c in ("open", "high", "low")})
    assert [r.close for r in clean.drop_abnormal(df).orderBy("date").collect()] == [10000.0, 0.1]
    got = {(r.rule, r.price_column): r.n for r in quality.abnormal_prices(df).collect()}
    assert (got["too_high", "close"], got["too_low", "close"], got["not_positive", "close"]) == (1, 3, 2)
    assert clean.removed_symbols(df).first().bad_rows == 5


def test_steep_cohort_falls_back(spark):
    def run(angles):
        rows = [("A", day(f"2024-01-{i + 1:02d}"), a) for i, a in enumerate(angles)]
        return clean.steep_slopes(spark.createDataFrame(rows, "order_book_id string, date date, ma10_angle double")).count()

    assert run([0.0, 2.0, 0.7]) == 1 and run([0.0, 0.7, 0.6]) == 2 and run([0.1, -0.2, None]) == 2


def test_casts_and_names(spark):
    df = spark.createDataFrame([("A", "2024-01-01", "1.5"), ("A", "bad", "x")], "code string, trade_date string, vol string")
    out = clean.to_doubles(clean.parse_dates(clean.standard_names(df)), ["volume"]).collect()
    assert [(str(r.date), r.volume) for r in out] == [("2024-01-01", 1.5), ("None", None)]


def test_merge_prefers_new(spark):
    old = spark.createDataFrame([("A", day("2024-01-01"), 1.0), ("A", day("2024-01-02"), 2.0)], "order_book_id string, date date, close double")
    new = spark.createDataFrame([("A", day("2024-01-02"), 9.0), ("A", day("2024-01-03"), 3.0)], old.schema)
    assert [r.close for r in clean.merge_update(old, new).orderBy("date").collect()] == [1.0, 9.0, 3.0]


# ---------------------------------------------------------------- bars, joins, pools


def test_bars_order_and_ties(spark):
    t = spark.createDataFrame(
        [(1, "2024-01-01", 5.0, 1, 10), (1, "2024-01-01", 4.0, 2, 11), (1, "2024-01-01", 7.0, 3, 12), (1, "2024-01-01", 3.0, 4, 12)],
        "s bigint, d string, p double, q int, seq bigint")
    by_number = bar_source.daily_bars(t, "s", F.col("d").cast("date"), "p", "q", F.col("p") * F.col("q"), sequence="seq").first()
    assert (by_number.open, by_number.close, by_number.high, by_number.low) == (5.0, 7.0, 7.0, 3.0)
    by_cols = bar_source.daily_bars(t, "s", F.col("d").cast("date"), "p", "q", F.col("p") * F.col("q"), ["seq", "q"]).first()
    assert (by_cols.open, by_cols.close, by_cols.volume, by_cols.amount, by_cols.trades) == (5.0, 3.0, 10.0, 46.0, 4)
    with pytest.raises(ValueError):
        bar_source.daily_bars(t, "s", "d", "p", "q", "p")


def test_dual_adjustment(spark):
    post = make_bars(spark, {"A": [1560.49]})
    pre = make_bars(spark, {"A": [34.56]})
    row = bar_source.adjustment_check(bar_source.dual_adjusted(post, pre)).first()
    assert round(row.adjust_ratio, 2) == 45.15 and row.plausible


def test_large_orders(spark):
    rows = [("A", day("2024-01-01"), float(i), 10.0) for i in range(1, 11)]
    t = spark.createDataFrame(rows, "order_book_id string, date date, size double, amount double")
    assert bar_source.large_order_ratio(t).first().large_order_ratio == pytest.approx(0.1)  # p90 = 9.1


def test_outer_join_needs_a_common_column(spark):
    a, b = spark.range(3).toDF("x"), spark.range(5).toDF("y")
    with pytest.raises(ValueError):
        joins.outer_on_common(a, b)
    got = joins.side_by_side(a, "x", b, "y").orderBy("ordinal").collect()
    assert [(r.ordinal, r.x, r.y) for r in got] == [(1, 0, 0), (2, 1, 1), (3, 2, 2), (4, None, 3), (5, None, 4)]


def test_pools(spark):
    s = spark.createDataFrame([("B", 5.0), ("A", 5.0), ("C", None), ("D", 9.0)], "order_book_id string, composite_score double")
    got = pools.pool(s, "core").orderBy("rank").collect()
    assert [(r.order_book_id, r.rank) for r in got] == [("D", 1), ("A", 2), ("B", 3)]
    stats = pools.pool_statistics({"core": pools.pool(s, "core", size=1), "watch": pools.pool(s, "watch")}).first()
    assert (stats.core_size, stats.watch_size, stats.distinct_symbols) == (1, 3, 3)


def test_resolve_prefers_the_first_market(spark):
    known = spark.createDataFrame([("1.XSHG",), ("1.XSHE",), ("2.XSHG",), ("3",)], "order_book_id string")
    codes = spark.createDataFrame([("1",), ("2",), ("3",), ("4",)], "code string")
    got = {r.code: r.order_book_id for r in pools.resolve_codes(codes, known).collect()}
    assert got == {"1": "1.XSHE", "2": "2.XSHG", "3": "3"}


# ---------------------------------------------------------------- files and schema


def test_json_forms(spark, tmp_path):
    forms = {"records": [{"a": 1, "b": "x"}, {"a": 2, "b": "y"}], "lists": {"a": [1, 2], "b": ["x", "y"]}, "one": {"a": 1, "b": "x"}}
    for name, data in forms.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(data))
        got = [(r.a, r.b) for r in tables.load_json(spark, str(tmp_path / f"{name}.json")).orderBy("a").collect()]
        assert got == ([(1, "x")] if name == "one" else [(1, "x"), (2, "y")])
    tables.json_to_table(spark, str(tmp_path / "lists.json"), str(tmp_path), "t")
    assert tables.load_table(spark, str(tmp_path), "t").count() == 2
    with pytest.raises(ValueError):
        tables.load(spark, "x.xlsx")


def test_snapshot_rerun_replaces_only_itself(spark, tmp_path):
    base = str(tmp_path)
    tables.write_snapshot(spark.range(3), base, "s", "20240101_000000")
    tables.write_snapshot(spark.range(5), base, "s", "20240102_000000")
    tables.write_snapshot(spark.range(4), base, "s", "20240102_000000")
    assert tables.latest_snapshot(spark, base, "s").count() == 4
    assert tables.load_table(spark, base, "s").count() == 7


def test_user_schemas(spark, tmp_path):
    reg = str(tmp_path / "schemas")
    schema.save_user_schema(spark, schema.user_schema("mine", {"id": "string", "v": "float64"}, ["id"]), reg)
    schema.save_user_schema(spark, schema.user_schema("mine", {"id": "string", "v": "int64", "w": "date"}, ["id"], "1.1"), reg)
    assert schema.list_user_schemas(spark, reg).count() == 2
    got = schema.load_user_schema(spark, "mine", reg)
    assert got.columns == ("id", "v", "w") and got.struct()["v"].dataType.simpleString() == "bigint"
    assert schema.find_schema("mine", {"mine": got}) is got
    with pytest.raises(ValueError):
        schema.find_schema("other")


def test_catalog(spark):
    assert len(schema.FIELDS) == 63
    assert schema.fields_by("solvency") == ["debt_to_equity", "current_ratio"]
    assert "close" in schema.required_fields() and "macd" in schema.required_fields(False)
    assert schema.lineage(spark).count() > 5
    key = schema.TABLES["factors"].struct()["factor_name"].metadata
    assert key["primary_key"] and not key["partition"]


def test_gate(spark):
    bars = make_bars(spark, {"A": [1.0]})
    assert schema.gate(bars) is bars
    for bad in (bars.drop("date"), bars.where("false"), bars.withColumn("close", F.lit("x"))):
        with pytest.raises(ValueError):
            schema.gate(bad)


def test_samples_are_repeatable(spark):
    a = samples.sample_bars(spark, 3, "2024-01-01", "2024-01-31")
    assert a.count() == 69 and a.exceptAll(samples.sample_bars(spark, 3, "2024-01-01", "2024-01-31")).isEmpty()
    assert a.where("high < greatest(open, close) OR low > least(open, close)").isEmpty()
    v = samples.sample_values(spark, 2, "2024-01-01", "2024-01-05", {"pe_ratio": (5.0, 50.0)})
    assert v.where("pe_ratio NOT BETWEEN 5 AND 50").isEmpty()


def test_rows_to_frames_of_no_result(spark):
    bad, = tables.batch_sql(spark, [("SELECT * FROM nowhere", None)])
    assert bad.columns == [] and np.isscalar(bad.count())


def test_gaps_after_the_first_month_are_filled(spark):
    bars = make_bars(spark, {"A": [1.0] * 90})
    kept = bars.where((F.col("date") < "2024-01-10") | (F.col("date") > "2024-03-20"))
    want = int(np.busday_count("2024-01-10", "2024-03-21"))
    assert complete.missing_dates(kept).count() == want
    done = complete.complete(kept)
    assert done.where("is_filled").count() - done.where("is_filled and date > '2024-03-20'").count() == want
    assert complete.fill_quality(kept, complete.complete(kept, max_fill_days=30)).first()["quality"] < 0.5


def test_a_new_day_lands_on_a_full_store(spark):
    bars = make_bars(spark, {"A": [float(i) for i in range(6)]})
    stored, fetched = bars.where("date < '2024-01-06'"), bars.where("date = '2024-01-06'")
    assert complete.top_up(stored, fetched).count() == 6


def test_dedup_needs_a_key(spark):
    with pytest.raises(ValueError):
        clean.dedup(spark.range(5), ["id"])


def test_merge_update_keeps_the_columns_of_both_sides(spark):
    old = spark.createDataFrame([("A", 1, 2.0, 7.0), ("B", 1, 3.0, 8.0)], "order_book_id string, date int, close double, pe double")
    new = spark.createDataFrame([("A", 1, 2.5, 9), ("A", 1, 2.25, 8), ("C", 1, 4.0, 7)], "order_book_id string, date int, close double, n int")
    got = {r["order_book_id"]: tuple(r)[2:] for r in clean.merge_update(old, new, order=["close"]).collect()}
    assert got == {"A": (2.5, 7.0, 9), "B": (3.0, 8.0, None), "C": (4.0, None, 7)}


def test_files_are_cleaned_each_for_itself(spark, tmp_path):
    bars = make_bars(spark, {"A": [1.0, 2.0]})
    bars.write.parquet(f"{tmp_path}/one.parquet")
    bars.unionByName(bars).write.parquet(f"{tmp_path}/two.parquet")
    tables.clean_files(spark, [f"{tmp_path}/one.parquet", f"{tmp_path}/two.parquet"], f"{tmp_path}/out")
    out = spark.read.parquet(f"{tmp_path}/out")
    assert {r["source_file"]: r["count"] for r in out.groupBy("source_file").count().collect()} == {"one.parquet": 2, "two.parquet": 2}


def test_an_older_snapshot_keeps_its_own_rows(spark, tmp_path):
    bars = make_bars(spark, {"A": [1.0, 2.0]})
    tables.write_snapshot(bars, str(tmp_path), "scores", "20240131_180000")
    tables.write_snapshot(bars.limit(1), str(tmp_path), "scores", "20230110_180000")
    assert tables.snapshot(spark, str(tmp_path), "scores", "20230110_180000").count() == 1
    assert tables.latest_snapshot(spark, str(tmp_path), "scores").count() == 2


def test_bars_keep_every_price(spark):
    """Negative, finer than a tick, and very large prices."""
    trades = spark.createDataFrame(
        [("A", "2024-01-01", 2, -1.25), ("A", "2024-01-01", 1, 1.23456), ("A", "2024-01-01", 3, 2e10)],
        "s string, d string, n long, p double").selectExpr("*", "1.0D AS one")
    bar = bar_source.daily_bars(trades, "s", "d", "p", "one", "p", sequence="n")
    row = bar.first()
    assert (row["open"], row["high"], row["low"], row["close"]) == (1.23456, 2e10, -1.25, 2e10)
    assert "SortAggregate" not in bar._jdf.queryExecution().executedPlan().toString()
