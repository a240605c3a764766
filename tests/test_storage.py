"""Buckets, symbol lists, sketches of files, deliveries, and ranks inside ranges."""
from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pytest
from conftest import make_bars
from pyspark.sql import functions as F

from barloom.operators import indicators as ind, joins, research, sketches
from barloom.sources import landings, store, tables
from barloom.sources.bars import dual_adjusted


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def bucketed(spark, bars, path):
    name = f"t_{uuid.uuid4().hex[:8]}"
    tables.save_bucketed(bars, name, str(path), 4)
    return spark.table(name)


def test_bucketed_bars_need_no_exchange(spark, tmp_path):
    bars = make_bars(spark, {f"S{k}": [float(i + k) for i in range(30)] for k in range(9)})
    a, b = bucketed(spark, bars, tmp_path / "a"), bucketed(spark, bars, tmp_path / "b")
    # the second lets a join by symbol and day use rows that are dealt by symbol alone
    wanted = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.requireAllClusterKeysForCoPartition": "false"}
    old = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        for df in (ind.sma(a, (5,)), ind.macd(a), dual_adjusted(a, b), joins.reconcile(a, b, ["close"])):
            assert "Exchange" not in plan(df)
        assert dual_adjusted(a, b).where("close = close_pre").count() == 270
        assert joins.reconcile(a, b, ["close"]).where("differs").isEmpty()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sorted(map(tuple, ind.sma(a, (5,)).select("order_book_id", "date", "sma_5").collect())) == sorted(
        map(tuple, ind.sma(bars, (5,)).select("order_book_id", "date", "sma_5").collect()))


def test_long_symbol_lists_are_joined(spark, tmp_path):
    bars = make_bars(spark, {f"S{k:03d}": [1.0, 2.0] for k in range(90)})
    tables.save_table(bars, str(tmp_path), "bars")
    short = tables.load_market_data(spark, str(tmp_path), ["S001", "S002"])
    assert "PushedFilters: [In(order_book_id" in plan(short) and short.count() == 4
    wanted = [f"S{k:03d}" for k in range(3, 60)] + ["absent"]
    long = tables.load_market_data(spark, str(tmp_path), wanted)
    assert "BroadcastHashJoin" in plan(long) and "In(order_book_id" not in plan(long)
    assert long.count() == 114 and long.where("order_book_id IN ('S000', 'S001', 'S060')").isEmpty()


def test_old_files_are_not_read_again(spark, tmp_path):
    base = str(tmp_path)
    df = spark.range(20000).select(F.col("id"), (F.col("id") % 997).cast("double").alias("x"), F.when(F.col("id") % 5 > 0, F.col("id").cast("string")).alias("s"))
    df.where("id < 8000").coalesce(1).write.parquet(f"{base}/d/one")
    pattern, store_path = f"{base}/d/*/*.parquet", f"{base}/sketches"
    assert len(sketches.sketch_new_files(spark, pattern, store_path, ["x", "s"])) == 1
    assert sketches.sketch_new_files(spark, pattern, store_path, ["x", "s"]) == []
    df.where("id >= 8000").repartition(3).write.parquet(f"{base}/d/two")
    assert len(sketches.sketch_new_files(spark, pattern, store_path, ["x", "s"])) == 3
    got = {r["column"]: r for r in sketches.united(spark, store_path).collect()}
    assert (got["x"]["files"], got["x"]["rows"], got["s"]["nulls"], got["x"]["low"], got["x"]["high"]) == (4, 20000, 4000, 0.0, 996.0)
    assert got["x"]["distinct"] == pytest.approx(997, rel=4 * sketches.DISTINCT_ERROR)
    assert got["s"]["distinct"] == pytest.approx(16000, rel=4 * sketches.DISTINCT_ERROR)
    assert got["x"]["p50"] == pytest.approx(498, abs=997 * sketches.RANK_ERROR) and got["s"]["p50"] is None


def test_late_and_repeated_deliveries(spark, tmp_path):
    rng = np.random.default_rng(3)
    n = 900
    pdf = pd.DataFrame({"symbol": rng.choice(["A", "B", "HOT"], n, p=[0.1, 0.1, 0.8]), "number": np.arange(n),
                        "day": pd.to_datetime("2024-01-20") + pd.to_timedelta(rng.integers(0, 40, n), "D"),
                        "price": rng.integers(100, 900, n) / 4.0, "size": rng.integers(1, 9, n).astype(float)})
    ticks = spark.createDataFrame(pdf).withColumn("amount", F.col("price") * F.col("size"))
    base = str(tmp_path)

    def deliver(stamp, name, rows):
        commit = store.Commit(spark, base, stamp)
        months = landings.land(commit, name, landings.partial_bars(rows, "symbol", "day", "price", "size", "amount", ["number"]))
        commit.publish()
        return months

    assert deliver("1", "a", ticks.where("number % 3 > 0")) == ["2024-01", "2024-02"]
    assert deliver("2", "b", ticks.where("number % 3 = 0 AND day < '2024-02-01'")) == ["2024-01"]
    assert deliver("3", "a", ticks.where("number % 3 > 0")) == []
    deliver("4", "c", ticks.where("number % 3 = 0 AND day >= '2024-02-01'"))
    got = landings.finished(store.read(spark, base, "partial_bars")).toPandas().set_index(["order_book_id", "date"]).sort_index()
    pdf["amount"] = pdf["price"] * pdf["size"]
    g = pdf.sort_values("number").groupby(["symbol", pdf["day"].dt.date])
    want = g.agg(open=("price", "first"), high=("price", "max"), low=("price", "min"), close=("price", "last"), volume=("size", "sum"),
                 amount=("amount", "sum"), trades=("price", "size")).sort_index()
    assert np.allclose(got[list(want.columns)].to_numpy(float), want.to_numpy(float)) and len(got) == len(want)


def test_spearman_in_ranges_equals_ranks(spark):
    """Ties, a value with a third of all rows, infinities, nulls, both zeros, and a constant column."""
    rng = np.random.default_rng(8)
    n = 4000
    y = rng.normal(size=n)
    cols = {
        "smooth": y + rng.normal(size=n), "heavy": np.where(rng.random(n) < 0.34, 0.25, y * 2), "few": rng.integers(0, 5, n).astype(float),
        "holes": np.where(rng.random(n) < 0.5, np.nan, -y), "odd": np.where(rng.random(n) < 0.01, np.inf, y ** 3),
        "zeros": np.where(rng.random(n) < 0.5, 0.0, -0.0) + np.where(rng.random(n) < 0.3, y, 0.0), "flat": np.full(n, 7.0)}
    pdf = pd.DataFrame({**cols, "y": np.round(y, 1)})
    df = spark.createDataFrame(pdf).repartition(5)
    got = {r["indicator"]: r["spearman"] for r in research.spearman_by_indicator(df, list(cols), "y", 16).collect()}
    for c in cols:
        part = pdf[np.isfinite(pdf[c])]
        want = part[c].rank().corr(part["y"].rank())
        assert (got[c] is None or np.isnan(got[c])) if np.isnan(want) else got[c] == pytest.approx(want, abs=1e-9), c


def test_spearman_shuffles_the_long_rows_twice(spark):
    df = spark.createDataFrame(pd.DataFrame(np.random.default_rng(1).normal(size=(500, 3)), columns=["a", "b", "y"]))
    text = plan(research.spearman_by_indicator(df, ["a", "b"], "y"))
    assert text.count("Exchange hashpartitioning(i#") <= 7 and "SortMergeJoin" not in text and "NestedLoop" not in text
    assert sum("_salt" in line for line in text.splitlines() if "Exchange hashpartitioning" in line) <= 2


def test_spearman_shuffles_the_long_rows_once(spark):
    df = spark.createDataFrame(pd.DataFrame(np.random.default_rng(1).normal(size=(500, 3)), columns=["a", "b", "y"]))
    lines = [x for x in plan(research.spearman_by_indicator(df, ["a", "b"], "y")).splitlines() if "Exchange hashpartitioning" in x]
    assert sum("i#" in x and "_salt" in x for x in lines) == 1 and sum("_r__y" in x and "_salt" in x for x in lines) == 1
