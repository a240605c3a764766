"""Plan shapes that have to hold at scale."""
from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from conftest import day, make_bars
from pyspark.sql import functions as F

from barloom.functions import files, ranks, reuse
from barloom.operators import clean, complete, indicators as ind, pools, research
from barloom.plans import bindings, jobs
from barloom.sources import bars as bar_source, calendar as cal


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_bars_aggregate_by_hash_and_prune_the_scan(spark, sf):
    bars = bindings.trade_bars(spark, sf)
    assert "SortAggregate" not in plan(bars) and "partial_min" in plan(bars)
    closes = bars.where(F.col("date") >= "2000-01-01").select("order_book_id", "date", "close")
    text = plan(closes)
    assert "GreaterThanOrEqual(l_shipdate" in text and "l_discount" not in text


def test_days_join_without_a_shuffle_of_the_rows(spark):
    bars = make_bars(spark, {"A": [1.0, 2.0, 3.0]})
    text = plan(research.forward_return(bars, cal.market_days(bars), 1))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text and "CartesianProduct" not in text


def test_gap_filling_joins_nothing(spark):
    text = plan(complete.complete(make_bars(spark, {"A": [1.0, 2.0]})))
    assert "Join" not in text and text.count("Exchange hashpartitioning") == 1


def test_dedup_collapses_before_the_shuffle(spark):
    text = plan(clean.dedup(make_bars(spark, {"A": [1.0]}), ["volume"]))
    assert "partial_max_by" in text and "Window" not in text


def test_pool_keeps_only_its_size(spark):
    s = spark.createDataFrame([("A", 1.0)], "order_book_id string, composite_score double")
    assert "TakeOrderedAndProject" in plan(pools.pool(s, "core"))


def test_macd_shuffles_once(spark):
    assert plan(ind.macd(make_bars(spark, {"A": [1.0, 2.0]}))).count("Exchange hashpartitioning") == 1


def test_lookup_join_with_a_heavy_key(spark):
    keys = np.concatenate([np.full(5000, 1), np.arange(2, 10002)])
    rows = spark.createDataFrame(pd.DataFrame({"k": keys, "v": np.arange(len(keys))}))
    table = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).select(
        "k", (F.col("k") * 10).alias("w"), (F.col("n") * ranks.HEAVY_SHARE > len(keys)).alias("_heavy"))
    assert table.where("_heavy").count() == 1
    out = ranks.join_lookup(rows, table, ["k"])
    assert out.count() == len(keys) and out.where("w <> k * 10").isEmpty()


def test_large_orders_with_a_hot_symbol_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({
        "order_book_id": np.where(rng.random(6000) < 1 / 3, "HOT", [f"S{i}" for i in rng.integers(0, 2000, 6000)]),
        "date": [day("2024-01-01") if x < 0.5 else day("2024-01-02") for x in rng.random(6000)],
        "size": rng.integers(1, 40, 6000).astype(float), "amount": rng.integers(1, 1000, 6000).astype(float)})
    got = bar_source.large_order_ratio(spark.createDataFrame(pdf)).toPandas()
    cut = pdf.groupby("order_book_id")["size"].quantile(0.9)
    pdf["big"] = np.where(pdf["size"] > pdf["order_book_id"].map(cut), pdf["amount"], 0.0)
    want = pdf.groupby(["order_book_id", "date"]).agg(b=("big", "sum"), a=("amount", "sum")).reset_index()
    both = want.merge(got, on=["order_book_id", "date"])
    assert len(both) == len(want) == len(got)
    assert np.allclose(both["b"] / both["a"], both["large_order_ratio"])


def test_checkpoint_folder_is_ready(spark):
    assert reuse.checkpoint_folder(spark) == reuse.checkpoint_folder(spark)
    assert reuse.scratch_folder(spark, "x") != reuse.scratch_folder(spark, "x")
    df = reuse.materialised(spark.range(5))
    assert df.count() == 5
    path = reuse.scratch_folder(spark, "gone")
    spark.range(3).write.parquet(path)
    assert reuse.drop_scratch(spark) >= 1 and not files.exists(spark, path) and reuse.drop_scratch(spark) == 0


@pytest.mark.parametrize("method", ["forward", "backward", "linear"])
def test_filled_rows_never_repeat_a_day(spark, method):
    days = [0, 1, 5, 6, 14, 15]
    bars = make_bars(spark, {"A": [float(i) for i in range(16)]})
    kept = bars.where(F.dayofmonth("date").isin([d + 1 for d in days]))
    out = complete.complete(kept, method)
    assert out.groupBy("order_book_id", "date").count().where("count > 1").isEmpty()
    assert out.where(~F.col("is_filled")).count() == len(days)


def test_validation_scores_are_computed_once(spark):
    days = [day(f"2024-01-{d:02d}") for d in range(1, 13)]
    bars = spark.createDataFrame([(s, d, 10.0 + i + k) for k, s in enumerate("AB") for i, d in enumerate(days)],
                                 "order_book_id string, date date, close double")
    scores = bars.where(F.col("date") == days[-1]).withColumn("composite_score", F.col("close"))
    found = jobs.validate_scores(scores, bars, ["composite_score"])
    plan = found["extremes"]._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and {r.side: r.n for r in found["extremes"].collect()} == {"top": 2, "bottom": 2}


def test_order_size_share_is_counted_with_the_bars(spark, sf):
    bars = bindings.sized_bars(spark, sf)
    text = plan(bars)
    assert "SortMergeJoin" not in text and "SortAggregate" not in text
    rows = [("A", 1.0, 10.0), ("A", 9.0, 30.0), (None, 9.0, 5.0), ("B", None, 2.0), ("B", None, None), ("C", 2.0, None)]
    ticks = spark.createDataFrame([(s, day("2024-01-01"), 1.0, z, a, k) for k, (s, z, a) in enumerate(rows)],
                                  "order_book_id string, date date, price double, size double, amount double, k long")
    made = bar_source.daily_bars(bar_source.with_large_sizes(ticks), "order_book_id", "date", "price", "size", "amount",
                                 sequence="k", large_from="large_from")
    assert {r.order_book_id: r.large_order_ratio for r in made.collect()} == {"A": 0.75, None: None, "B": 0.0, "C": None}
    assert {r.order_book_id: r.large_order_ratio for r in bar_source.large_order_ratio(ticks).collect()} == {"A": 0.75, "B": 0.0, "C": None}
