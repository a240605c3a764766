from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from conftest import make_bars
from pyspark.sql import functions as F

from barloom.operators import indicators as ind, research


def column(df, name, symbol="A"):
    rows = df.where(F.col("order_book_id") == symbol).orderBy("date").select(name).collect()
    return [r[0] for r in rows]


def test_sma_needs_a_full_window_of_values(spark):
    df = ind.sma(make_bars(spark, {"A": [1.0, 2.0, None, 4.0, 5.0, 6.0]}), (3,))
    assert column(df, "sma_3") == [None, None, None, None, None, 5.0]


@pytest.mark.parametrize("n", [2, 5, 7, 12, 20, 30])
def test_sma_equals_pandas(spark, n):
    x = np.random.default_rng(n).normal(100, 5, 80)
    got = column(ind.sma(make_bars(spark, {"A": list(x)}), (n,)), f"sma_{n}")
    want = pd.Series(x).rolling(n).mean()
    assert np.allclose(np.array(got, dtype=float), want, equal_nan=True)


def test_rsi_edge_cases(spark):
    df = ind.rsi(make_bars(spark, {"A": [10.0] * 6, "B": [1.0, 2.0, 3.0, 4.0, 5.0], "C": [7.0]}), (3,))
    assert column(df, "rsi_3", "A") == [None] * 6  # neither gain nor loss
    assert column(df, "rsi_3", "B") == [None, None, 100.0, 100.0, 100.0]  # no loss
    assert column(df, "rsi_3", "C") == [None]


def test_rsi_value(spark):
    df = ind.rsi(make_bars(spark, {"A": [10.0, 12.0, 11.0, 14.0]}), (3,))
    # last three changes +2 -1 +3: mean gain 5/3, mean loss 1/3
    assert column(df, "rsi_3")[-1] == pytest.approx(100 - 100 / 6)


def test_rsi_on_an_edge_is_exact(spark):
    # gains 0.1 + 0.2 and losses 0.3 in cents, which binary fractions make unequal; then gains 0.06 and losses 0.14
    df = make_bars(spark, {"A": [1.0, 1.1, 1.3, 1.0], "B": [272.8, 272.86, 272.72, 272.72], "C": [float("inf"), 1.0, 2.0, 4.0]})
    out = ind.rsi(df, (3,), details=True)
    assert column(out, "rsi_3", "A")[-1] == 50.0
    assert column(out, "rsi_3", "B")[-1] == 30.0
    assert column(out, "rsi_3", "C")[-2:] == [0.0, 0.0]  # an infinite loss
    assert column(out, "avg_gain_3", "A")[-1] == pytest.approx(0.1) and column(out, "price_change", "A")[-1] == -0.3


@pytest.mark.parametrize("span", [2, 3, 5, 9, 30, 200])
def test_ema_equals_pandas_over_many_blocks(spark, span):
    x = 100 + np.cumsum(np.random.default_rng(7).normal(0, 1, 3000))
    got = column(ind.ema(make_bars(spark, {"A": list(x), "B": [5.0, 6.0]}), (span,)), f"ema_{span}")
    want = pd.Series(x).ewm(span=span, adjust=True).mean()
    assert np.allclose(got, want, rtol=1e-12)


def test_ema_rejects_span_one(spark):
    with pytest.raises(ValueError):
        ind.ema(make_bars(spark, {"A": [1.0]}), (1,))


def test_macd_equals_pandas(spark):
    x = pd.Series(100 + np.cumsum(np.random.default_rng(3).normal(0, 1, 1500)))
    df = ind.macd(make_bars(spark, {"A": list(x)}))
    dif = x.ewm(span=12).mean() - x.ewm(span=26).mean()
    assert np.allclose(column(df, "macd_dea"), dif.ewm(span=9).mean(), atol=1e-9)
    assert np.allclose(column(df, "macd_hist"), 2 * (dif - dif.ewm(span=9).mean()), atol=1e-9)


def test_extremes_from_pieces_equal_plain_windows(spark):
    x = np.random.default_rng(5).normal(100, 10, 600)
    df = ind.run(make_bars(spark, {"A": list(x)}), ind.year_range.stages(), ind.drawdown.stages(), ind.support.stages())
    high, low = pd.Series(x) + 1, pd.Series(x) - 1
    top = high.shift(1).rolling(250, min_periods=1).max()
    assert np.allclose(np.array(column(df, "year_high"), float), top, equal_nan=True)
    bottom = low.shift(1).rolling(250, min_periods=1).min()
    assert np.allclose(np.array(column(df, "year_low"), float), bottom, equal_nan=True)
    dd = 1 - pd.Series(x) / high.rolling(60, min_periods=1).max()
    assert np.allclose(column(df, "drawdown_from_high"), dd)
    sup = low.shift(1).rolling(20, min_periods=1).min()
    assert np.allclose(np.array(column(df, "distance_to_support"), float), (pd.Series(x) - sup) / sup, equal_nan=True)


def test_zero_volume_and_zero_price(spark):
    df = make_bars(spark, {"A": [0.0, 1.0, 2.0]}).withColumn("volume", F.lit(0.0))
    out = ind.run(df, ind.volume_ratio.stages(2), ind.changes.stages())
    assert column(out, "volume_ratio") == [None, None, None]
    assert column(out, "pct_change") == [None, None, 1.0]


def test_symbols_do_not_bleed(spark):
    a = list(np.random.default_rng(1).normal(50, 3, 90))
    b = list(np.random.default_rng(2).normal(9000, 300, 70))
    alone = ind.calculate_indicators(make_bars(spark, {"A": a})).orderBy("date").collect()
    both = ind.calculate_indicators(make_bars(spark, {"A": a, "B": b}))
    assert both.where("order_book_id = 'A'").orderBy("date").collect() == alone


def test_result_does_not_depend_on_partitioning(spark):
    bars = make_bars(spark, {s: list(np.random.default_rng(i).normal(50, 3, 60)) for i, s in enumerate("ABCD")})
    results = []
    for n in ("1", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        shuffled = bars.orderBy(F.xxhash64("date", "order_book_id", F.lit(n)))
        df = ind.calculate_indicators(shuffled, ["sma", "macd", "rsi_14", "stoch_k"])
        results.append(df.orderBy("order_book_id", "date").collect())
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1]


def test_registry_names(spark):
    bars = make_bars(spark, {"A": [1.0, 2.0, 3.0]})
    with pytest.raises(ValueError):
        ind.calculate_indicators(bars, ["sma", "no_such"])
    named = ind.catalog_names(ind.calculate_indicators(bars, ["MACD", "bollinger_upper"]))
    assert {"macd", "macd_signal", "bollinger_lower"} <= set(named.columns)
    assert not [c for c in named.columns if c.startswith("_t_")]


def test_one_exchange_for_many_indicators(spark):
    bars = make_bars(spark, {"A": [1.0, 2.0, 3.0]})
    plan = ind.scorer_inputs(bars)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def sorts(df):
    return df._jdf.queryExecution().executedPlan().toString().count(" Sort [")


def test_one_sort_for_many_indicators_and_the_forward_return(spark):
    bars = make_bars(spark, {"A": [1.0, 2.0], "B": [5.0, 6.0]})
    days = bars.select("date").distinct().withColumn("trade_seq", F.dayofmonth("date").cast("long"))
    df = research.forward_return(ind.calculate_indicators(bars), days, 1)
    assert sorts(df) == 1 and len(df.collect()) == 2
    assert sorts(ind.scorer_inputs(bars)) == 1


def test_ema_with_missing_values(spark):
    x = [None, 3.0, None, None, 8.0, 1.0, None, 4.0] * 40
    got = column(ind.ema(make_bars(spark, {"A": x}), (5,)), "ema_5")
    want = pd.Series(x, dtype=float).ewm(span=5, adjust=True, ignore_na=False).mean().where(pd.Series(x, dtype=float).notna())
    assert np.allclose(np.array(got, dtype=float), want, equal_nan=True)
