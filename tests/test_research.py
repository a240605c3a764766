from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from conftest import make_bars
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from barloom.functions import ranks, student
from barloom.operators import research
from barloom.sources import calendar as cal


def one_column(spark, values):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double")


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.integers(-5, 5) | st.floats(-1e6, 1e6), min_size=1, max_size=60))
def test_quantiles_equal_numpy(spark, values):
    probs = [0.0, 0.1, 0.33, 0.5, 0.9, 1.0]
    row = ranks.exact_quantiles(one_column(spark, [*values, None, float("nan")]), "x", probs, [f"q{i}" for i in range(6)]).first()
    assert np.allclose(list(row), np.quantile(np.array(values, float), probs), rtol=1e-9, atol=1e-9)


def test_quantiles_by_group_with_a_hot_value(spark):
    rng = np.random.default_rng(0)
    a = np.concatenate([np.full(4000, 7.0), rng.normal(0, 10, 8000)])
    b = rng.normal(100, 1, 50)
    df = spark.createDataFrame(pd.DataFrame({"g": ["a"] * len(a) + ["b"] * len(b), "x": np.concatenate([a, b])}))
    got = {r.g: (r.lo, r.mid) for r in ranks.exact_quantiles(df, "x", [0.05, 0.5], ["lo", "mid"], by=["g"]).collect()}
    for g, v in (("a", a), ("b", b)):
        assert got[g] == pytest.approx(tuple(np.quantile(v, [0.05, 0.5])))


def test_ranks_do_not_depend_on_the_ranges(spark):
    x = np.random.default_rng(4).integers(0, 400, 3000)
    df = one_column(spark, x)
    frames = [ranks.cumulative_counts(df, "x", ranges=k).orderBy("x").collect() for k in (1, 3, 64)]
    assert frames[0] == frames[1] == frames[2]


def test_spearman_with_a_third_of_the_rows_on_one_value(spark):
    rng = np.random.default_rng(1)
    x = np.where(rng.random(9000) < 1 / 3, 5.0, rng.normal(0, 50, 9000).round(1))
    y = x * 0.3 + rng.normal(0, 20, 9000).round(1)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    row = research.spearman(df, "x", "y").first()
    want = np.corrcoef(pd.Series(x).rank(), pd.Series(y).rank())[0, 1]
    assert row.spearman == pytest.approx(want, abs=1e-10) and row.n == 9000


def test_p_values(spark):
    # t = 2.228139 with 10 degrees of freedom and t = 1.959964 at the normal limit have 5 %
    for t, v in ((2.2281388519649385, 10), (12.706204736432095, 1), (1.9599639845400545, 10**8)):
        r = t / np.sqrt(t * t + v)
        assert student.two_sided_p(r, v + 2) == pytest.approx(0.05, abs=1e-6)
    df = spark.createDataFrame([(1.0, 10), (0.0, 10), (None, 10)], "r double, n bigint")
    got = [r[0] for r in df.select(student.correlation_p_value(F.col("r"), F.col("n"))).collect()]
    assert got == [0.0, 1.0, None]


def test_forward_return_by_calendar_not_by_row(spark):
    days = make_bars(spark, {"A": [10.0, 11.0, 12.0, 13.0, 14.0]})
    gap = days.where(F.col("date") != "2024-01-03").withColumn("order_book_id", F.lit("B"))
    bars = days.unionByName(gap)
    out = research.forward_return(bars, cal.market_days(bars), 2).orderBy("order_book_id", "date").collect()
    got = [(r.order_book_id, r.date.day, round(r.return_2d, 6)) for r in out]
    assert got == [("A", 1, 0.2), ("A", 2, round(2 / 11, 6)), ("A", 3, round(2 / 12, 6)), ("B", 2, round(2 / 11, 6))]


def test_forward_grid(spark):
    bars = make_bars(spark, {"A": [float(i) for i in range(10, 22)], "B": [1.0] * 9})
    grid = research.forward_grid(bars, only_enough=True).collect()
    first = {r.n_days: r.ret for r in grid if r.date.day == 1}
    assert first == {n: pytest.approx(n / 10) for n in range(1, 11)}
    assert {r.order_book_id for r in grid} == {"A"}  # nine bars are not enough
    every = research.forward_grid(bars)
    assert every.where("order_book_id = 'B' AND enough").isEmpty() and every.where("order_book_id = 'B'").count() == 36
    short = research.short_returns(bars).where("order_book_id = 'A'").orderBy("date").first()
    assert (short.return_3d, short.return_5d) == (pytest.approx(0.2), pytest.approx(0.4))


def test_forward_grid_counts_a_close_of_zero(spark):
    bars = make_bars(spark, {"A": [4.0, 0.0, 5.0]})
    got = research.forward_grid(bars).select(F.dayofmonth("date"), "n_days", "ret").collect()
    assert sorted(map(tuple, got)) == [(1, 1, -1.0), (1, 2, 0.25)]  # no return from the close of zero itself


def test_rsi_surface_counts_a_close_of_zero(spark):
    bars = make_bars(spark, {"A": [4.0, 0.0, 5.0], "B": [4.0, 6.0]}).withColumn("rsi_14", F.lit(57.0))
    got = research.rsi_surface(research.forward_grid(bars, carry=["rsi_14"])).collect()
    want = {(55, 1): (2, -0.25, 0.75), (55, 2): (1, 0.25, 0.0)}
    assert {(r.rsi_center, r.n_days): (r["count"], r.median, r.std) for r in got} == want


def test_deciles_cover_all_rows(spark):
    x = np.random.default_rng(2).normal(0, 1, 1003)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "r": x * 2}))
    out = research.decile_returns(df, "x", "r").orderBy("quantile").collect()
    edges = np.percentile(x, np.arange(10, 100, 10))
    want = pd.Series(x).groupby(np.digitize(x, edges) + 1)
    assert [r["count"] for r in out] == list(want.count())
    assert np.allclose([r.median_r for r in out], want.median() * 2)
    assert np.allclose([r.std_r for r in out], want.std(ddof=0) * 2)


def test_discretise_with_repeated_edges(spark):
    x = [0.0] * 30 + list(range(1, 71))
    out = research.discretise(one_column(spark, x), "x").groupBy("x").agg(F.max("bucket").alias("b")).collect()
    bins = sorted(set(np.percentile(x, [i * 10 for i in range(11)])))
    want = np.digitize(sorted(set(x)), bins[:-1])
    assert [r.b for r in sorted(out, key=lambda r: r.x)] == list(want)


def test_quartiles_share_their_edges(spark):
    x = [1.0, 2.0, 3.0, 4.0, 5.0]
    df = spark.createDataFrame([(v, v * 10) for v in x], "x double, r double")
    assert list(research.quartile_means(df, "x", "r").first()) == [15.0, 25.0, 35.0, 45.0]


def test_distribution(spark):
    x = np.random.default_rng(9).gamma(2, 3, 500)
    row = research.distribution(one_column(spark, x), "x").first()
    z = (x - x.mean()) / x.std()
    assert row.skew == pytest.approx((z**3).mean()) and row.kurtosis == pytest.approx((z**4).mean() - 3)
    assert (row.median, row.p99) == (pytest.approx(np.median(x)), pytest.approx(np.percentile(x, 99)))


def test_trend_classes_overlap_at_ten(spark):
    df = spark.createDataFrame([("A", 10.0), ("B", -10.0), ("C", 31.0), ("D", None)], "order_book_id string, a double")
    r = research.angle_trends(df, "a").first()
    assert (r.symbols, r.strong_up, r.up, r.flat, r.down, r.strong_down) == (3, 1, 1, 2, 1, 0)


def test_labels(spark):
    df = spark.createDataFrame([(0.6, 0.01), (-0.4, 0.2), (0.1, 0.0001)], "r double, p double")
    got = [tuple(x) for x in df.select(research.strength_label(F.col("r"), F.col("p")), research.stars(F.col("p"))).collect()]
    assert got == [("strong, significant", "*"), ("moderate, not significant", ""), ("weak, significant", "***")]


def test_no_rows(spark):
    none = one_column(spark, [None, float("nan")])
    assert ranks.exact_quantiles(none, "x", [0.5], ["m"]).first().m is None
    assert research.histogram(none, "x").count() == 0
