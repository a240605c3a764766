from __future__ import annotations

import pytest

from barloom.operators import scoring

BASE = {
    "order_book_id": "A", "close": 100.0, "sma_5": 3.0, "sma_10": 2.0, "sma_20": 1.0, "ma10_angle": 0.0,
    "year_high": 90.0, "year_low": 10.0, "volatility_20d": 0.1, "pct_change": 0.01, "volume_ratio": 2.0,
    "main_net_inflow_ratio": 0.1, "large_order_ratio": 0.5, "volume_trend": "increasing", "rsi_14": 60.0,
    "macd_diff": 2.0, "macd_dea": 1.0, "macd_hist": 2.0, "stoch_k": 50.0, "stoch_d": 40.0, "boll": 95.0,
    "boll_up": 105.0, "boll_down": 85.0, "boll_std": 4.0, "drawdown_from_high": 0.05,
    "distance_to_support": 0.2, "support_broken": False, "risk_reward_ratio": 4.0,
}
SCHEMA = ", ".join(
    f"{k} {'string' if k in ('order_book_id', 'volume_trend') else 'boolean' if k == 'support_broken' else 'double'}"
    for k in BASE) + ", n int, industry string, market_cap double"

# (sub-score, changed inputs, expected): each rule, both ends of closed ranges, up / down / no angle
CASES = [
    ("score_arrangement", {}, 30), ("score_arrangement", {"sma_20": 2.5}, 21),
    ("score_arrangement", {"sma_10": 4.0}, 12), ("score_arrangement", {"sma_5": 0.0}, 3),
    ("score_arrangement", {"sma_5": None}, 3),
    ("score_slope", {"ma10_angle": 45.0}, 30), ("score_slope", {"ma10_angle": 15.0}, 25),
    ("score_slope", {"ma10_angle": 5.0}, 20), ("score_slope", {"ma10_angle": 4.9}, 15),
    ("score_slope", {"ma10_angle": -5.0}, 15), ("score_slope", {"ma10_angle": -15.0}, 10),
    ("score_slope", {"ma10_angle": -15.1}, 5), ("score_slope", {"ma10_angle": None}, 5),
    ("score_position", {}, 25), ("score_position", {"year_high": 100.0}, 20),
    ("score_position", {"year_high": 110.0}, 15), ("score_position", {"year_high": 200.0, "year_low": 101.0}, 0),
    ("score_position", {"year_high": 200.0}, 8), ("score_position", {"year_high": None, "year_low": None}, 8),
    ("score_stability", {}, 15), ("score_stability", {"volatility_20d": 0.15}, 10),
    ("score_stability", {"volatility_20d": 0.25}, 10), ("score_stability", {"volatility_20d": 0.35}, 5),
    ("score_stability", {"volatility_20d": 0.36}, 0), ("score_stability", {"volatility_20d": None}, 0),
    ("score_volume_price", {"ma10_angle": 1.0}, 30),
    ("score_volume_price", {"ma10_angle": -1.0, "pct_change": -0.1, "volume_ratio": 0.6}, 30),
    ("score_volume_price", {"ma10_angle": 1.0, "volume_ratio": 1.5}, 25),
    ("score_volume_price", {"ma10_angle": -1.0, "pct_change": -0.1, "volume_ratio": 0.7}, 25),
    ("score_volume_price", {"ma10_angle": 1.0, "volume_ratio": 1.2}, 20),
    ("score_volume_price", {"ma10_angle": 1.0, "volume_ratio": 1.0}, 20),
    ("score_volume_price", {"ma10_angle": -1.0, "pct_change": -0.1, "volume_ratio": 0.8}, 15),
    ("score_volume_price", {"ma10_angle": 1.0, "volume_ratio": 0.8}, 12),
    ("score_volume_price", {"ma10_angle": -1.0, "pct_change": -0.1, "volume_ratio": 1.1}, 9),
    ("score_volume_price", {"ma10_angle": 0.0}, 3),
]
for _v, _up, _dn in [(0.09, 25, 15), (0.08, 20, 12), (0.05, 20, 12), (0.04, 15, 9), (0.03, 15, 9), (0.01, 12, 6),
                     (0.0, 6, 3), (-0.005, 6, 3), (-0.01, 3, 1), (-0.02, 0, 0)]:
    CASES += [("score_inflow", {"main_net_inflow_ratio": _v}, _up),
              ("score_inflow", {"main_net_inflow_ratio": _v, "ma10_angle": -10.0}, _dn)]
for _v, _up, _dn in [(0.41, 25, 15), (0.4, 20, 12), (0.3, 20, 12), (0.2, 15, 9), (0.15, 12, 6), (0.1, 9, 3),
                     (0.05, 6, 2), (0.01, 1, 1)]:
    CASES += [("score_institution", {"large_order_ratio": _v}, _up),
              ("score_institution", {"large_order_ratio": _v, "ma10_angle": -20.0}, _dn)]
for _v, _up, _dn in [("increasing", 20, 10), ("intermittent", 15, 8), ("stable", 10, 5), ("decreasing", 3, 3)]:
    CASES += [("score_volume_trend", {"volume_trend": _v}, _up),
              ("score_volume_trend", {"volume_trend": _v, "ma10_angle": -20.0}, _dn)]
for _v, _up, _dn in [(56.0, 30, 15), (55.0, 20, 10), (50.0, 15, 15), (40.0, 15, 15), (39.0, 5, 2), (None, 15, 15)]:
    CASES += [("score_rsi", {"rsi_14": _v}, _up), ("score_rsi", {"rsi_14": _v, "ma10_angle": -20.0}, _dn)]
CASES += [
    ("score_rsi", {"ma10_angle": None}, 15), ("score_inflow", {"ma10_angle": None}, 0),
    ("score_macd", {}, 30), ("score_macd", {"macd_hist": 0.0}, 20),
    ("score_macd", {"macd_diff": -2.0}, 5), ("score_macd", {"macd_diff": -2.0, "ma10_angle": -11.0}, 2),
    ("score_macd", {"macd_diff": 0.0}, 10), ("score_kdj", {}, 20), ("score_kdj", {"stoch_k": 80.0}, 10),
    ("score_kdj", {"stoch_k": 30.0}, 5), ("score_kdj", {"stoch_k": 40.0}, 0),
    ("score_boll", {}, 20), ("score_boll", {"boll_std": 10.0}, 15), ("score_boll", {"boll": 101.0}, 10),
    ("score_boll", {"boll": 101.0, "boll_down": 100.0}, 3),
    ("score_drawdown", {}, 40), ("score_drawdown", {"drawdown_from_high": 0.10}, 25),
    ("score_drawdown", {"drawdown_from_high": 0.20}, 25), ("score_drawdown", {"drawdown_from_high": 0.30}, 10),
    ("score_drawdown", {"drawdown_from_high": 0.31}, 0),
    ("score_drawdown", {"drawdown_from_high": 0.31, "ma10_angle": -50.0}, 0),
    ("score_support", {}, 35), ("score_support", {"distance_to_support": 0.15}, 25),
    ("score_support", {"distance_to_support": 0.05}, 25), ("score_support", {"distance_to_support": 0.04}, 10),
    ("score_support", {"distance_to_support": -0.1, "support_broken": True}, 10),
    ("score_support", {"distance_to_support": None, "support_broken": True}, 0),
    ("score_support", {"ma10_angle": None}, 15), ("score_support", {"distance_to_support": 0.2, "ma10_angle": -10.0}, 20),
    ("score_rr_ratio", {}, 25), ("score_rr_ratio", {"risk_reward_ratio": 3.0}, 20),
    ("score_rr_ratio", {"risk_reward_ratio": 2.0}, 20), ("score_rr_ratio", {"risk_reward_ratio": 1.0}, 15),
    ("score_rr_ratio", {"risk_reward_ratio": 0.5}, 5), ("score_rr_ratio", {"risk_reward_ratio": None}, 5),
]


def frame(spark, changes):
    rows = [tuple({**BASE, **c}[k] for k in BASE) + (i, c.get("industry"), c.get("market_cap"))
            for i, c in enumerate(changes)]
    return spark.createDataFrame(rows, SCHEMA)


def test_every_rule(spark):
    scored = scoring.score_bars(frame(spark, [c for _, c, _ in CASES])).orderBy("n").collect()
    wrong = [(case, row[case[0]]) for case, row in zip(CASES, scored) if row[case[0]] != case[2]]
    assert wrong == []


def test_weights():
    assert sum(scoring.dimension_weights("bull").values()) == pytest.approx(1.03)
    assert sum(scoring.dimension_weights("bear").values()) == pytest.approx(0.995)
    assert sum(scoring.dimension_weights("volatile").values()) == pytest.approx(1.055)
    assert scoring.dimension_weights("unheard") == scoring.dimension_weights("normal")


def test_adjustments_and_levels(spark):
    df = frame(spark, [{"industry": "科技", "market_cap": 2e10}, {"industry": "金融", "market_cap": 6e10},
                       {"industry": "x", "market_cap": 5e10}, {}])
    plain = df.drop("industry", "market_cap")
    base = scoring.score_bars(plain).first()["composite_score"]
    got = [r["composite_score"] for r in scoring.score_bars(df).orderBy("n").collect()]
    want = [min(100, base * f) for f in (1.15, 0.95 * 0.95, 1.0, 1.10)]
    assert got == pytest.approx(want)
    rows = spark.createDataFrame([(85.0,), (84.9,), (70.0,), (55.0,), (40.0,), (39.9,), (None,)], "composite_score double")
    codes = [r["score_level_code"] for r in scoring.levels(rows).collect()]
    assert codes == ["strong", "promising", "promising", "sideways", "weak", "high_risk", "high_risk"]
    other = scoring.levels(rows.limit(1), [25.0, 20.0, 15.0, 10.0]).first()
    assert other["score_level"] == "强势股"


def test_explain(spark):
    row = scoring.explain_score(scoring.score_bars(frame(spark, [{"sma_5": 0.0, "year_high": 500.0, "volatility_20d": 1.0}]))).first()
    assert "trend" in row["weak_dimensions"] and row["implied_factor"] == pytest.approx(1.10)
