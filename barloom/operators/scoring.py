"""Rule-based scores: row-wise CASE expressions, one projection, no shuffle.

`up` is a ten-day angle above -10, `dn` at or below; most rules give a full mark in an up trend and
a reduced one otherwise. A missing angle matches neither and falls through to the last rule.
All ranges are closed at both ends and rules are tried in order.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barloom.functions.numeric import clip

VERSION = "1.0"

# fixed values: base weights, market factors, industry factors and level bounds
DIMENSIONS = ("trend", "capital", "technical", "risk")
BASE_WEIGHTS = {"trend": 0.45, "capital": 0.20, "technical": 0.20, "risk": 0.15}
MARKET_FACTORS = {
    "bull": (1.0, 1.4, 0.9, 0.8),
    "bear": (0.8, 1.3, 0.9, 1.3),
    "volatile": (0.9, 1.5, 1.0, 1.0),
    "normal": (1.0, 1.2, 0.9, 1.0),
}
INDUSTRY_FACTORS = {
    "科技": 1.15, "新能源": 1.15, "医药": 1.05, "消费": 1.05, "金融": 0.95, "资源": 0.95,
    "其他": 1.0,
}
LEVELS = [(85.0, "强势股", "strong"), (70.0, "潜力股", "promising"), (55.0, "震荡股", "sideways"),
          (40.0, "弱势股", "weak")]
LOWEST_LEVEL = ("高风险股", "high_risk")

SUB_SCORES = {
    "trend": ("score_arrangement", "score_slope", "score_position", "score_stability"),
    "capital": ("score_volume_price", "score_inflow", "score_institution", "score_volume_trend"),
    "technical": ("score_rsi", "score_macd", "score_kdj", "score_boll"),
    "risk": ("score_drawdown", "score_support", "score_rr_ratio"),
}


def _first(rules: Sequence[tuple[Column, float]], default: float) -> Column:
    cond, mark = rules[0]
    out = F.when(cond, F.lit(float(mark)))
    for cond, mark in rules[1:]:
        out = out.when(cond, F.lit(float(mark)))
    return out.otherwise(F.lit(float(default)))


def _trended(rules: Sequence[tuple[Column, float, float]], default: float) -> Column:
    """Each rule carries a mark for an up trend and one for a down trend."""
    up, dn = F.col("ma10_angle") > -10, F.col("ma10_angle") <= -10
    flat = []
    for cond, high, low in rules:
        flat += [(cond & up, high), (cond & dn, low)]
    return _first(flat, default)


def trend_parts() -> dict[str, Column]:
    s5, s10, s20 = F.col("sma_5"), F.col("sma_10"), F.col("sma_20")
    angle, close, vol = F.col("ma10_angle"), F.col("close"), F.col("volatility_20d")
    top, bottom = F.col("year_high"), F.col("year_low")
    return {
        "score_arrangement": _first(
            [((s5 > s10) & (s10 > s20), 30), (s5 > s10, 21), (s5 > s20, 12)], 3),
        "score_slope": _first(
            [(angle >= 45, 30), (angle >= 15, 25), (angle >= 5, 20), (angle.between(-5, 5), 15),
             (angle >= -15, 10)], 5),
        "score_position": _first(
            [(close > top, 25), (close > top * 0.95, 20), (close > top * 0.9, 15),
             (close < bottom, 0)], 8),
        "score_stability": _first(
            [(vol < 0.15, 15), (vol.between(0.15, 0.25), 10), (vol.between(0.25, 0.35), 5)], 0),
    }


def capital_parts() -> dict[str, Column]:
    chg, vr, angle = F.col("pct_change"), F.col("volume_ratio"), F.col("ma10_angle")
    rise, fall = (chg > 0) & (angle > 0), (chg < 0) & (angle < 0)
    flow, big, vt = (F.col("main_net_inflow_ratio"), F.col("large_order_ratio"),
                     F.col("volume_trend"))
    return {
        "score_volume_price": _first(
            [((rise & (vr > 1.5)) | (fall & (vr < 0.7)), 30),
             ((rise & (vr > 1.2)) | (fall & (vr < 0.8)), 25),
             (rise & vr.between(1.0, 1.2), 20), (fall & vr.between(0.8, 1.0), 15),
             (rise & vr.between(0.8, 1.0), 12), (fall & (vr > 1.0), 9)], 3),
        "score_inflow": _trended(
            [(flow > 0.08, 25, 15), (flow.between(0.05, 0.08), 20, 12),
             (flow.between(0.03, 0.05), 15, 9), (flow.between(0.01, 0.03), 12, 6),
             (flow.between(-0.005, 0.01), 6, 3), (flow.between(-0.01, -0.005), 3, 1)], 0),
        "score_institution": _trended(
            [(big > 0.4, 25, 15), (big.between(0.3, 0.4), 20, 12), (big.between(0.2, 0.3), 15, 9),
             (big.between(0.15, 0.2), 12, 6), (big.between(0.1, 0.15), 9, 3),
             (big.between(0.05, 0.1), 6, 2)], 1),
        "score_volume_trend": _trended(
            [(vt == "increasing", 20, 10), (vt == "intermittent", 15, 8),
             (vt == "stable", 10, 5)], 3),
    }


def technical_parts() -> dict[str, Column]:
    rsi, close = F.col("rsi_14"), F.col("close")
    diff, dea, hist = F.col("macd_diff"), F.col("macd_dea"), F.col("macd_hist")
    k, d = F.col("stoch_k"), F.col("stoch_d")
    mid, upper, lower, dev = (F.col(c) for c in ("boll", "boll_up", "boll_down", "boll_std"))
    return {
        "score_rsi": _trended([(rsi > 55, 30, 15), (rsi > 50, 20, 10), (rsi < 40, 5, 2)], 15),
        "score_macd": _trended(
            [((diff > 0) & (diff > dea) & (hist > 0), 30, 15), ((diff > 0) & (diff > dea), 20, 10),
             ((diff < 0) & (diff < dea), 5, 2)], 10),
        "score_kdj": _trended(
            [((k > d) & (k < 80), 20, 10), ((k > d) & (k >= 80), 10, 5), (k < d, 5, 2)], 0),
        "score_boll": _trended(
            [((close > mid) & (upper - lower > dev * 2.0), 20, 10), (close > mid, 15, 8),
             (close > lower, 10, 5)], 3),
    }


def risk_parts() -> dict[str, Column]:
    drop, dist, ratio = (F.col(c) for c in
                         ("drawdown_from_high", "distance_to_support", "risk_reward_ratio"))
    up, dn = F.col("ma10_angle") > -10, F.col("ma10_angle") <= -10
    return {
        "score_drawdown": _trended(
            [(drop < 0.10, 40, 20), (drop.between(0.10, 0.20), 25, 10),
             (drop.between(0.20, 0.30), 10, 5)], 0),
        "score_support": _first(
            [((dist > 0.15) & up, 35), ((dist > 0.15) & dn, 20),
             (dist.between(0.05, 0.15) & up, 25), (dist.between(0.05, 0.15) & dn, 15),
             ((dist < 0.05) & up, 10), ((dist < 0.05) & dn, 5),
             (F.col("support_broken"), 0)], 15),
        "score_rr_ratio": _trended(
            [(ratio > 3, 25, 15), (ratio.between(2, 3), 20, 12), (ratio.between(1, 2), 15, 8)], 5),
    }


PARTS = {"trend": trend_parts, "capital": capital_parts, "technical": technical_parts,
         "risk": risk_parts}


def dimension_score(df: DataFrame, dimension: str) -> DataFrame:
    """The sub-scores of one dimension and their sum."""
    df = df.withColumns(PARTS[dimension]())
    first, *rest = (F.col(c) for c in SUB_SCORES[dimension])
    return df.withColumn(f"{dimension}_score", sum(rest, first))


def dimension_weights(market: str = "normal") -> dict[str, float]:
    """Base weight times market factor; an unknown market counts as normal; never rescaled."""
    factors = MARKET_FACTORS.get(market, MARKET_FACTORS["normal"])
    return {d: BASE_WEIGHTS[d] * f for d, f in zip(DIMENSIONS, factors)}


def composite(df: DataFrame, market: str = "normal") -> DataFrame:
    df = df.withColumns(
        {f"{d}_score": F.least(F.col(f"{d}_score"), F.lit(100.0)) for d in DIMENSIONS})
    parts = [F.col(f"{d}_score") * F.lit(w) for d, w in dimension_weights(market).items()]
    return df.withColumn("composite_score", clip(sum(parts[1:], parts[0]), 0, 100))


def adjust(df: DataFrame) -> DataFrame:
    """Industry and size factors; an absent column counts as 1, a null size as small."""
    factor = F.lit(1.0)
    if "industry" in df.columns:
        by_name = F.lit(1.0)
        for name, f in INDUSTRY_FACTORS.items():
            by_name = F.when(F.col("industry") == name, F.lit(f)).otherwise(by_name)
        factor = factor * by_name
    if "market_cap" in df.columns:
        cap = F.col("market_cap")
        factor = factor * (F.when(cap > 5e10, 0.95).when(cap.between(1e10, 5e10), 1.0)
                           .otherwise(1.10))
    return df.withColumn("composite_score", clip(F.col("composite_score") * factor, 0, 100))


def levels(df: DataFrame, bounds: Sequence[float] | None = None) -> DataFrame:
    """Level label and its English code; a null score gets the lowest level."""
    cuts = list(bounds) if bounds else [b for b, _, _ in LEVELS]
    score = F.col("composite_score")
    label, code = F.lit(LOWEST_LEVEL[0]), F.lit(LOWEST_LEVEL[1])
    for cut, (_, name, short) in reversed(list(zip(cuts, LEVELS))):
        label = F.when(score >= cut, F.lit(name)).otherwise(label)
        code = F.when(score >= cut, F.lit(short)).otherwise(code)
    return df.withColumns({"score_level": label, "score_level_code": code})


def stamp(df: DataFrame, market: str, warnings: int | Column | None = None, count: int = 1, at: Column | None = None) -> DataFrame:
    """How the scores came about; `warnings` is the number of warnings on the input, `count` that of the run, `at` its
    time where several frames make one run."""
    weights = ",".join(f"{d}={w:.4f}" for d, w in dimension_weights(market).items())
    return df.withColumns({
        "_scorer_version": F.lit(VERSION),
        "_calculation_timestamp": F.current_timestamp() if at is None else at,
        "_market_environment": F.lit(market),
        "_weights_used": F.lit(weights),
        "_data_quality_warnings": (warnings if isinstance(warnings, Column) else F.lit(warnings)).cast("bigint"),
        "_calculation_count": F.lit(count).cast("bigint"),
    })


def score_bars(df: DataFrame, market: str = "normal", warnings: int | Column | None = None, count: int = 1,
               at: Column | None = None) -> DataFrame:
    """Scorer inputs in, scored bars out."""
    for d in DIMENSIONS:
        df = dimension_score(df, d)
    return stamp(levels(adjust(composite(df, market))), market, warnings, count, at)


def time_now(spark: SparkSession) -> Column:
    """The time of this call, the same in every frame it is given to."""
    return F.timestamp_micros(F.lit(spark.range(1).select(F.unix_micros(F.current_timestamp())).first()[0]))


def above(df: DataFrame, minimum: float = 65.0) -> DataFrame:
    return df.where(F.col("composite_score") >= minimum)


def simple_score(df: DataFrame) -> DataFrame:
    """Short form from one bar: change in steps, volume in steps, fixed marks for the rest."""
    change = F.when(F.col("open") > 0, (F.col("close") - F.col("open")) / F.col("open") * 100.0)
    df = df.withColumn("simple_change", F.coalesce(change, F.lit(0.0)))
    c, v = F.col("simple_change"), F.col("volume")
    df = df.withColumns({
        "simple_trend": _first([(c > 5, 24), (c > 2, 18), (c > 0, 12), (c > -2, 6)], 0),
        "simple_capital": _first([(v > 1e7, 30), (v > 5e6, 24), (v > 2e6, 18), (v > 1e6, 12)], 6),
    })
    total = (F.col("simple_trend") * 0.3 + F.col("simple_capital") * 0.3
             + F.lit(20.0 * 0.25) + F.lit(15.0 * 0.15))
    df = df.withColumn("simple_score", total)
    s = F.col("simple_score")
    return df.withColumn(
        "simple_level", F.when(s >= 22, "高风险股").when(s >= 18, "中等风险股").otherwise("低风险股"))


# fixed values: below these a dimension counts as weak
WEAK_BELOW = {"trend": 70.0, "capital": 50.0, "technical": 50.0, "risk": 50.0}


def explain_score(df: DataFrame, market: str = "normal") -> DataFrame:
    """Weighted parts, raw composite, the factor that led to the final score, weak dimensions."""
    parts = {f"weighted_{d}": F.col(f"{d}_score") * F.lit(w)
             for d, w in dimension_weights(market).items()}
    df = df.withColumns(parts)
    first, *rest = (F.col(c) for c in parts)
    df = df.withColumn("raw_composite", sum(rest, first))
    weak = F.filter(
        F.array(*[F.when(F.col(f"{d}_score") < WEAK_BELOW[d], F.lit(d)) for d in DIMENSIONS]),
        lambda x: x.isNotNull())
    return df.withColumns({
        "implied_factor": F.try_divide(F.col("composite_score"), F.col("raw_composite")),
        "weak_dimensions": F.array_join(weak, ","),
    })


def display_score(dual_latest: DataFrame) -> DataFrame:
    """Score shown beside dual-adjusted prices: min(100, max(0, post / 1000 * 20))."""
    return dual_latest.withColumn(
        "display_score", clip(F.col("close") / F.lit(1000.0) * F.lit(20.0), 0, 100))


def rule_score(df: DataFrame, rules: Sequence[tuple[Column, float]], out: str = "rule_score") -> DataFrame:
    """Configurable score: sum of value * weight over the sum of weights."""
    weight = float(sum(w for _, w in rules))
    parts = [c.cast("double") * F.lit(float(w)) for c, w in rules]
    return df.withColumn(out, F.try_divide(sum(parts[1:], parts[0]), F.lit(weight)))
