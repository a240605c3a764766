"""Bars, indicators and scores over the trades of `lineitem` and `events`."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from barloom.functions import formulas
from barloom.functions.numeric import rounded
from barloom.functions.reuse import materialised
from barloom.operators import indicators as ind, pools, quality, scoring
from barloom.plans.bindings import event_bars, instruments, order_size_share, sized_bars, trade_bars
from barloom.plans.registry import cte, query, sql
from barloom.plans.shape import shape
from barloom.plans.sqltext import SYM, change, ewm, full, lag, rnd

K = "order_book_id date"
KS = "order_book_id, date"


@query("bars_daily", "A28", sql("SELECT * FROM bars", "bars"))
def bars_daily(spark: SparkSession, sf: str) -> DataFrame:
    return trade_bars(spark, sf)


@query("bars_events", "A28", sql("SELECT * FROM ebars", "ebars"))
def bars_events(spark: SparkSession, sf: str) -> DataFrame:
    return event_bars(spark, sf)


# ---------------------------------------------------------------- oracle pieces, stage by stage

_YEAR = f"OVER ({SYM} ROWS BETWEEN 250 PRECEDING AND 1 PRECEDING)"
_SUP = f"OVER ({SYM} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"
_DD = f"OVER ({SYM} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"

cte("i0", f"""SELECT *, row_number() OVER ({SYM}) - 1 AS r, {lag('close')} AS pc FROM bars""", "bars")
cte("i1", f"""
SELECT *, close - pc AS price_diff, (close - pc) / nullif(pc, 0) AS pct_change,
  CASE WHEN close > pc THEN close - pc ELSE 0 END AS gain,
  CASE WHEN close < pc THEN pc - close ELSE 0 END AS loss,
  {", ".join(f"{full('avg', 'close', n)} AS sma_{n}" for n in (5, 10, 20, 30, 60))},
  {", ".join(f"{ewm('close', n)} AS ema_{n}" for n in (5, 10, 12, 20, 26, 30))},
  {full('stddev_samp', 'close', 20)} AS boll_std,
  {", ".join(f"{full('avg', 'volume', n)} AS volume_ma{n}" for n in (5, 10, 20))},
  (close - {full('min', 'low', 9)}) / nullif({full('max', 'high', 9)} - {full('min', 'low', 9)}, 0) * 100 AS rsv,
  sign(close - open) * amount AS net_inflow,
  max(high) {_YEAR} AS year_high, min(low) {_YEAR} AS year_low,
  max(high) {_DD} AS top60, min(low) {_SUP} AS sup, max(high) {_SUP} AS res,
  high - low AS hl, abs(high - pc) AS hc, abs(low - pc) AS lc,
  greatest(high - low, abs(high - pc), abs(low - pc)) AS true_range
FROM i0""", "i0")
cte("i2", f"""
SELECT *, ema_12 - ema_26 AS macd_diff, sma_20 AS boll, sma_20 + 2 * boll_std AS boll_up,
  sma_20 - 2 * boll_std AS boll_down,
  {", ".join(f"{full('avg', 'gain', n)} AS ag{n}, {full('avg', 'loss', n)} AS al{n}" for n in (6, 10, 12, 14))},
  {", ".join(f"degrees(atan(100 * {change(f'sma_{n}')})) AS ma{n}_angle" for n in (5, 10, 20, 30, 60))},
  {full('avg', 'rsv', 3)} AS stoch_k,
  {full('sum', 'net_inflow', 5)} AS main_net_inflow_5d,
  {full('sum', 'net_inflow', 5)} / nullif({full('sum', 'amount', 5)}, 0) AS main_net_inflow_ratio,
  {", ".join(f"{full('stddev_samp', 'pct_change', n)} * sqrt(252) AS volatility_{n}d" for n in (5, 10, 20))},
  volume / nullif(volume_ma10, 0) AS volume_ratio, volume_ma5 / nullif(volume_ma20, 0) AS vt,
  {full('avg', 'true_range', 14)} AS atr_14,
  1 - close / nullif(top60, 0) AS drawdown_from_high,
  (close - sup) / nullif(sup, 0) AS distance_to_support, close < sup AS support_broken,
  CASE WHEN close - sup > 0 THEN (res - close) / (close - sup) END AS risk_reward_ratio
FROM i1""", "i1")
cte("i3", f"""
SELECT *, {ewm('macd_diff', 9)} AS macd_dea, {full('avg', 'stoch_k', 3)} AS stoch_d,
  {", ".join(f"CASE WHEN al{n} > 0 THEN 100 - 100 / (1 + ag{n} / al{n}) WHEN al{n} = 0 AND ag{n} > 0 THEN 100 END AS rsi_{n}" for n in (6, 10, 12, 14))},
  CASE WHEN boll_std > 0 THEN (close - boll) / boll_std END AS boll_position,
  CASE WHEN vt > 1.1e0 THEN 'increasing' WHEN vt >= 0.9e0 THEN 'stable' WHEN vt >= 0.8e0 THEN 'intermittent'
       WHEN vt IS NOT NULL THEN 'decreasing' END AS volume_trend
FROM i2""", "i2")
cte("ind", """SELECT *, 2 * (macd_diff - macd_dea) AS macd_hist, 3 * stoch_k - 2 * stoch_d AS stoch_j FROM i3""", "i3")


def _indicator(name: str, rows: str, cols: str, digits: int, step, extra: str = "") -> None:
    """Register an indicator query whose oracle reads the shared staged SQL."""
    text = f"SELECT {KS}, {rnd(cols, digits)}{', ' + extra.replace(' ', ', ') if extra else ''} FROM ind"

    @query(name, rows, sql(text, "ind"))
    def build(spark: SparkSession, sf: str) -> DataFrame:
        return shape(step(trade_bars(spark, sf)), f"{K} {cols} {extra}", digits)


_indicator("sma", "G1", "sma_5 sma_10 sma_20 sma_30 sma_60", 4, ind.sma)
_indicator("ema", "G2 G43", "ema_5 ema_10 ema_20 ema_30", 4, ind.ema)
_indicator("rsi", "G3 G37", "rsi_6 rsi_10 rsi_12 rsi_14", 4, lambda d: ind.rsi(d, (6, 10, 12, 14)))
_indicator("macd", "G4 G37", "macd_diff macd_dea macd_hist", 4, ind.macd)
_indicator("bollinger", "G5 G39", "boll boll_std boll_up boll_down", 4, ind.bollinger)
_indicator("bollinger_position", "I7", "boll_position", 6, ind.bollinger)
_indicator("stochastic", "G38", "stoch_k stoch_d stoch_j", 4, ind.stochastic)
_indicator("true_range", "G14", "hl hc lc true_range atr_14", 4, ind.true_range)
_indicator("volume_ratio", "G6 G7", "volume_ratio", 6, ind.volume_ratio)
_indicator("ma_angle", "G9 G30", "ma5_angle ma10_angle ma20_angle ma30_angle ma60_angle", 4, ind.ma_angles)
_indicator("volatility", "G32", "volatility_5d volatility_10d volatility_20d", 5, ind.volatility)
_indicator("year_range", "G31", "year_high year_low", 4, ind.year_range)
_indicator("money_flow", "G34", "main_net_inflow_ratio", 6, ind.money_flow)
_indicator("volume_trend", "G36", "volume_ma5 volume_ma20", 4,
           lambda d: ind.volume_trend(ind.volume_means(d)), "volume_trend")
_indicator("drawdown", "G40", "drawdown_from_high", 6, ind.drawdown)
_indicator("support", "G41 G42", "distance_to_support risk_reward_ratio", 5, ind.support, "support_broken")
_indicator("daily_change", "G11 G33 I2 G21", "pct_change price_diff", 5, ind.changes)


@query("rsi_details", "G3", sql(
    f"""SELECT {KS}, RND4(price_diff) AS price_change, RND4(gain) AS gain,
    RND4(loss) AS loss, RND4(ag14) AS avg_gain_14, RND4(al14) AS avg_loss_14,
    RND4(CASE WHEN al14 <> 0 THEN ag14 / al14 END) AS rs_14, RND4(rsi_14) AS rsi_14 FROM ind""", "ind"))
def rsi_details(spark: SparkSession, sf: str) -> DataFrame:
    df = ind.rsi(trade_bars(spark, sf), (14,), details=True)
    return shape(df, f"{K} price_change gain loss avg_gain_14 avg_loss_14 rs_14 rsi_14")


@query("sma_events", "G1 G20", sql(
    f"SELECT {KS}, RND4({full('avg', 'close', 3)}) AS sma_3, RND4({full('avg', 'close', 14)}) AS sma_14 FROM ebars",
    "ebars"))
def sma_events(spark: SparkSession, sf: str) -> DataFrame:
    return shape(ind.sma(event_bars(spark, sf), (3, 14)), f"{K} sma_3 sma_14")


@query("volume_ratio_windows", "G6 I3", sql(
    f"""SELECT {KS}, {", ".join(f"RND6(volume / nullif({full('avg', 'volume', n)}, 0)) AS vr_{n}" for n in (5, 10, 20))} FROM bars""",
    "bars"))
def volume_ratio_windows(spark: SparkSession, sf: str) -> DataFrame:
    df = trade_bars(spark, sf)
    for n in (5, 10, 20):
        df = ind.volume_ratio(df, n, f"vr_{n}")
    return shape(df, f"{K} vr_5 vr_10 vr_20", 6)


@query("price_angle", "G8", sql(
    f"SELECT {KS}, RND5(degrees(atan({change('close')}))) AS price_angle FROM bars", "bars"))
def price_angle(spark: SparkSession, sf: str) -> DataFrame:
    return shape(ind.price_angle(trade_bars(spark, sf)), f"{K} price_angle", 5)


@query("ma_angle_tanh", "G10", sql(
    f"SELECT {KS}, RND5(45 * tanh(2 * ({change('sma_10')}))) AS ma10_angle FROM i1", "i1"))
def ma_angle_tanh(spark: SparkSession, sf: str) -> DataFrame:
    return shape(ind.ma_angles(trade_bars(spark, sf), (10,), "tanh"), f"{K} ma10_angle", 5)


@query("trailing_return_10", "G13", sql(
    f"""SELECT {KS}, RND4((close - {lag('close', 10)}) / {lag('close', 10)} * 100) AS return_10d
    FROM bars QUALIFY {lag('close', 10)} IS NOT NULL""", "bars"))
def trailing_return_10(spark: SparkSession, sf: str) -> DataFrame:
    from barloom.operators.research import trailing_return

    return shape(trailing_return(trade_bars(spark, sf), 10), f"{K} return_10d")


@query("recent_bars", "G22", sql(
    f"SELECT {KS}, close, row_number() OVER (PARTITION BY order_book_id ORDER BY date DESC) AS recency FROM bars QUALIFY recency <= 5",
    "bars"))
def recent_bars(spark: SparkSession, sf: str) -> DataFrame:
    df = ind.last_rows(trade_bars(spark, sf), 5)
    return df.select("order_book_id", "date", "close", F.col("recency").cast("bigint").alias("recency"))


@query("mini_score", "G19 G18", sql(
    f"""SELECT {KS}, RND6((CASE WHEN rsi_14 > 70 THEN 1 WHEN rsi_14 < 30 THEN -1 ELSE 0 END
      + CASE WHEN macd_hist > 0 THEN 1 ELSE -1 END
      + CASE WHEN close > boll_up THEN 1 WHEN close < boll_down THEN -1 ELSE 0 END) / 3.0::DOUBLE) AS mini_score FROM ind""",
    "ind"))
def mini_score(spark: SparkSession, sf: str) -> DataFrame:
    df = ind.calculate_indicators(trade_bars(spark, sf), ["rsi_14", "macd_diff", "bollinger_upper"])
    return shape(ind.mini_score(df), f"{K} mini_score", 6)


_ALL = ("sma_5 sma_60 ema_20 rsi_12 macd_dea macd_hist boll_up stoch_j atr_14 pct_change volume_ratio "
        "volume_ma20 main_net_inflow_ratio ma30_angle volatility_10d year_low drawdown_from_high "
        "distance_to_support")


@query("all_indicators", "G18 B17 B9", sql(f"SELECT {KS}, {rnd(_ALL, 4)}, volume_trend FROM ind", "ind"))
def all_indicators(spark: SparkSession, sf: str) -> DataFrame:
    return shape(ind.calculate_indicators(trade_bars(spark, sf)), f"{K} {_ALL} volume_trend")


@query("formulas", "I1 I2 I3 I4 I5", sql(
    f"""SELECT {KS}, RND4(amount / nullif(volume, 0)) AS vwap, RND4({change('close')}) AS returns,
    RND4(volume / nullif({full('avg', 'volume', 20)}, 0)) AS volume_ratio,
    RND4(close - open) AS price_change, RND4((close - open) / nullif(open, 0)) AS price_change_pct,
    RND4((high - low) / nullif(low, 0)) AS high_low_range,
    RND4((open + close + high + low) / 4) AS avg_price FROM bars""", "bars"))
def formulas_query(spark: SparkSession, sf: str) -> DataFrame:
    df = formulas.apply_formulas(trade_bars(spark, sf))
    return shape(df, f"{K} vwap returns volume_ratio price_change price_change_pct high_low_range avg_price")


@query("missing_fields", "G11 I1", sql(
    f"""SELECT {KS}, RND4(amount / nullif(volume, 0)) AS vwap, RND4({change('close')}) AS returns,
    RND4(close - {lag('close')}) AS price_change,
    RND4(volume / nullif({full('avg', 'volume', 5)}, 0)) AS volume_ratio FROM ebars""", "ebars"))
def missing_fields(spark: SparkSession, sf: str) -> DataFrame:
    return shape(formulas.fill_missing_fields(event_bars(spark, sf)),
                 f"{K} vwap returns price_change volume_ratio")


@query("volume_rsi", "I8", sql(
    f"SELECT {KS}, {', '.join(f'RND4(volume_ratio * rsi_{n}) AS volume_rsi_{n}' for n in (6, 10, 14))} FROM ind",
    "ind"))
def volume_rsi(spark: SparkSession, sf: str) -> DataFrame:
    df = ind.rsi(ind.volume_ratio(trade_bars(spark, sf)), (6, 10, 14))
    return shape(formulas.volume_rsi(df), f"{K} volume_rsi_6 volume_rsi_10 volume_rsi_14")


@query("repair_high_low", "I10 I12", sql(
    f"""SELECT {KS}, greatest(open, close, (open + close) / 2) AS high, least(open, close, (open + close) / 2) AS low,
    RND4(amount / 10000) AS amount_wan FROM bars""", "bars"))
def repair_high_low(spark: SparkSession, sf: str) -> DataFrame:
    mid = (F.col("open") + F.col("close")) / F.lit(2.0)
    df = trade_bars(spark, sf).withColumns({"high": mid, "low": mid})
    df = formulas.rescaled(formulas.repair_high_low(df), "amount", 1e4, "amount_wan")
    return shape(df, f"{K} high low amount_wan", 4, "high low")


# ---------------------------------------------------------------- order size share and scores

cte("cuts", "SELECT order_book_id, quantile_cont(size, 0.9) AS cut FROM ticks GROUP BY 1", "ticks")
cte("big", """SELECT order_book_id, date, sum(CASE WHEN size > cut THEN amount ELSE 0 END) / nullif(sum(amount), 0) AS large_order_ratio
FROM ticks JOIN cuts USING (order_book_id) GROUP BY order_book_id, date""", "ticks", "cuts")


@query("large_order_ratio", "G35", sql(f"SELECT {KS}, {rnd('large_order_ratio', 6)} FROM big", "big"))
def large_orders(spark: SparkSession, sf: str) -> DataFrame:
    return shape(order_size_share(spark, sf), f"{K} large_order_ratio", 6)


def _trended(rules: str, default: str) -> str:
    """'cond => up/dn' lines as a CASE with the angle gate."""
    out = "CASE"
    for line in rules.strip().splitlines():
        cond, marks = line.split("=>")
        up, dn = marks.strip().split("/")
        out += f" WHEN ({cond.strip()}) AND ma10_angle > -10 THEN {up} WHEN ({cond.strip()}) AND ma10_angle <= -10 THEN {dn}"
    return out + f" ELSE {default} END"


cte("scored0", "SELECT ind.*, large_order_ratio, industry, market_cap FROM ind LEFT JOIN big USING (order_book_id, date) LEFT JOIN instruments USING (order_book_id)",
    "ind", "big", "instruments")
cte("scored1", f"""SELECT *,
 CASE WHEN sma_5 > sma_10 AND sma_10 > sma_20 THEN 30 WHEN sma_5 > sma_10 THEN 21 WHEN sma_5 > sma_20 THEN 12 ELSE 3 END AS score_arrangement,
 CASE WHEN ma10_angle >= 45 THEN 30 WHEN ma10_angle >= 15 THEN 25 WHEN ma10_angle >= 5 THEN 20 WHEN ma10_angle BETWEEN -5 AND 5 THEN 15
   WHEN ma10_angle >= -15 THEN 10 ELSE 5 END AS score_slope,
 CASE WHEN close > year_high THEN 25 WHEN close > year_high * 0.95e0 THEN 20 WHEN close > year_high * 0.9e0 THEN 15 WHEN close < year_low THEN 0 ELSE 8 END AS score_position,
 CASE WHEN volatility_20d < 0.15e0 THEN 15 WHEN volatility_20d <= 0.25e0 THEN 10 WHEN volatility_20d <= 0.35e0 THEN 5 ELSE 0 END AS score_stability,
 CASE WHEN (pct_change > 0 AND volume_ratio > 1.5e0 AND ma10_angle > 0) OR (pct_change < 0 AND volume_ratio < 0.7e0 AND ma10_angle < 0) THEN 30
   WHEN (pct_change > 0 AND volume_ratio > 1.2e0 AND ma10_angle > 0) OR (pct_change < 0 AND volume_ratio < 0.8e0 AND ma10_angle < 0) THEN 25
   WHEN pct_change > 0 AND volume_ratio BETWEEN 1e0 AND 1.2e0 AND ma10_angle > 0 THEN 20
   WHEN pct_change < 0 AND volume_ratio BETWEEN 0.8e0 AND 1e0 AND ma10_angle < 0 THEN 15
   WHEN pct_change > 0 AND volume_ratio BETWEEN 0.8e0 AND 1e0 AND ma10_angle > 0 THEN 12
   WHEN pct_change < 0 AND volume_ratio > 1e0 AND ma10_angle < 0 THEN 9 ELSE 3 END AS score_volume_price,
 {_trended('''main_net_inflow_ratio > 0.08e0 => 25/15
main_net_inflow_ratio BETWEEN 0.05e0 AND 0.08e0 => 20/12
main_net_inflow_ratio BETWEEN 0.03e0 AND 0.05e0 => 15/9
main_net_inflow_ratio BETWEEN 0.01e0 AND 0.03e0 => 12/6
main_net_inflow_ratio BETWEEN -0.005e0 AND 0.01e0 => 6/3
main_net_inflow_ratio BETWEEN -0.01e0 AND -0.005e0 => 3/1''', '0')} AS score_inflow,
 {_trended('''large_order_ratio > 0.4e0 => 25/15
large_order_ratio BETWEEN 0.3e0 AND 0.4e0 => 20/12
large_order_ratio BETWEEN 0.2e0 AND 0.3e0 => 15/9
large_order_ratio BETWEEN 0.15e0 AND 0.2e0 => 12/6
large_order_ratio BETWEEN 0.1e0 AND 0.15e0 => 9/3
large_order_ratio BETWEEN 0.05e0 AND 0.1e0 => 6/2''', '1')} AS score_institution,
 {_trended('''volume_trend = 'increasing' => 20/10
volume_trend = 'intermittent' => 15/8
volume_trend = 'stable' => 10/5''', '3')} AS score_volume_trend,
 {_trended('''rsi_14 > 55 => 30/15
rsi_14 > 50 => 20/10
rsi_14 < 40 => 5/2''', '15')} AS score_rsi,
 {_trended('''macd_diff > 0 AND macd_diff > macd_dea AND macd_hist > 0 => 30/15
macd_diff > 0 AND macd_diff > macd_dea => 20/10
macd_diff < 0 AND macd_diff < macd_dea => 5/2''', '10')} AS score_macd,
 {_trended('''stoch_k > stoch_d AND stoch_k < 80 => 20/10
stoch_k > stoch_d AND stoch_k >= 80 => 10/5
stoch_k < stoch_d => 5/2''', '0')} AS score_kdj,
 {_trended('''close > boll AND boll_up - boll_down > 2 * boll_std => 20/10
close > boll => 15/8
close > boll_down => 10/5''', '3')} AS score_boll,
 {_trended('''drawdown_from_high < 0.1e0 => 40/20
drawdown_from_high BETWEEN 0.1e0 AND 0.2e0 => 25/10
drawdown_from_high BETWEEN 0.2e0 AND 0.3e0 => 10/5''', '0')} AS score_drawdown,
 {_trended('''distance_to_support > 0.15e0 => 35/20
distance_to_support BETWEEN 0.05e0 AND 0.15e0 => 25/15
distance_to_support < 0.05e0 => 10/5''', 'CASE WHEN support_broken THEN 0 ELSE 15 END')} AS score_support,
 {_trended('''risk_reward_ratio > 3 => 25/15
risk_reward_ratio BETWEEN 2 AND 3 => 20/12
risk_reward_ratio BETWEEN 1 AND 2 => 15/8''', '5')} AS score_rr_ratio
FROM scored0""", "scored0")
cte("scored2", """SELECT *,
 CAST(score_arrangement + score_slope + score_position + score_stability AS DOUBLE) AS trend_score,
 CAST(score_volume_price + score_inflow + score_institution + score_volume_trend AS DOUBLE) AS capital_score,
 CAST(score_rsi + score_macd + score_kdj + score_boll AS DOUBLE) AS technical_score,
 CAST(score_drawdown + score_support + score_rr_ratio AS DOUBLE) AS risk_score FROM scored1""", "scored1")
cte("scored3", """SELECT *, trend_score * 0.45e0 + capital_score * 0.24e0 + technical_score * 0.18e0 + risk_score * 0.15e0 AS raw_composite,
 CASE industry WHEN '科技' THEN 1.15e0 WHEN '新能源' THEN 1.15e0 WHEN '医药' THEN 1.05e0 WHEN '消费' THEN 1.05e0 WHEN '金融' THEN 0.95e0
   WHEN '资源' THEN 0.95e0 ELSE 1e0 END * CASE WHEN market_cap > 5e10 THEN 0.95e0 WHEN market_cap BETWEEN 1e10 AND 5e10 THEN 1e0 ELSE 1.1e0 END AS factor
FROM scored2""", "scored2")
cte("scores", """SELECT *, RND4(least(greatest(least(greatest(raw_composite, 0), 100) * factor, 0), 100)) AS composite_score FROM scored3""", "scored3")

@query("catalog_names", "G43", sql(
    f"""SELECT {KS}, RND4(macd_diff) AS macd, RND4(macd_dea) AS macd_signal, RND4(boll_up) AS bollinger_upper,
    RND4(boll) AS bollinger_middle, RND4(boll_down) AS bollinger_lower FROM ind""", "ind"))
def catalog_names(spark: SparkSession, sf: str) -> DataFrame:
    df = ind.calculate_indicators(trade_bars(spark, sf), ["macd_signal", "bollinger_upper"])
    return shape(ind.catalog_names(df), f"{K} macd macd_signal bollinger_upper bollinger_middle bollinger_lower")


_DIMS = {
    "trend": ("H1 H2 H3 H4 H5", "score_arrangement score_slope score_position score_stability trend_score"),
    "capital": ("H6 H7 H8 H9 H10", "score_volume_price score_inflow score_institution score_volume_trend capital_score"),
    "technical": ("H11", "score_rsi score_macd score_kdj score_boll technical_score"),
    "risk": ("H12", "score_drawdown score_support score_rr_ratio risk_score"),
}


def scorer_frame(spark: SparkSession, sf: str) -> DataFrame:
    """Bars with every scorer input: order-size share, industry and size join the narrow bars, then one
    exchange by symbol serves all indicators."""
    inst = instruments(spark, sf).select("order_book_id", "industry", "market_cap")
    return ind.scorer_inputs(sized_bars(spark, sf).join(inst, "order_book_id", "left"))


def _scored(inputs: DataFrame, warnings: Column | None = None) -> DataFrame:
    """Scores of each row, the composite rounded to four digits so that thresholds and ranks are stable."""
    df = scoring.score_bars(inputs, warnings=warnings)
    df = df.withColumn("composite_score", rounded("composite_score", 4))
    return scoring.levels(df)


def scored_bars(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(scorer_frame(spark, sf))


def _dimension(name: str, rows: str, cols: str) -> None:
    casted = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in cols.split())

    @query(f"score_{name}", rows, sql(f"SELECT {KS}, {casted} FROM scored2", "scored2"))
    def build(spark: SparkSession, sf: str) -> DataFrame:
        df = scoring.dimension_score(scorer_frame(spark, sf), name)
        return df.select("order_book_id", "date", *cols.split())


for _n, (_rows, _cols) in _DIMS.items():
    _dimension(_n, _rows, _cols)

_LEVEL = """CASE WHEN composite_score >= 85 THEN '强势股' WHEN composite_score >= 70 THEN '潜力股' WHEN composite_score >= 55 THEN '震荡股'
 WHEN composite_score >= 40 THEN '弱势股' ELSE '高风险股' END AS score_level"""


cte("listed", "SELECT b.*, i.industry FROM bars b LEFT JOIN instruments i USING (order_book_id)", "bars", "instruments")
cte("warned", "SELECT CAST((count(*) = 0)::INT + " + " + ".join(
    f"coalesce((count(*) FILTER ({c} IS NULL) > 0.1 * count(*))::INT, 0)" for c in quality.WARNED)
    + " + (count(*) FILTER (industry NOT IN (" + ", ".join(f"'{i}'" for i in scoring.INDUSTRY_FACTORS) + ")) > 0)::INT AS BIGINT) AS n FROM listed", "listed")


@query("composite_score", "H13 H14 H15 H16 H17 H18 B9 B17 J7", sql(
    f"""SELECT {KS}, trend_score, capital_score, technical_score, risk_score, composite_score, {_LEVEL}, '1.0' AS _scorer_version, 'normal' AS _market_environment,
    (SELECT n FROM warned) AS _data_quality_warnings, CAST(1 AS BIGINT) AS _calculation_count FROM scores""", "scores", "warned"))
def composite_score(spark: SparkSession, sf: str) -> DataFrame:
    """With the number of warnings on the bars, which one narrow aggregation over them counts."""
    listed = trade_bars(spark, sf).join(instruments(spark, sf).select("order_book_id", "industry"), "order_book_id", "left")
    warnings = quality.warning_count(listed, list(scoring.INDUSTRY_FACTORS)).scalar()
    return _scored(scorer_frame(spark, sf), warnings).select(
        "order_book_id", "date", "trend_score", "capital_score", "technical_score", "risk_score",
        "composite_score", "score_level", "_scorer_version", "_market_environment", "_data_quality_warnings", "_calculation_count")


@query("score_markets", "H13 H14", sql(
    f"""SELECT {KS},
    RND4(least(trend_score * (0.45e0 * 1e0) + capital_score * (0.2e0 * 1.4e0) + technical_score * (0.2e0 * 0.9e0) + risk_score * (0.15e0 * 0.8e0), 100)) AS bull,
    RND4(least(trend_score * (0.45e0 * 0.8e0) + capital_score * (0.2e0 * 1.3e0) + technical_score * (0.2e0 * 0.9e0) + risk_score * (0.15e0 * 1.3e0), 100)) AS bear,
    RND4(least(trend_score * (0.45e0 * 0.9e0) + capital_score * (0.2e0 * 1.5e0) + technical_score * (0.2e0 * 1e0) + risk_score * (0.15e0 * 1e0), 100)) AS volatile
    FROM scored2""", "scored2"))
def score_markets(spark: SparkSession, sf: str) -> DataFrame:
    df = scorer_frame(spark, sf)
    for d in scoring.DIMENSIONS:
        df = scoring.dimension_score(df, d)
    for market in ("bull", "bear", "volatile"):
        df = scoring.composite(df, market).withColumn(market, F.col("composite_score"))
    return shape(df, f"{K} bull bear volatile")


@query("score_levels", "H16", sql(
    f"SELECT score_level, CAST(count(*) AS BIGINT) AS bars, RND4(avg(composite_score)) AS mean_score FROM (SELECT composite_score, {_LEVEL} FROM scores) GROUP BY score_level",
    "scores"))
def score_levels(spark: SparkSession, sf: str) -> DataFrame:
    return scored_bars(spark, sf).groupBy("score_level").agg(
        F.count(F.lit(1)).alias("bars"), rounded(F.avg("composite_score"), 4).alias("mean_score"))


@query("score_threshold", "C9", sql(f"SELECT {KS}, composite_score FROM scores WHERE composite_score >= 65", "scores"))
def score_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.above(scored_bars(spark, sf)).select("order_book_id", "date", "composite_score")


@query("score_simple", "H19", sql(
    f"""SELECT {KS}, CAST(t AS DOUBLE) AS simple_trend, CAST(c AS DOUBLE) AS simple_capital, RND4(t * 0.3e0 + c * 0.3e0 + 5 + 2.25e0) AS simple_score,
    CASE WHEN t * 0.3e0 + c * 0.3e0 + 5 + 2.25e0 >= 22 THEN '高风险股' WHEN t * 0.3e0 + c * 0.3e0 + 5 + 2.25e0 >= 18 THEN '中等风险股' ELSE '低风险股' END AS simple_level
    FROM (SELECT {KS}, CASE WHEN ch > 5 THEN 24 WHEN ch > 2 THEN 18 WHEN ch > 0 THEN 12 WHEN ch > -2 THEN 6 ELSE 0 END AS t,
      CASE WHEN volume > 1e7 THEN 30 WHEN volume > 5e6 THEN 24 WHEN volume > 2e6 THEN 18 WHEN volume > 1e6 THEN 12 ELSE 6 END AS c
      FROM (SELECT {KS}, volume * 100000 AS volume, CASE WHEN open > 0 THEN (close - open) / open * 100 ELSE 0 END AS ch FROM bars))""",
    "bars"))
def score_simple(spark: SparkSession, sf: str) -> DataFrame:
    lots = trade_bars(spark, sf).withColumn("volume", F.col("volume") * F.lit(100000.0))
    return shape(scoring.simple_score(lots), f"{K} simple_trend simple_capital simple_score simple_level")


@query("score_explain", "H20", sql(
    f"""SELECT {KS}, RND4(trend_score * 0.45e0) AS weighted_trend, RND4(capital_score * 0.24e0) AS weighted_capital,
    RND4(raw_composite) AS raw_composite, RND4(composite_score / nullif(raw_composite, 0)) AS implied_factor,
    concat_ws(',', CASE WHEN trend_score < 70 THEN 'trend' END, CASE WHEN capital_score < 50 THEN 'capital' END,
      CASE WHEN technical_score < 50 THEN 'technical' END, CASE WHEN risk_score < 50 THEN 'risk' END) AS weak_dimensions FROM scores""",
    "scores"))
def score_explain(spark: SparkSession, sf: str) -> DataFrame:
    df = scoring.explain_score(scored_bars(spark, sf))
    return shape(df, f"{K} weighted_trend weighted_capital raw_composite implied_factor weak_dimensions")


@query("rule_score", "J13", sql(
    f"""SELECT {KS}, RND4(((trend_score * 2) + (risk_score * 1) + (CASE WHEN volume_ratio > 1 THEN 100 ELSE 0 END) * 0.5e0) / 3.5e0) AS rule_score FROM scores""",
    "scores"))
def rule_score(spark: SparkSession, sf: str) -> DataFrame:
    rules = [(F.col("trend_score"), 2.0), (F.col("risk_score"), 1.0),
             (F.when(F.col("volume_ratio") > 1, 100).otherwise(0), 0.5)]
    return shape(scoring.rule_score(scored_bars(spark, sf), rules), f"{K} rule_score")


@query("score_acceleration", "G12", sql(
    f"""SELECT {KS}, RND4(v) AS score_velocity, RND4(v - {lag('v')}) AS score_acceleration
    FROM (SELECT {KS}, composite_score - {lag('composite_score')} AS v FROM scores) QUALIFY v IS NOT NULL AND {lag('v')} IS NOT NULL""",
    "scores"))
def score_acceleration(spark: SparkSession, sf: str) -> DataFrame:
    return shape(ind.score_changes(scored_bars(spark, sf)), f"{K} score_velocity score_acceleration")


# ---------------------------------------------------------------- pools over the latest scores

cte("latest_scores", f"SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY order_book_id ORDER BY date DESC) = 1", "scores")


def latest_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of each symbol's newest bar. A score depends on its own row only, so the newest rows are
    taken first, by the order the indicators' windows leave behind, and only they are scored."""
    cols = [c for s in scoring.SUB_SCORES.values() for c in s]
    later = F.lead("date").over(Window.partitionBy("order_book_id").orderBy("date"))
    newest = scorer_frame(spark, sf).withColumn("_later", later).where("_later IS NULL")
    return _scored(newest).select(
        "order_book_id", "date", "close", "volume", "volume_ratio", "industry", "trend_score", "capital_score",
        "technical_score", "risk_score", "composite_score", *cols)


def _pool(name: str) -> None:
    k = pools.POOL_SIZES[name]

    @query(f"pool_{name}", "B6 G15", sql(
        f"SELECT order_book_id, composite_score AS score, row_number() OVER (ORDER BY composite_score DESC, order_book_id) AS rank FROM latest_scores WHERE composite_score IS NOT NULL ORDER BY rank LIMIT {k}",
        "latest_scores"))
    def build(spark: SparkSession, sf: str) -> DataFrame:
        return pools.pool(latest_scores(spark, sf), name)


for _n in pools.POOL_SIZES:
    _pool(_n)


@query("pool_stats", "B7", sql(
    """SELECT least(n, 100) AS basic_size, least(n, 50) AS watch_size, least(n, 20) AS core_size, least(n, 100) AS distinct_symbols
    FROM (SELECT count(*) AS n FROM latest_scores WHERE composite_score IS NOT NULL)""", "latest_scores"))
def pool_stats(spark: SparkSession, sf: str) -> DataFrame:
    # three pools read the same latest scores
    s = materialised(latest_scores(spark, sf).select("order_book_id", "composite_score"))
    return pools.pool_statistics({n: pools.pool(s, n) for n in pools.POOL_SIZES})


@query("rank_stocks", "B10", sql(
    f"SELECT {KS}, composite_score, row_number() OVER (PARTITION BY date ORDER BY composite_score DESC NULLS LAST, order_book_id) AS day_rank FROM scores",
    "scores"))
def rank_stocks(spark: SparkSession, sf: str) -> DataFrame:
    return pools.rank_per_date(scored_bars(spark, sf).select("order_book_id", "date", "composite_score"))


@query("screen_strong", "B11", sql(
    "SELECT order_book_id, date, close, composite_score FROM latest_scores WHERE composite_score >= 40 AND volume_ratio > 0.5e0 ORDER BY composite_score DESC, order_book_id LIMIT 20",
    "latest_scores"))
def screen_strong(spark: SparkSession, sf: str) -> DataFrame:
    return pools.screen(latest_scores(spark, sf), "composite_score >= 40 AND volume_ratio > 0.5D",
                        [F.desc("composite_score"), F.asc("order_book_id")], 20).select(
        "order_book_id", "date", "close", "composite_score")


@query("score_activity", "B12", sql(
    """SELECT order_book_id, CAST(count(*) AS BIGINT) AS bars, RND4(avg(composite_score)) AS mean_score,
    RND4(corr(composite_score, volume)) AS score_volume_corr FROM scores GROUP BY order_book_id
    HAVING count(*) >= 500 AND avg(composite_score) > 30""", "scores"))
def score_activity(spark: SparkSession, sf: str) -> DataFrame:
    df = pools.activity_filter(scored_bars(spark, sf), "bars >= 500 AND mean_score > 30")
    return shape(df, "order_book_id bars mean_score score_volume_corr")


@query("score_details", "B15", sql(
    """SELECT order_book_id, date, sub_score, CAST(value AS DOUBLE) AS value,
      row_number() OVER (PARTITION BY order_book_id ORDER BY value DESC, sub_score) AS place
    FROM (UNPIVOT (SELECT order_book_id, date, """ + ", ".join(
        f"CAST({c} AS DOUBLE) AS {c}" for s in scoring.SUB_SCORES.values() for c in s) + """ FROM latest_scores)
      ON """ + ", ".join(c for s in scoring.SUB_SCORES.values() for c in s) + " INTO NAME sub_score VALUE value)",
    "latest_scores"))
def score_details(spark: SparkSession, sf: str) -> DataFrame:
    return pools.sub_scores(latest_scores(spark, sf), [c for s in scoring.SUB_SCORES.values() for c in s])


POOL_DEFINITIONS = [
    {"pool_id": "momentum", "filter": "trend_score >= 50", "rules": [("trend_score", 2.0), ("capital_score", 1.0)]},
    {"pool_id": "calm", "filter": "risk_score >= 40 AND technical_score >= 30", "rules": [("risk_score", 1.0)]},
    {"pool_id": "archive", "filter": "composite_score < 30", "rules": [("composite_score", 1.0)], "status": "paused"},
]


@query("pool_membership", "B16", sql(
    """SELECT order_book_id, 'momentum' AS pool_id, 'active' AS status, RND4((trend_score * 2 + capital_score) / 3) AS pool_score FROM latest_scores WHERE trend_score >= 50
    UNION ALL SELECT order_book_id, 'calm', 'active', RND4(risk_score) FROM latest_scores WHERE risk_score >= 40 AND technical_score >= 30
    UNION ALL SELECT order_book_id, 'archive', 'paused', RND4(composite_score) FROM latest_scores WHERE composite_score < 30""",
    "latest_scores"))
def pool_membership(spark: SparkSession, sf: str) -> DataFrame:
    df = pools.pool_membership(latest_scores(spark, sf), POOL_DEFINITIONS)
    return shape(df, "order_book_id pool_id status pool_score")


@query("pool_overview", "B16", sql(
    """SELECT 'momentum' AS pool_id, 'active' AS status, count(*) AS members, RND4(avg((trend_score * 2 + capital_score) / 3)) AS mean_score FROM latest_scores WHERE trend_score >= 50 HAVING count(*) > 0
    UNION ALL SELECT 'calm', 'active', count(*), RND4(avg(risk_score)) FROM latest_scores WHERE risk_score >= 40 AND technical_score >= 30 HAVING count(*) > 0
    UNION ALL SELECT 'archive', 'paused', count(*), RND4(avg(composite_score)) FROM latest_scores WHERE composite_score < 30 HAVING count(*) > 0""",
    "latest_scores"))
def pool_overview(spark: SparkSession, sf: str) -> DataFrame:
    df = pools.pool_overview(pools.pool_membership(latest_scores(spark, sf), POOL_DEFINITIONS))
    return shape(df, "pool_id status members mean_score")
