"""Forward returns, correlations, buckets, distributions and market views over the bars."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from barloom.functions.reuse import materialised
from barloom.operators import indicators as ind, pools, research as res
from barloom.plans import jobs
from barloom.plans.bindings import event_bars, trade_bars, trade_days
from barloom.plans.q_indicators import latest_scores, scored_bars
from barloom.plans.registry import cte, query, sql
from barloom.plans.shape import shape
from barloom.plans.sqltext import SYM, full, lag, rnd

K = "order_book_id date"
KS = "order_book_id, date"

# ---------------------------------------------------------------- forward returns

cte("tcal", "SELECT date, row_number() OVER (ORDER BY date) AS trade_seq FROM (SELECT DISTINCT date FROM bars)", "bars")
cte("bseq", f"SELECT {KS}, close, trade_seq FROM bars JOIN tcal USING (date)", "bars", "tcal")
cte("fwd", f"""SELECT a.order_book_id, a.date, a.close AS price, b.close AS future_price, (b.close - a.close) / a.close AS return_5d
FROM bseq a JOIN bseq b ON a.order_book_id = b.order_book_id AND b.trade_seq = a.trade_seq + 5""", "bseq")


def forward(spark: SparkSession, sf: str, bars: DataFrame | None = None, n: int = 5) -> DataFrame:
    b = trade_bars(spark, sf)
    return res.forward_return(b if bars is None else bars, trade_days(spark, sf), n)


@query("market_calendar", "K1 F36", sql("SELECT * FROM tcal", "tcal"))
def market_calendar(spark: SparkSession, sf: str) -> DataFrame:
    return trade_days(spark, sf)


@query("forward_return", "G16", sql(f"SELECT {KS}, RND6(return_5d) AS return_5d FROM fwd", "fwd"))
def forward_return(spark: SparkSession, sf: str) -> DataFrame:
    return shape(forward(spark, sf), f"{K} return_5d", 6)


@query("scores_with_prices", "E5", sql(
    f"SELECT {KS}, s.composite_score, f.price, f.future_price FROM scores s JOIN fwd f USING (order_book_id, date)", "scores", "fwd"))
def scores_with_prices(spark: SparkSession, sf: str) -> DataFrame:
    b = trade_bars(spark, sf).select("order_book_id", "date", "close")
    s = scored_bars(spark, sf).select("order_book_id", "date", "composite_score")
    return res.scores_with_prices(s, b, trade_days(spark, sf), 5)


@query("positions_with_returns", "E6", sql(
    f"SELECT {KS}, RND4(volume_ratio) AS volume_ratio, RND6(return_5d) AS return_5d FROM ind JOIN fwd USING (order_book_id, date) WHERE volume_ratio IS NOT NULL", "ind", "fwd"))
def positions_with_returns(spark: SparkSession, sf: str) -> DataFrame:
    pos = ind.volume_ratio(trade_bars(spark, sf)).where("volume_ratio IS NOT NULL").select("order_book_id", "date", "volume_ratio")
    df = res.with_positions(pos, forward(spark, sf).select("order_book_id", "date", "return_5d"))
    return shape(shape(df, f"{K} volume_ratio return_5d", 4, "return_5d"), f"{K} volume_ratio return_5d", 6, "volume_ratio")


# ---- forward returns by row offset, on the event bars (dense days)

cte("ersi", f"""SELECT *, CASE WHEN al > 0 THEN 100 - 100 / (1 + ag / al) WHEN al = 0 AND ag > 0 THEN 100 END AS rsi_14 FROM
 (SELECT *, {full('avg', 'g', 14)} AS ag, {full('avg', 'l', 14)} AS al FROM
 (SELECT *, greatest(coalesce(close - {lag('close')}, 0), 0) AS g, greatest(coalesce({lag('close')} - close, 0), 0) AS l FROM ebars))""", "ebars")
cte("egridall", f"""SELECT a.order_book_id, a.date, a.rsi_14, CAST(n AS BIGINT) AS n_days, (b.close - a.close) / a.close AS ret, coalesce(a.d9 <= a.date + 30, false) AS enough
FROM (SELECT *, row_number() OVER ({SYM}) AS r, lead(date, 9) OVER ({SYM}) AS d9 FROM ersi) a CROSS JOIN (SELECT unnest(range(1, 11)) AS n) k
JOIN (SELECT order_book_id, date, close, row_number() OVER ({SYM}) AS r FROM ebars) b ON b.order_book_id = a.order_book_id AND b.r = a.r + n
WHERE b.date <= a.date + 30 AND a.close > 0""", "ersi", "ebars")
cte("egrid", "SELECT * FROM egridall WHERE enough", "egridall")


def _grid(spark: SparkSession, sf: str) -> DataFrame:
    return res.forward_grid(ind.rsi(event_bars(spark, sf), (14,)), carry=["rsi_14"], only_enough=True)


@query("forward_return_grid", "G17", sql(f"SELECT {KS}, enough, n_days, RND4(rsi_14) AS rsi_14, RND4(ret) AS ret FROM egridall", "egridall"))
def forward_return_grid(spark: SparkSession, sf: str) -> DataFrame:
    return shape(res.forward_grid(ind.rsi(event_bars(spark, sf), (14,)), carry=["rsi_14"]), f"{K} enough n_days rsi_14 ret")


@query("short_returns", "G17", sql(
    f"""SELECT {KS}, RND4((c2 - close) / close) AS return_3d, RND4((c4 - close) / close) AS return_5d, coalesce(d9 <= date + 30, false) AS enough FROM
    (SELECT *, lead(close, 2) OVER ({SYM}) AS c2, lead(close, 4) OVER ({SYM}) AS c4, lead(date, 9) OVER ({SYM}) AS d9 FROM ebars) WHERE close > 0""", "ebars"))
def short_returns(spark: SparkSession, sf: str) -> DataFrame:
    return shape(res.short_returns(event_bars(spark, sf)), f"{K} return_3d return_5d enough")


@query("rsi_surface", "F25", sql(
    "SELECT CAST(floor(rsi_14 / 10) * 10 + 5 AS BIGINT) AS rsi_center, n_days, count(*) AS count, RND4(median(ret)) AS median, RND4(stddev_pop(ret)) AS std FROM egrid WHERE rsi_14 >= 0 AND rsi_14 < 100 GROUP BY 1, 2", "egrid"))
def rsi_surface(spark: SparkSession, sf: str) -> DataFrame:
    return shape(res.rsi_surface(_grid(spark, sf)), "rsi_center n_days count median std")


cte("eshort", f"""SELECT * FROM (SELECT {KS}, rsi_14, (lead(close, 2) OVER ({SYM}) - close) / close AS return_3d, (lead(close, 4) OVER ({SYM}) - close) / close AS return_5d,
 lead(date, 9) OVER ({SYM}) AS d9 FROM ersi) WHERE d9 <= date + 30 AND rsi_14 IS NOT NULL""", "ersi")


@query("rsi_quintiles", "F23", sql(
    """SELECT 1 + CAST(rsi_14 > q[1] AS BIGINT) + CAST(rsi_14 > q[2] AS BIGINT) + CAST(rsi_14 > q[3] AS BIGINT) + CAST(rsi_14 > q[4] AS BIGINT) AS quantile, count(*) AS count,
    RND4(avg(return_3d)) AS mean_return_3d, RND4(median(return_3d)) AS median_return_3d, RND4(stddev_pop(return_3d)) AS std_return_3d,
    RND4(avg(return_5d)) AS mean_return_5d, RND4(median(return_5d)) AS median_return_5d, RND4(stddev_pop(return_5d)) AS std_return_5d
    FROM (SELECT * FROM eshort), (SELECT quantile_cont(rsi_14, [0.2, 0.4, 0.6, 0.8]) AS q FROM eshort) GROUP BY 1""", "eshort"))
def rsi_quintiles(spark: SparkSession, sf: str) -> DataFrame:
    df = res.short_returns(ind.rsi(event_bars(spark, sf), (14,)), only_enough=True)
    out = res.quintile_returns(df, "rsi_14", ["return_3d", "return_5d"])
    return shape(out, "quantile count mean_return_3d median_return_3d std_return_3d mean_return_5d median_return_5d std_return_5d")


# ---------------------------------------------------------------- deciles of a signal

_SIGNALS = {
    "volume_ratio": ("F22 F34 L6", lambda d: ind.volume_ratio(d)),
    "rsi_14": ("F22 L6", lambda d: ind.rsi(d, (14,))),
    "boll_position": ("F22 I7 L6", lambda d: ind.bollinger(d)),
}


def _decile_cte(signal: str, expression: str | None = None, forward_cte: str = "fwd", ret: str = "return_5d") -> None:
    x = expression or signal
    cte(f"sig_{signal}", f"SELECT {x} AS x, {ret} AS ret FROM ind JOIN {forward_cte} USING (order_book_id, date) WHERE {x} IS NOT NULL", "ind", forward_cte)
    hits = " + ".join(f"CAST(x >= q[{i}] AS BIGINT)" for i in range(1, 10))
    cte(f"dec_{signal}", f"""SELECT 1 + {hits} AS quantile, count(*) AS count, avg(ret) AS mean_return_5d, median(ret) AS median_return_5d, stddev_pop(ret) AS std_return_5d,
      min(x) AS min_signal, max(x) AS max_signal, avg(x) AS mean_signal FROM sig_{signal},
      (SELECT quantile_cont(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM sig_{signal}) GROUP BY 1""", f"sig_{signal}")


_DEC = "mean_return_5d median_return_5d std_return_5d min_signal max_signal mean_signal"


def _decile(signal: str) -> None:
    rows, step = _SIGNALS[signal]
    _decile_cte(signal)

    @query(f"decile_{signal}", rows, sql(f"SELECT quantile, count, {rnd(_DEC)} FROM dec_{signal}", f"dec_{signal}"))
    def build(spark: SparkSession, sf: str) -> DataFrame:
        stats, _ = jobs.decile_study(step(trade_bars(spark, sf)), trade_days(spark, sf), signal)
        return shape(stats, f"quantile count {_DEC}")


for _s in _SIGNALS:
    _decile(_s)

_BEST = "best best_return worst worst_return best_high best_low best_extreme"


def _best_sql(cte_name: str, high: str, low: str) -> str:
    return sql(f"""SELECT arg_max(quantile, (mean_return_5d, quantile)) AS best, RND4(max(mean_return_5d)) AS best_return, arg_min(quantile, (mean_return_5d, quantile)) AS worst, RND4(min(mean_return_5d)) AS worst_return,
    arg_max(quantile, (mean_return_5d, quantile)) FILTER (min_signal >= {high}) AS best_high, arg_max(quantile, (mean_return_5d, quantile)) FILTER (max_signal <= {low}) AS best_low,
    arg_max(quantile, (mean_return_5d, quantile)) FILTER (quantile >= 8) AS best_extreme FROM {cte_name}""", cte_name)


@query("best_buckets", "F34", _best_sql("dec_volume_ratio", "1.5e0", "0.8e0"))
def best_buckets(spark: SparkSession, sf: str) -> DataFrame:
    _, best = jobs.decile_study(ind.volume_ratio(trade_bars(spark, sf)), trade_days(spark, sf), "volume_ratio")
    return shape(best, _BEST)


# volume ratio times RSI, and the volume ratio against the return ten trading days ahead


def _composite(n: int) -> None:
    signal = f"volume_ratio_rsi_{n}"
    _decile_cte(signal, f"volume_ratio * rsi_{n}")

    def study(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
        both = ind.run(trade_bars(spark, sf), ind.volume_ratio.stages(), ind.rsi.stages((n,)))
        both = both.withColumn(signal, F.col("volume_ratio") * F.col(f"rsi_{n}"))
        return jobs.decile_study(both, trade_days(spark, sf), signal, high=100.0, low=50.0)

    @query(f"decile_{signal}", "F22 L6", sql(f"SELECT quantile, count, {rnd(_DEC)} FROM dec_{signal}", f"dec_{signal}"))
    def deciles(spark: SparkSession, sf: str) -> DataFrame:
        return shape(study(spark, sf)[0], f"quantile count {_DEC}")

    @query(f"best_{signal}", "F34 L6", _best_sql(f"dec_{signal}", "100", "50"))
    def best(spark: SparkSession, sf: str) -> DataFrame:
        return shape(study(spark, sf)[1], _BEST)


for _n in (6, 10, 14):
    _composite(_n)

cte("fwd10", """SELECT a.order_book_id, a.date, (b.close - a.close) / a.close AS return_10d
FROM bseq a JOIN bseq b ON a.order_book_id = b.order_book_id AND b.trade_seq = a.trade_seq + 10""", "bseq")
_decile_cte("volume_ratio_10d", "volume_ratio", "fwd10", "return_10d")


@query("decile_volume_ratio_10d", "F22 L6", sql(
    f"SELECT quantile, count, {rnd(_DEC)} FROM dec_volume_ratio_10d".replace("AS mean_return_5d", "AS mean_return_10d").replace(
        "AS median_return_5d", "AS median_return_10d").replace("AS std_return_5d", "AS std_return_10d"), "dec_volume_ratio_10d"))
def decile_volume_ratio_10d(spark: SparkSession, sf: str) -> DataFrame:
    stats, _ = jobs.decile_study(ind.volume_ratio(trade_bars(spark, sf)), trade_days(spark, sf), "volume_ratio", 10)
    return shape(stats, f"quantile count {_DEC.replace('5d', '10d')}")


@query("best_volume_ratio_10d", "F34 L6", _best_sql("dec_volume_ratio_10d", "1.5e0", "0.8e0"))
def best_volume_ratio_10d(spark: SparkSession, sf: str) -> DataFrame:
    _, best = jobs.decile_study(ind.volume_ratio(trade_bars(spark, sf)), trade_days(spark, sf), "volume_ratio", 10)
    return shape(best, _BEST)


@query("distribution", "F11", sql(
    "SELECT count(*) AS count, " + ", ".join(f"RND4({e}) AS {n}" for n, e in [
        ("mean", "avg(x)"), ("median", "median(x)"), ("std", "stddev_pop(x)"), ("min", "min(x)"), ("max", "max(x)"),
        *[(f"p{p}", f"quantile_cont(x, {p / 100})") for p in (1, 5, 10, 25, 50, 75, 90, 95, 99)]]) + """,
    RND4(avg(pow(x - m, 3)) / pow(avg(pow(x - m, 2)), 1.5e0)) AS skew, RND4(avg(pow(x - m, 4)) / pow(avg(pow(x - m, 2)), 2) - 3) AS kurtosis
    FROM (SELECT boll_position AS x, avg(boll_position) OVER () AS m FROM ind WHERE boll_position IS NOT NULL)""", "ind"))
def distribution(spark: SparkSession, sf: str) -> DataFrame:
    df = res.distribution(ind.bollinger(trade_bars(spark, sf)), "boll_position")
    return shape(df, "count mean median std min max p1 p5 p10 p25 p50 p75 p90 p95 p99 skew kurtosis")


@query("discretise", "I9 L5", sql(
    """SELECT b AS bucket, count(*) AS n, RND6(min(ret)) AS low, RND6(max(ret)) AS high FROM (SELECT ret, len(list_filter(list_distinct(q), lambda e: e <= ret AND e < q[11])) AS b
      FROM (SELECT return_5d AS ret FROM fwd), (SELECT quantile_cont(return_5d, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS q FROM fwd)) GROUP BY 1""", "fwd"))
def discretise(spark: SparkSession, sf: str) -> DataFrame:
    fwd = materialised(forward(spark, sf).select("return_5d"))
    df = res.discretise(fwd, "return_5d")
    out = df.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("return_5d").alias("low"), F.max("return_5d").alias("high"))
    return shape(out, "bucket n low high", 6)


@query("histogram", "F26", sql(
    """SELECT CAST(least(floor((x - a) / (b - a) * 50), 49) + 1 AS BIGINT) AS bin, count(*) AS n, RND4(min(x)) AS low, RND4(max(x)) AS high
    FROM (SELECT ma10_angle AS x FROM ind WHERE ma10_angle IS NOT NULL), (SELECT min(ma10_angle) AS a, max(ma10_angle) AS b FROM ind) GROUP BY 1""", "ind"))
def histogram(spark: SparkSession, sf: str) -> DataFrame:
    return shape(res.histogram(ind.ma_angles(trade_bars(spark, sf), (10,)), "ma10_angle"), "bin n low high")


cte("acc", f"""SELECT * FROM (SELECT {KS}, v, v - {lag('v')} AS a FROM (SELECT {KS}, composite_score - {lag('composite_score')} AS v FROM scores)) WHERE v IS NOT NULL AND a IS NOT NULL""", "scores")
cte("accr", f"SELECT a, return_5d AS ret FROM acc JOIN fwd USING (order_book_id, date)", "acc", "fwd")


def _acceleration(spark: SparkSession, sf: str) -> DataFrame:
    scores = scored_bars(spark, sf).select("order_book_id", "date", "close", "composite_score")
    both = ind.score_changes(res.forward_return(scores, trade_days(spark, sf), 5, drop=False))
    return both.where("return_5d IS NOT NULL").select("order_book_id", "date", "score_acceleration", "return_5d")


@query("quartile_returns", "F24", sql(
    "SELECT " + ", ".join(f"RND5(avg(ret) FILTER (RND3(a) BETWEEN q[{i}] AND q[{i + 1}])) AS q{i}" for i in range(1, 5))
    + " FROM accr, (SELECT quantile_cont(RND3(a), [0.0, 0.25, 0.5, 0.75, 1.0]) AS q FROM accr)", "accr"))
def quartile_returns(spark: SparkSession, sf: str) -> DataFrame:
    df = shape(_acceleration(spark, sf), "score_acceleration return_5d", 3, "return_5d")
    return shape(res.quartile_means(df, "score_acceleration", "return_5d"), "q1 q2 q3 q4", 5)


@query("ols_trend", "F27", sql(
    "SELECT RND6(regr_slope(ret, a)) AS slope, RND6(regr_intercept(ret, a)) AS intercept, CAST(regr_count(ret, a) AS BIGINT) AS n FROM accr", "accr"))
def ols_trend(spark: SparkSession, sf: str) -> DataFrame:
    return shape(res.trend_line(_acceleration(spark, sf), "score_acceleration", "return_5d"), "slope intercept n", 6)


# ---------------------------------------------------------------- correlations

CATEGORIES = {
    "technical": ["sma_5", "sma_20", "rsi_6", "rsi_10", "rsi_14", "macd_diff", "macd_hist", "boll_std", "stoch_k", "stoch_j"],
    "momentum": ["ma5_angle", "ma10_angle", "pct_change", "volatility_5d", "volatility_20d"],
    "volume": ["volume_ratio", "volume_ma5", "main_net_inflow_ratio"],
    "risk": ["drawdown_from_high", "distance_to_support", "risk_reward_ratio"],
}
_COLS = [c for cols in CATEGORIES.values() for c in cols]
cte("corrin", f"SELECT {', '.join(_COLS)}, return_5d FROM ind JOIN fwd USING (order_book_id, date)", "ind", "fwd")
cte("corrs", " UNION ALL ".join(
    f"SELECT '{cat}' AS category, '{c}' AS indicator, count(*) AS n, corr({c}, return_5d) AS pearson FROM corrin WHERE {c} IS NOT NULL" for cat, cols in CATEGORIES.items() for c in cols), "corrin")
# the two-sided tail as the finite series for whole degrees of freedom (v = n - 2)
_RANK = "rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE"
cte("spears", " UNION ALL ".join(
    f"SELECT '{c}' AS indicator, count(*) AS n, corr(a, b) AS spearman FROM (SELECT {_RANK.format(c=c)} AS a, {_RANK.format(c='return_5d')} AS b FROM corrin WHERE {c} IS NOT NULL)" for c in _COLS), "corrin")


def _tail_cte(r: str, source: str) -> None:
    cte(f"{r}_v", f"SELECT indicator, n - 2 AS v, atan(abs({r}) / sqrt(1 - {r} * {r})) AS th FROM {source}", source)
    cte(f"{r}_k", f"SELECT indicator, v, th, CAST(unnest(range(0, CASE WHEN v % 2 = 1 THEN (v - 1) // 2 ELSE v // 2 END)) AS DOUBLE) AS k FROM {r}_v", f"{r}_v")
    cte(f"{r}_s", f"""SELECT indicator, sum(exp(CASE WHEN v % 2 = 1 THEN 2 * lgamma(k + 1) + k * ln(4) - lgamma(2 * k + 2)
  ELSE lgamma(2 * k + 1) - 2 * lgamma(k + 1) - k * ln(4) END + 2 * k * ln(cos(th)))) AS s FROM {r}_k GROUP BY 1""", f"{r}_k")
    cte(f"{r}_tail", f"""SELECT indicator, CASE WHEN v % 2 = 1 THEN 1 - 2 / pi() * (th + sin(th) * cos(th) * s) ELSE 1 - sin(th) * s END AS {r}_p
FROM {r}_v JOIN {r}_s USING (indicator)""", f"{r}_v", f"{r}_s")


_tail_cte("pearson", "corrs")
_tail_cte("spearman", "spears")
cte("ptail", "SELECT category, indicator, n, pearson, pearson_p FROM corrs JOIN pearson_tail USING (indicator)", "corrs", "pearson_tail")


def _signal_frame(spark: SparkSession, sf: str) -> DataFrame:
    """Indicators with forward returns."""
    b = trade_bars(spark, sf)
    df = ind.run(
        b, ind.sma.stages((5, 20)), ind.rsi.stages((6, 10, 14)), ind.macd.stages(), ind.bollinger.stages(),
        ind.stochastic.stages(), ind.ma_angles.stages((5, 10)), ind.changes.stages(), ind.volatility.stages((5, 20)),
        ind.volume_ratio.stages(), ind.volume_means.stages((5,)), ind.money_flow.stages(), ind.drawdown.stages(),
        ind.support.stages())
    return res.forward_return(df, trade_days(spark, sf), 5).select("return_5d", *_COLS)


@query("pearson", "F12 F15", sql("SELECT indicator, n, RND6(pearson) AS pearson FROM corrs", "corrs"))
def pearson(spark: SparkSession, sf: str) -> DataFrame:
    return shape(res.pearson_by_indicator(_signal_frame(spark, sf), _COLS, "return_5d"), "indicator n pearson", 6)


CORRELATIONS = """SELECT category, indicator, p.n, RND6(pearson) AS pearson, RND6(pearson_p) AS pearson_p, RND6(spearman) AS spearman, RND6(spearman_p) AS spearman_p,
    CASE WHEN pearson_p < 0.001e0 THEN '***' WHEN pearson_p < 0.01e0 THEN '**' WHEN pearson_p < 0.05e0 THEN '*' ELSE '' END AS stars
    FROM ptail p JOIN spears USING (indicator) JOIN spearman_tail USING (indicator)"""


@query("corr_by_indicator", "F14 F15 F16 L5", sql(CORRELATIONS, "ptail", "spears", "spearman_tail"))
def corr_by_indicator(spark: SparkSession, sf: str) -> DataFrame:
    frame = materialised(_signal_frame(spark, sf))  # Pearson and Spearman read it
    table = res.correlation_table(frame, CATEGORIES, "return_5d", held=True)
    return shape(res.strongest(table), "category indicator n pearson pearson_p spearman spearman_p stars", 6)


@query("spearman_by_indicator", "F13 F15", sql("SELECT indicator, RND6(spearman) AS spearman FROM spears", "spears"))
def spearman_by_indicator(spark: SparkSession, sf: str) -> DataFrame:
    return shape(res.spearman_by_indicator(_signal_frame(spark, sf), _COLS, "return_5d"), "indicator spearman", 6)


@query("spearman", "F13 F12", sql(
    f"SELECT count(*) AS n, RND6(corr(o_totalprice, o_custkey)) AS pearson, RND6(corr(a, b)) AS spearman FROM (SELECT o_totalprice, o_custkey, {_RANK.format(c='o_totalprice')} AS a, {_RANK.format(c='o_custkey')} AS b FROM orders)"))
def spearman(spark: SparkSession, sf: str) -> DataFrame:
    o = spark.read.parquet(f"{sf}/orders.parquet")
    return shape(res.spearman(o, "o_totalprice", "o_custkey"), "n pearson spearman", 6)


@query("strength_labels", "F17", sql(
    """SELECT indicator, CASE WHEN abs(pearson) > 0.5e0 THEN 'strong' WHEN abs(pearson) > 0.3e0 THEN 'moderate' ELSE 'weak' END || CASE WHEN pearson_p < 0.05e0 THEN ', significant' ELSE ', not significant' END AS label FROM ptail""", "ptail"))
def strength_labels(spark: SparkSession, sf: str) -> DataFrame:
    t = res.correlation_table(_signal_frame(spark, sf), CATEGORIES, "return_5d", with_spearman=False)
    return t.select("indicator", res.strength_label(F.col("pearson"), F.col("pearson_p")).alias("label"))


# ---------------------------------------------------------------- score validation

cte("val", f"""SELECT l.*, t.return_10d FROM latest_scores l JOIN (SELECT order_book_id, arg_max(r, date) AS return_10d FROM
  (SELECT {KS}, (close - {lag('close', 10)}) / {lag('close', 10)} * 100 AS r FROM bars) WHERE r IS NOT NULL GROUP BY 1) t USING (order_book_id)""", "latest_scores", "bars")
_DIMS = ["composite_score", "trend_score", "capital_score", "technical_score", "risk_score"]


def _validation(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return jobs.validate_scores(latest_scores(spark, sf), trade_bars(spark, sf))


@query("score_return_corr", "F12 E12 L7", sql(
    f"SELECT {', '.join(f'RND6(corr({d}, return_10d)) AS {d}_corr' for d in _DIMS)}, count(*) AS n FROM val", "val"))
def score_return_corr(spark: SparkSession, sf: str) -> DataFrame:
    return shape(_validation(spark, sf)["correlations"], " ".join(f"{d}_corr" for d in _DIMS) + " n", 6)


@query("score_thresholds", "F28 L7", sql(
    """SELECT p AS prob, threshold, count(*) AS rows, RND4(avg(return_10d)) AS mean_return FROM val,
      (SELECT p, (SELECT list(composite_score ORDER BY composite_score) FROM val)[CAST(floor(p * ((SELECT count(*) FROM val) - 1) + 0.5e0) AS BIGINT) + 1] AS threshold
       FROM (SELECT unnest([0.1e0, 0.25e0, 0.5e0, 0.75e0, 0.9e0]) AS p)) WHERE composite_score >= threshold GROUP BY 1, 2""", "val"))
def score_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    return shape(_validation(spark, sf)["thresholds"], "prob threshold rows mean_return")


@query("top_bottom", "F29 L7", sql(" UNION ALL ".join(
    f"SELECT '{side}' AS side, count(*) AS n, RND4(avg(return_10d)) AS mean_return, RND4(avg(CAST(return_10d > 0 AS DOUBLE))) AS share_positive, RND4(avg(CAST(return_10d < 0 AS DOUBLE))) AS share_negative FROM (SELECT return_10d FROM val ORDER BY composite_score {d}, order_book_id LIMIT 50)"
    for side, d in (("top", "DESC"), ("bottom", "ASC"))), "val"))
def top_bottom(spark: SparkSession, sf: str) -> DataFrame:
    return shape(_validation(spark, sf)["extremes"], "side n mean_return share_positive share_negative")


# ---------------------------------------------------------------- angles and market

_BANDS = [(-90, -45), (-45, -30), (-30, -15), (-15, 15), (15, 30), (30, 45), (45, 90)]


def _angles(spark: SparkSession, sf: str) -> DataFrame:
    return ind.ma_angles(trade_bars(spark, sf), (10,))


@query("angle_bands", "F18", sql(
    "SELECT band, count(*) AS n, RND6(count(*) / sum(count(*)) OVER ()) AS share FROM (SELECT CASE " + " ".join(
        f"WHEN ma10_angle >= {a} AND ma10_angle < {b} THEN '{a}..{b}'" for a, b in _BANDS) + " END AS band FROM ind) WHERE band IS NOT NULL GROUP BY 1", "ind"))
def angle_bands(spark: SparkSession, sf: str) -> DataFrame:
    return shape(res.angle_bands(_angles(spark, sf), "ma10_angle"), "band n share", 6)


cte("lastang", "SELECT order_book_id, arg_max(ma10_angle, date) AS x FROM ind GROUP BY 1", "ind")


@query("angle_trends", "F19 F6", sql(
    """SELECT count(*) AS symbols, count(*) FILTER (x > 30) AS strong_up, count(*) FILTER (x BETWEEN 10 AND 30) AS up, count(*) FILTER (x BETWEEN -10 AND 10) AS flat,
    count(*) FILTER (x BETWEEN -30 AND -10) AS down, count(*) FILTER (x < -30) AS strong_down FROM lastang WHERE x IS NOT NULL""", "lastang"))
def angle_trends(spark: SparkSession, sf: str) -> DataFrame:
    return res.angle_trends(pools.latest_per_symbol(_angles(spark, sf), ["ma10_angle"]), "ma10_angle")


@query("market_trend_shares", "F20", sql(
    """SELECT trend, count(*) AS symbols, RND6(count(*) / sum(count(*)) OVER ()) AS share FROM (SELECT CASE WHEN m > 2 THEN 'up' WHEN m < -2 THEN 'down' ELSE 'sideways' END AS trend
    FROM (SELECT avg(ma10_angle) AS m FROM ind WHERE ma10_angle IS NOT NULL GROUP BY order_book_id)) GROUP BY 1""", "ind"))
def market_trend_shares(spark: SparkSession, sf: str) -> DataFrame:
    return shape(res.mean_angle_trends(_angles(spark, sf), "ma10_angle", 2.0), "trend symbols share", 6)


@query("steepest", "F21", sql(
    "SELECT order_book_id, RND4(max(ma10_angle)) AS max_angle, count(*) AS n FROM ind WHERE ma10_angle > 40 GROUP BY 1 ORDER BY max(ma10_angle) DESC, 1 LIMIT 5", "ind"))
def steepest(spark: SparkSession, sf: str) -> DataFrame:
    return shape(res.steepest(_angles(spark, sf), "ma10_angle"), "order_book_id max_angle n")


@query("market_trend", "F5", sql(
    """SELECT date, RND4(m) AS avg_price, RND4(s) AS price_std, n AS stock_count, RND4((m - lag(m) OVER (ORDER BY date)) / lag(m) OVER (ORDER BY date) * 100) AS change_pct
    FROM (SELECT date, avg(close) AS m, stddev_samp(close) AS s, count(close) AS n FROM bars GROUP BY 1)""", "bars"))
def market_trend(spark: SparkSession, sf: str) -> DataFrame:
    return shape(res.market_trend(trade_bars(spark, sf)), "date avg_price price_std stock_count change_pct")


@query("market_change", "F5", sql(
    """SELECT RND4(a) AS first_mean, RND4(b) AS last_mean, RND4((b - a) / a * 100) AS change_pct FROM (SELECT arg_min(m, date) AS a, arg_max(m, date) AS b FROM (SELECT date, avg(close) AS m FROM bars GROUP BY 1))""", "bars"))
def market_change(spark: SparkSession, sf: str) -> DataFrame:
    return shape(res.market_change(trade_bars(spark, sf)), "first_mean last_mean change_pct")


@query("regime", "F30", sql(
    """SELECT RND4(m) AS mean_return, n, CASE WHEN m < -0.001e0 THEN 'bear' WHEN m > 0.001e0 THEN 'bull' ELSE 'sideways' END AS regime FROM (SELECT avg(pct_change) AS m, count(pct_change) AS n FROM ind)""", "ind"))
def regime(spark: SparkSession, sf: str) -> DataFrame:
    return shape(res.regime(trade_bars(spark, sf)), "mean_return n regime")


@query("daily_mean_returns", "F30 G21", sql(
    "SELECT date, RND4(avg(pct_change)) AS avg_return, count(*) AS stock_count FROM ind WHERE pct_change IS NOT NULL GROUP BY 1", "ind"))
def daily_mean_returns(spark: SparkSession, sf: str) -> DataFrame:
    return shape(res.daily_mean_returns(trade_bars(spark, sf)), "date avg_return stock_count")


cte("symret", """SELECT order_book_id, n AS bars, a AS first_close, b AS last_close, (b - a) / a AS total_return, CASE WHEN (b - a) / a > 0.05e0 THEN 'bullish' WHEN (b - a) / a < -0.05e0 THEN 'bearish' ELSE 'sideways' END AS trend, n >= 20 AS enough
FROM (SELECT order_book_id, count(*) AS n, arg_min(close, date) AS a, arg_max(close, date) AS b FROM bars GROUP BY 1)""", "bars")


@query("symbol_returns", "F31", sql("SELECT order_book_id, bars, first_close, last_close, RND4(total_return) AS total_return, trend, enough FROM symret", "symret"))
def symbol_returns(spark: SparkSession, sf: str) -> DataFrame:
    return shape(res.symbol_returns(trade_bars(spark, sf)), "order_book_id bars first_close last_close total_return trend enough", 4, "first_close last_close")


@query("majority", "F31", sql(
    """SELECT *, CASE WHEN bullish > bearish THEN 'BULLISH' WHEN bearish > bullish THEN 'BEARISH' ELSE 'MIXED' END AS verdict FROM
    (SELECT count(*) FILTER (trend = 'bullish') AS bullish, count(*) FILTER (trend = 'bearish') AS bearish, count(*) FILTER (trend = 'sideways') AS sideways FROM symret WHERE enough)""", "symret"))
def majority(spark: SparkSession, sf: str) -> DataFrame:
    return res.majority(res.symbol_returns(trade_bars(spark, sf)))


cte("fwds", "SELECT a.order_book_id, a.date, " + ", ".join(
    f"(b{n}.close - a.close) / a.close AS return_{n}d" for n in (5, 10, 20)) + " FROM bseq a " + " ".join(
    f"LEFT JOIN bseq b{n} ON b{n}.order_book_id = a.order_book_id AND b{n}.trade_seq = a.trade_seq + {n}" for n in (5, 10, 20)), "bseq")


@query("mean_returns", "F35", sql(
    "SELECT " + ", ".join(f"RND4(avg(return_{n}d)) AS mean_return_{n}d, RND4(avg(return_{n}d) FILTER (volume_ratio > 1)) AS cohort_return_{n}d" for n in (5, 10, 20))
    + ", RND4(avg(CAST(coalesce(volume_ratio > 1, false) AS DOUBLE))) AS cohort_share FROM ind JOIN fwds USING (order_book_id, date)", "ind", "fwds"))
def mean_returns(spark: SparkSession, sf: str) -> DataFrame:
    steps = (5, 10, 20)
    df = res.forward_returns(ind.volume_ratio(trade_bars(spark, sf)), trade_days(spark, sf), steps)
    out = res.mean_returns(df, [f"return_{n}d" for n in steps], F.col("volume_ratio") > 1)
    return shape(out, " ".join(f"mean_return_{n}d cohort_return_{n}d" for n in steps) + " cohort_share")
