"""Technical indicators per symbol.

Every rolling column uses one window key (symbol) and one order (date), so a set of indicators costs
one exchange and one sort of the bars while they are narrow. Bars
are unique per symbol and day, so a window partition never exceeds the trading days of one symbol,
whatever share of the trades that symbol has.

An indicator is a list of stages: columns of one stage may read the stages before it. `run` merges
the stages of many indicators level by level, so the columns of a level share one window pass
instead of one pass per indicator. A rolling value is null until its window holds the full number of
non-null inputs.
"""
from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence
from functools import wraps
from itertools import zip_longest

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from barloom.functions.numeric import as_col, pct_change

ID, DATE = "order_book_id", "date"
TEMP = "_t_"  # helper columns, dropped at the end of a run
NEGLIGIBLE = 46.0  # exp(-46) is about 1e-20
STEPS = 1e4  # price steps in one

Stages = list[dict[str, Column]]


def by_symbol() -> WindowSpec:
    return Window.partitionBy(ID).orderBy(DATE)


def trailing(n: int) -> WindowSpec:
    return by_symbol().rowsBetween(-(n - 1), 0)


def previous(column: Column | str, n: int = 1) -> Column:
    return F.lag(as_col(column), n).over(by_symbol())


def rolling(agg: Callable[[Column], Column], column: Column | str, n: int) -> Column:
    """The aggregate over the last n rows, null unless all n inputs are present."""
    x, w = as_col(column), trailing(n)
    return F.when(F.count(x).over(w) == n, agg(x).over(w))


def run(df: DataFrame, *indicators: Stages) -> DataFrame:
    """Add the columns of all indicators, one projection per level."""
    for level in zip_longest(*indicators, fillvalue={}):
        merged: dict[str, Column] = {}
        for columns in level:
            merged.update(columns)
        df = df.withColumns(merged)
    return df.drop(*[c for c in df.columns if c.startswith(TEMP)])


def staged(make: Callable[..., Stages]) -> Callable[..., DataFrame]:
    """`sma(df, ...)` runs one indicator; `sma.stages(...)` gives its stages for a joint run."""

    @wraps(make)
    def apply(df: DataFrame, *args, **kwargs) -> DataFrame:
        return run(df, make(*args, **kwargs))

    apply.stages = make
    return apply


class RollingSums:
    """Sums over the last n rows of one input, for several n, in two stages.

    Each sum is put together from sums over a few rows: n / step lags of one short frame instead of
    n updates per row and period. Nothing is subtracted, so no digits are lost. Whether all n inputs
    are there follows from a running count, which costs one update per row.
    """

    def __init__(self, name: str, x: Column | str, periods: Sequence[int]):
        self.name, self.x = name, as_col(x)
        common = math.gcd(*periods)
        self.step = {n: common if common > 1 else self._best_step(n) for n in periods}

    @staticmethod
    def _best_step(n: int) -> int:
        return min((g for g in range(1, n + 1) if n % g == 0), key=lambda g: (g + n // g, -g))

    def first(self) -> dict[str, Column]:
        seen = by_symbol().rowsBetween(Window.unboundedPreceding, Window.currentRow)
        out = {f"{TEMP}n_{self.name}": F.count(self.x).over(seen)}
        for g in set(self.step.values()):
            out[f"{TEMP}s{g}_{self.name}"] = F.sum(self.x).over(trailing(g))
        return out

    def total(self, n: int) -> Column:
        g = self.step[n]
        part, seen = f"{TEMP}s{g}_{self.name}", F.col(f"{TEMP}n_{self.name}")
        pieces = [F.col(part)] + [previous(part, k) for k in range(g, n, g)]
        before = F.lag(seen, n, 0).over(by_symbol())
        return F.when(seen - before == n, sum(pieces[1:], pieces[0]))

    def mean(self, n: int) -> Column:
        return self.total(n) / F.lit(float(n))


# ---------------------------------------------------------------- moving averages


@staged
def sma(periods: Sequence[int] = (5, 10, 20, 30, 60), of: str = "close",
        prefix: str = "sma") -> Stages:
    sums = RollingSums(of, of, periods)
    return [sums.first(), {f"{prefix}_{n}": sums.mean(n) for n in periods}]


def _steps(span: int) -> list[int]:
    """Factors whose product is a number of rows beyond which older rows weigh nothing."""
    if span < 2:
        raise ValueError("a span has to be at least 2")
    rows = math.ceil(NEGLIGIBLE / -math.log1p(-2.0 / (span + 1.0)))
    levels = max(1, round(math.log(rows, 8)))
    out: list[int] = []
    for left in range(levels, 0, -1):
        out.append(max(2, math.ceil(rows ** (1 / left) - 1e-9)))
        rows = math.ceil(rows / out[-1])
    return out


def ewm_rows(span: int) -> int:
    """Rows that an exponential mean reads, its own one included."""
    return math.prod(_steps(span))


def _ewm_levels(name: str, source: str, span: int) -> Stages:
    """Decayed sums of the values and of their weights, in as many stages as `_steps` has factors: each puts the
    sums over the last rows together from shorter ones that lie one beside the other."""
    keep, width = 1.0 - 2.0 / (span + 1.0), 1
    stages: Stages = []
    steps = _steps(span)
    for level, step in enumerate(steps, 1):
        columns = {}
        for kind in ("num", "den"):
            shorter = source if level == 1 else f"{TEMP}{kind}{level - 1}_{name}"
            pieces = []
            for k in range(step - 1, -1, -1):  # the oldest first, so the small ones are added up first
                x = F.lag(shorter, k * width).over(by_symbol()) if k else F.col(shorter)
                if level == 1 and kind == "den":
                    x = F.when(x.isNotNull(), 1.0)
                pieces.append(F.coalesce(x, F.lit(0.0)) * F.lit(math.pow(keep, k * width)))
            columns[f"{TEMP}{kind}_{name}" if level == len(steps) else f"{TEMP}{kind}{level}_{name}"] = sum(pieces[1:], pieces[0])
        stages.append(columns)
        width *= step
    return stages


def _side_by_side(*indicators: Stages) -> Stages:
    """Stages that need nothing of each other, level by level."""
    return [{k: v for columns in level for k, v in columns.items()} for level in zip_longest(*indicators, fillvalue={})]


def _ewm_mean(name: str, source: str) -> Column:
    return F.when(F.col(source).isNotNull(),
                  F.col(f"{TEMP}num_{name}") / F.col(f"{TEMP}den_{name}"))


@staged
def ema(spans: Sequence[int] = (5, 10, 20, 30), of: str = "close", prefix: str = "ema") -> Stages:
    """Exponential means with weights from the first row (the adjusted form).

    The mean is the ratio of two decayed sums over the last rows, as many of them as weigh more than 1e-20, so it
    is finite for any length of history. The sums are put together level by level from lags in the order of the
    days: no further sort, and nothing is looped per symbol.
    """
    names = {f"{prefix}_{n}": n for n in spans}
    return [*_side_by_side(*[_ewm_levels(name, of, n) for name, n in names.items()]),
            {name: _ewm_mean(name, of) for name in names}]


@staged
def macd(fast: int = 12, slow: int = 26, signal: int = 9) -> Stages:
    """macd_diff = fast - slow, macd_dea = mean of the difference, macd_hist = 2 (diff - dea)."""
    f, s, d = "macd_fast", "macd_slow", "macd_dea"
    diff, dea = F.col("macd_diff"), _ewm_mean(d, "macd_diff")
    return [
        *_side_by_side(_ewm_levels(f, "close", fast), _ewm_levels(s, "close", slow)),
        {"macd_diff": _ewm_mean(f, "close") - _ewm_mean(s, "close")},
        *_ewm_levels(d, "macd_diff", signal),
        {"macd_dea": dea, "macd_hist": F.lit(2.0) * (diff - dea)},
    ]


# ---------------------------------------------------------------- oscillators and bands


def _in_steps(price: Column | str) -> Column:
    """The price in steps of 1e-4: a whole number where the price is the double nearest to one, so that sums are exact."""
    x = as_col(price) * F.lit(STEPS)
    return F.when(F.rint(x) / F.lit(STEPS) == as_col(price), F.rint(x)).otherwise(x)


@staged
def rsi(periods: Sequence[int] = (14,), details: bool = False) -> Stages:
    """Simple-mean RSI. No loss but some gain is 100; neither is null.

    Gains and losses are added up in steps of 1e-4, so prices of up to four decimals that stand at 50 (or any other whole
    number) give exactly that, whatever binary fractions they have.
    """
    change = F.col(f"{TEMP}steps") - previous(f"{TEMP}steps")
    gain = F.when(F.col(f"{TEMP}change") > 0, F.col(f"{TEMP}change")).otherwise(F.lit(0.0))
    loss = F.when(F.col(f"{TEMP}change") < 0, -F.col(f"{TEMP}change")).otherwise(F.lit(0.0))
    gains, losses = RollingSums("gain", gain, periods), RollingSums("loss", loss, periods)
    sums, values = {}, {}
    for n in periods:
        g, l = f"{TEMP}gain_{n}", f"{TEMP}loss_{n}"
        sums.update({g: gains.total(n), l: losses.total(n)})
        both, rs = F.col(g) + F.col(l), F.try_divide(F.col(g), F.col(l))
        values[f"rsi_{n}"] = F.when((both > 0) & (both < float("inf")), F.lit(100.0) * F.col(g) / both).when(
            rs.isNotNull(), F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + rs)
        ).when((F.col(l) == 0) & (F.col(g) > 0), F.lit(100.0))
        if details:
            values.update({f"avg_gain_{n}": F.col(g) / F.lit(n * STEPS), f"avg_loss_{n}": F.col(l) / F.lit(n * STEPS), f"rs_{n}": rs})
    if details:
        values.update({"price_change": F.col(f"{TEMP}change") / F.lit(STEPS), "gain": gain / F.lit(STEPS), "loss": loss / F.lit(STEPS)})
    return [{f"{TEMP}steps": _in_steps("close")}, {f"{TEMP}change": change}, {**gains.first(), **losses.first()}, sums, values]


@staged
def bollinger(n: int = 20, width: float = 2.0, of: str = "close") -> Stages:
    """boll +- width sample deviations, with the position of the close inside the band."""
    mid, dev = F.col("boll"), F.col("boll_std")
    sums = RollingSums(of, of, [n])
    return [
        {**sums.first(), "boll_std": rolling(F.stddev_samp, of, n)},
        {"boll": sums.mean(n)},
        {
            "boll_up": mid + F.lit(width) * dev,
            "boll_down": mid - F.lit(width) * dev,
            "boll_position": F.when(dev > 0, (F.col(of) - mid) / dev),
        },
    ]


@staged
def stochastic(n: int = 9, smooth: int = 3) -> Stages:
    low, high = rolling(F.min, "low", n), rolling(F.max, "high", n)
    k, d = F.col("stoch_k"), rolling(F.avg, "stoch_k", smooth)
    return [
        {f"{TEMP}rsv": F.try_divide(F.col("close") - low, high - low) * F.lit(100.0)},
        {"stoch_k": rolling(F.avg, f"{TEMP}rsv", smooth)},
        {"stoch_d": d},
        {"stoch_j": F.lit(3.0) * k - F.lit(2.0) * F.col("stoch_d")},
    ]


@staged
def true_range(n: int = 14) -> Stages:
    last = F.col(f"{TEMP}last")
    parts = {"hl": F.col("high") - F.col("low"), "hc": F.abs(F.col("high") - last),
             "lc": F.abs(F.col("low") - last)}
    widest = F.greatest(*parts.values())
    sums = RollingSums("tr", widest, [n])
    return [{f"{TEMP}last": previous("close")},
            {**parts, "true_range": widest, **sums.first()}, {f"atr_{n}": sums.mean(n)}]


# ---------------------------------------------------------------- volume and flow


@staged
def volume_ratio(window: int = 10, out: str = "volume_ratio") -> Stages:
    sums = RollingSums("volume", "volume", [window])
    return [sums.first(), {out: F.try_divide(F.col("volume"), sums.mean(window))}]


@staged
def volume_means(periods: Sequence[int] = (5, 10, 20)) -> Stages:
    sums = RollingSums("volume", "volume", periods)
    return [sums.first(), {f"volume_ma{n}": sums.mean(n) for n in periods}]


@staged
def volume_trend() -> Stages:
    """Short against long volume mean: above 1.1 increasing, within 10 % stable, 0.8-0.9
    intermittent, below that decreasing."""
    x = F.col(f"{TEMP}vt")
    label = (
        F.when(x > 1.1, "increasing").when(x >= 0.9, "stable").when(x >= 0.8, "intermittent")
        .when(x.isNotNull(), "decreasing")
    )
    sums = RollingSums("volume", "volume", (5, 20))
    return [sums.first(), {f"{TEMP}vt": F.try_divide(sums.mean(5), sums.mean(20))},
            {"volume_trend": label}]


@staged
def money_flow(n: int = 5) -> Stages:
    """Signed amount (by the sign of close - open) over total amount, last n rows."""
    signed = F.signum(F.col("close") - F.col("open")) * F.col("amount")
    flow = F.col(f"main_net_inflow_{n}d")
    return [
        {"net_inflow": signed, f"main_net_inflow_{n}d": rolling(F.sum, signed, n),
         f"{TEMP}amount": rolling(F.sum, "amount", n)},
        {"main_net_inflow_ratio": F.try_divide(flow, F.col(f"{TEMP}amount"))},
    ]


# ---------------------------------------------------------------- change, angle, risk


@staged
def changes() -> Stages:
    """pct_change / returns (same value) and the price difference to the previous bar."""
    last = F.col(f"{TEMP}last")
    change = pct_change(F.col("close"), last)
    return [{f"{TEMP}last": previous("close")},
            {"pct_change": change, "returns": change, "price_diff": F.col("close") - last}]


@staged
def price_angle() -> Stages:
    change = pct_change(F.col("close"), previous("close"))
    return [{"price_angle": F.degrees(F.atan(change))}]


@staged
def ma_angles(periods: Sequence[int] = (5, 10, 20, 30, 60), mode: str = "atan") -> Stages:
    """Angle of the moving average: atan of the percent change, or 45 tanh(2 change)."""
    if mode not in ("atan", "tanh"):
        raise ValueError(f"unknown angle mode {mode!r}")
    angles = {}
    for n in periods:
        mean = f"{TEMP}sma_{n}"
        change = pct_change(F.col(mean), previous(mean))
        angles[f"ma{n}_angle"] = (
            F.degrees(F.atan(change * F.lit(100.0))) if mode == "atan"
            else F.tanh(change * F.lit(2.0)) * F.lit(45.0))
    sums = RollingSums("close", "close", periods)
    return [sums.first(), {f"{TEMP}sma_{n}": sums.mean(n) for n in periods}, angles]


@staged
def volatility(periods: Sequence[int] = (5, 10, 20)) -> Stages:
    """Annualised sample deviation of daily returns."""
    change = pct_change(F.col("close"), F.col(f"{TEMP}last"))
    year = F.lit(math.sqrt(252.0))
    return [{f"{TEMP}last": previous("close")},
            {f"volatility_{n}d": rolling(F.stddev_samp, change, n) * year for n in periods}]


def _from_steps(short: str, first: int, rows: int, step: int, pick: Callable[..., Column]) -> Column:
    """Extreme of `rows` rows that start `first` rows back, from the extremes over `step` rows.

    rows / step lags instead of `rows` updates per row; the last piece overlaps its neighbour.
    """
    starts = [*range(first, first + rows - step + 1, step)]
    if starts[-1] != first + rows - step:
        starts.append(first + rows - step)
    return pick(*[previous(short, k) if k else F.col(short) for k in starts])


@staged
def year_range(rows: int = 250, step: int = 16) -> Stages:
    """Highest high and lowest low of the rows before the current one."""
    return [
        {f"{TEMP}top_{step}": F.max("high").over(trailing(step)),
         f"{TEMP}bottom_{step}": F.min("low").over(trailing(step))},
        {"year_high": _from_steps(f"{TEMP}top_{step}", 1, rows, step, F.greatest),
         "year_low": _from_steps(f"{TEMP}bottom_{step}", 1, rows, step, F.least)},
    ]


@staged
def drawdown(rows: int = 60, step: int = 16) -> Stages:
    """Distance of the close below the highest high of the last rows."""
    top = _from_steps(f"{TEMP}top_{step}", 0, rows, step, F.greatest)
    return [{f"{TEMP}top_{step}": F.max("high").over(trailing(step))},
            {"drawdown_from_high": F.lit(1.0) - F.try_divide(F.col("close"), top)}]


@staged
def support(rows: int = 20) -> Stages:
    """Distance to the recent low, whether it broke, and reward over risk to the recent high."""
    step = 16 if rows > 32 else max(rows // 2, 1)
    low, high = F.col(f"{TEMP}sup"), F.col(f"{TEMP}res")
    risk = F.col("close") - low
    return [
        {f"{TEMP}top_{step}": F.max("high").over(trailing(step)),
         f"{TEMP}bottom_{step}": F.min("low").over(trailing(step))},
        {f"{TEMP}sup": _from_steps(f"{TEMP}bottom_{step}", 1, rows, step, F.least),
         f"{TEMP}res": _from_steps(f"{TEMP}top_{step}", 1, rows, step, F.greatest)},
        {"distance_to_support": F.try_divide(risk, low),
         "support_broken": F.col("close") < low,
         "risk_reward_ratio": F.when(risk > 0, (high - F.col("close")) / risk)},
    ]


def mini_score(df: DataFrame) -> DataFrame:
    """Mean of three signals: RSI beyond 70/30, sign of the MACD bar, close outside the band.

    A signal whose column the frame lacks is left out of the mean; a missing value is neutral for
    RSI and band and negative for MACD.
    """
    signals = []
    if "rsi_14" in df.columns:
        r = F.col("rsi_14")
        signals.append(F.when(r > 70, 1.0).when(r < 30, -1.0).otherwise(0.0))
    if "macd_hist" in df.columns:
        signals.append(F.when(F.col("macd_hist") > 0, 1.0).otherwise(-1.0))
    if {"boll_up", "boll_down"} <= set(df.columns):
        close = F.col("close")
        signals.append(F.when(close > F.col("boll_up"), 1.0)
                       .when(close < F.col("boll_down"), -1.0).otherwise(0.0))
    if not signals:
        return df
    return df.withColumn("mini_score", sum(signals[1:], signals[0]) / F.lit(float(len(signals))))


def score_changes(df: DataFrame, of: str = "composite_score") -> DataFrame:
    """First and second difference of a score per symbol; rows without both are dropped."""
    df = df.withColumn("score_velocity", F.col(of) - previous(of))
    df = df.withColumn("score_acceleration", F.col("score_velocity") - previous("score_velocity"))
    return df.where(F.col("score_velocity").isNotNull() & F.col("score_acceleration").isNotNull())


def last_rows(df: DataFrame, n: int) -> DataFrame:
    """The newest n bars of each symbol."""
    rank = F.row_number().over(Window.partitionBy(ID).orderBy(F.desc(DATE)))
    return df.withColumn("recency", rank).where(F.col("recency") <= n)


# ---------------------------------------------------------------- registry

REGISTRY: dict[str, Callable[[], Stages]] = {
    "sma": sma.stages,
    "ema": ema.stages,
    "rsi": lambda: rsi.stages((6, 10, 12, 14)),
    "macd": macd.stages,
    "bollinger": bollinger.stages,
    "stochastic": stochastic.stages,
    "atr": true_range.stages,
    "changes": changes.stages,
    "volume_ratio": volume_ratio.stages,
    "volume_means": volume_means.stages,
    "volume_trend": volume_trend.stages,
    "money_flow": money_flow.stages,
    "price_angle": price_angle.stages,
    "ma_angles": ma_angles.stages,
    "volatility": volatility.stages,
    "year_range": year_range.stages,
    "drawdown": drawdown.stages,
    "support": support.stages,
}

# fixed values: the catalog's and older names -> the entry that makes the column
ALIASES = {
    "SMA": "sma", "EMA": "ema", "RSI": "rsi", "MACD": "macd", "BOLL": "bollinger",
    "Bollinger": "bollinger", "VOLUME_RATIO": "volume_ratio", "PRICE_ANGLE": "price_angle",
    "sma_5": "sma", "sma_10": "sma", "sma_20": "sma", "sma_30": "sma", "sma_60": "sma",
    "ema_5": "ema", "ema_10": "ema", "ema_20": "ema", "ema_30": "ema",
    "rsi_6": "rsi", "rsi_10": "rsi", "rsi_12": "rsi", "rsi_14": "rsi",
    "macd_diff": "macd", "macd_dea": "macd", "macd_hist": "macd", "macd_signal": "macd",
    "bollinger_upper": "bollinger", "bollinger_middle": "bollinger",
    "bollinger_lower": "bollinger", "stoch_k": "stochastic", "stoch_d": "stochastic",
    "stoch_j": "stochastic", "atr_14": "atr", "returns": "changes", "pct_change": "changes",
}


def calculate_indicators(df: DataFrame, names: Iterable[str] | None = None) -> DataFrame:
    """Add the named indicators (all when None). An unknown name raises."""
    wanted = list(REGISTRY) if names is None else [ALIASES.get(n, n) for n in names]
    unknown = [n for n in wanted if n not in REGISTRY]
    if unknown:
        raise ValueError(f"unknown indicators: {unknown}")
    return run(df, *[make() for name, make in REGISTRY.items() if name in wanted])


def catalog_names(df: DataFrame) -> DataFrame:
    """The catalog's names beside the working ones."""
    same = {
        "macd": "macd_diff", "macd_signal": "macd_dea", "bollinger_upper": "boll_up",
        "bollinger_middle": "boll", "bollinger_lower": "boll_down",
    }
    return df.withColumns({new: F.col(old) for new, old in same.items() if old in df.columns})


def scorer_inputs(df: DataFrame) -> DataFrame:
    """All columns the scorer reads, except industry, market cap and the order-size share."""
    return run(
        df, sma.stages((5, 10, 20)), ma_angles.stages((10,)), year_range.stages(),
        volatility.stages((20,)), changes.stages(), volume_ratio.stages(), money_flow.stages(),
        volume_trend.stages(), rsi.stages((14,)), bollinger.stages(), stochastic.stages(),
        drawdown.stages(), support.stages(), macd.stages(),
    )
