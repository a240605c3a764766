"""Two-sided p-value of a correlation. Runs on summary rows (one per indicator), never on bars."""
from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F, types as T

# executors get the functions themselves, so the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NORMAL_FROM = 1e7  # degrees of freedom


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz steps)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 5000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + term / c
            c = c if abs(c) > tiny else tiny
            step = c * d
            h *= step
        if abs(step - 1.0) < 1e-15:
            return h
    raise ArithmeticError(f"incomplete beta function does not converge at a={a}, b={b}, x={x}")


def regularized_beta(a: float, b: float, x: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    log_front = (
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(log_front) * _beta_fraction(a, b, x) / a
    return 1.0 - math.exp(log_front) * _beta_fraction(b, a, 1.0 - x) / b


def two_sided_p(r: float, n: float) -> float:
    if r is None or n is None or np.isnan(r) or n < 3:
        return float("nan")
    if abs(r) >= 1.0:
        return 0.0
    df = n - 2.0
    t2 = r * r * df / (1.0 - r * r)
    if df > NORMAL_FROM:  # log gammas lose digits there; the normal limit is right to order 1 / df**2
        return math.erfc(math.sqrt(t2 / (2.0 + t2 / df)) * (1.0 - 0.25 / df))
    return regularized_beta(df / 2.0, 0.5, df / (df + t2))


@F.pandas_udf(T.DoubleType())
def _p_udf(r: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([two_sided_p(a, b) for a, b in zip(r.astype(float), n.astype(float))])


def correlation_p_value(r: Column, n: Column) -> Column:
    return F.nanvl(_p_udf(r.cast("double"), n.cast("double")), F.lit(None).cast("double"))
