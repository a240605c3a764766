"""Small column helpers shared by every operator."""
from __future__ import annotations

from pyspark.sql import Column, functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def usable(c: Column | str, positive: bool = False) -> Column:
    """True when the value is neither null, NaN nor infinite (and above 0 if asked)."""
    x = as_col(c).cast("double")
    ok = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    if positive:
        ok = ok & (x > 0)
    return F.coalesce(ok, F.lit(False))


def usable_or_null(c: Column | str) -> Column:
    return F.when(usable(c), as_col(c).cast("double"))


def to_tick(c: Column | str, decimals: int = 2) -> Column:
    """Round half up to the price tick, with plain IEEE steps so that every engine agrees."""
    scale = float(10**decimals)
    return F.floor(as_col(c) * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


TIE_NUDGE = 0.0037


def rounded(c: Column | str, digits: int) -> Column:
    """Rounded for reporting, without a negative zero.

    Values that lie exactly between two steps are common (means of prices in cents). The nudge of
    0.37 % of the last digit settles them upwards whatever the order in which a sum was taken.
    """
    nudge = float(f"{TIE_NUDGE:g}e-{digits}")
    return F.round(as_col(c) + F.lit(nudge), digits) + F.lit(0.0)


def clip(c: Column, low: float, high: float) -> Column:
    """Bound a value; a null stays null (greatest/least alone would skip it)."""
    bounded = F.least(F.greatest(c, F.lit(float(low))), F.lit(float(high)))
    return F.when(c.isNotNull(), bounded)


def pct_change(now: Column, before: Column) -> Column:
    return F.try_divide(now - before, before)


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation over the rows that have both, null where one of them does not vary."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
