"""Combining frames. Keys are unique per side; sizes and skew are left to the planner's statistics
and runtime re-planning instead of fixed hints."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from barloom.functions.ranks import cumulative_counts
from barloom.operators.clean import rename_collisions

ID, DATE = "order_book_id", "date"
KEYS = (ID, DATE)


def merge_all(bars: DataFrame, fundamentals: DataFrame | None = None,
              technicals: DataFrame | None = None) -> DataFrame:
    """Bars with fundamentals and technicals of the same symbol and day; a technical column that the
    frame already has gets the suffix `_technical`."""
    out = bars
    if fundamentals is not None:
        out = out.join(rename_collisions(fundamentals, out, KEYS, "_fundamental"), list(KEYS), "left")
    if technicals is not None:
        out = out.join(rename_collisions(technicals, out, KEYS, "_technical"), list(KEYS), "left")
    return out


def outer_on_common(left: DataFrame, right: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Full outer join on the given keys, or on every column both sides have."""
    common = list(keys) if keys else [c for c in left.columns if c in right.columns]
    if not common:
        raise ValueError("no common column; use side_by_side with an order column")
    return left.join(right, common, "full")


def ordinal(df: DataFrame, key: str, out: str = "ordinal") -> DataFrame:
    """1-based place by a unique numeric key, without a single-task sort."""
    cum = cumulative_counts(df, key).select(F.col(key), (F.col("below") + 1).alias(out))
    return df.withColumn(key, F.col(key).cast("double")).join(cum, key)


def side_by_side(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> DataFrame:
    """Rows of two frames without common columns next to each other, in key order."""
    return ordinal(left, left_key).join(ordinal(right, right_key), "ordinal", "full")


def reconcile(left: DataFrame, right: DataFrame, columns: Sequence[str],
              tolerance: float = 0.01) -> DataFrame:
    """Row-wise absolute differences of two sources on common keys, flagged above the tolerance."""
    a = left.select(*KEYS, *[F.col(c).alias(f"{c}_a") for c in columns])
    b = right.select(*KEYS, *[F.col(c).alias(f"{c}_b") for c in columns])
    diffs = {f"{c}_diff": F.abs(F.col(f"{c}_a") - F.col(f"{c}_b")) for c in columns}
    out = a.join(b, list(KEYS)).withColumns(diffs)
    worst = [F.col(d) for d in diffs]
    top = F.greatest(*worst) if len(worst) > 1 else worst[0]
    return out.withColumns({"max_diff": top, "differs": top > tolerance})


def reconcile_summary(diffs: DataFrame) -> DataFrame:
    """Per symbol: compared rows, differing rows, the largest difference and its day."""
    return diffs.groupBy(ID).agg(
        F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("differs"), 1)).alias("differing"),
        F.max("max_diff").alias("largest"),
        F.max_by(DATE, F.struct("max_diff", DATE)).alias("largest_on"))


def union_rows(first: DataFrame, *others: DataFrame) -> DataFrame:
    for o in others:
        first = first.unionByName(o, allowMissingColumns=True)
    return first


def common_dates(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.select(DATE).intersect(right.select(DATE))


def absent(wanted: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Distinct keys of the first frame that the second one lacks."""
    return wanted.select(key).distinct().join(present.select(key), key, "left_anti")


def wide_factors(long: DataFrame, names: Sequence[str]) -> DataFrame:
    """Long factor rows -> one column per factor. The names are given, so no extra pass finds them."""
    return long.groupBy(*KEYS).pivot("factor_name", list(names)).agg(F.max("factor_value"))


def select_factors(long: DataFrame, names: Sequence[str] | None = None,
                   symbols: Sequence[str] | None = None) -> DataFrame:
    cond: Column = F.lit(True)
    if names:
        cond = cond & F.col("factor_name").isin(list(names))
    if symbols:
        cond = cond & F.col(ID).isin(list(symbols))
    return long.where(cond)


def select_fields(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Keys and the requested fields as doubles; a field the frame lacks is null."""
    return df.select(*KEYS, *[
        (F.col(f) if f in df.columns else F.lit(None)).cast("double").alias(f) for f in fields])
