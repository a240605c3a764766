"""Reports on nulls, completeness, odd prices and table profiles. All are mergeable aggregates."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

ID, DATE = "order_book_id", "date"
OHLC = ("open", "high", "low", "close")


def null_report(df: DataFrame) -> DataFrame:
    """(column, data_type, rows, nulls, completeness %) in one pass over the frame."""
    types = dict(df.dtypes)
    one = df.agg(F.count(F.lit(1)).alias("_rows"),
                 *[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in df.columns])
    parts = F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(types[c]).alias("data_type"),
                 F.col("_rows").alias("rows"), F.col(c).alias("nulls")) for c in df.columns])
    full = F.try_divide(F.col("rows") - F.col("nulls"), F.col("rows")) * F.lit(100.0)
    return one.select(F.inline(parts)).withColumn("completeness", full)


def quality_score(df: DataFrame) -> DataFrame:
    """One row: rows, columns, null cells, quality between 0 and 1 and in percent."""
    nulls = sum((F.col(c).isNull().cast("bigint") for c in df.columns), F.lit(0).cast("bigint"))
    one = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(nulls), F.lit(0)).alias("null_cells"))
    ratio = F.try_divide(F.col("null_cells"), F.col("rows") * F.lit(len(df.columns)))
    q = F.coalesce(F.lit(1.0) - ratio, F.lit(0.0))
    return one.select("rows", F.lit(len(df.columns)).cast("bigint").alias("columns"), "null_cells",
                      F.greatest(q, F.lit(0.0)).alias("quality"), (q * 100.0).alias("quality_pct"))


def tables_report(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and columns of each table and a coverage score of min(100, total rows / 100)."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("source"), "rows", F.lit(len(df.columns)).cast("bigint").alias("columns"))
        out = one if out is None else out.unionByName(one)
    total = out.agg(F.sum("rows").alias("s"))
    return out.withColumn("coverage_score", F.least(
        F.lit(100.0), total.scalar() / F.lit(10000.0) * F.lit(100.0)))


def panel_completeness(df: DataFrame) -> DataFrame:
    """rows / (symbols x days)."""
    return profile(df).select(
        "rows", "symbols", "dates",
        F.try_divide(F.col("rows"), F.col("symbols") * F.col("dates")).alias("completeness"))


def profile(df: DataFrame) -> DataFrame:
    """One row: rows, distinct symbols and days, first and last day. Exact distinct counts run in
    two phases, so they also hold for large key sets."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(ID).alias("symbols"),
                  F.countDistinct(DATE).alias("dates"), F.min(DATE).alias("first_date"),
                  F.max(DATE).alias("last_date"))


def approximate_profile(df: DataFrame, error: float = 0.02) -> DataFrame:
    """The same with sketches for the distinct counts."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct(ID, error).alias("symbols"),
                  F.approx_count_distinct(DATE, error).alias("dates"))


def symbol_summary(df: DataFrame) -> DataFrame:
    return df.groupBy(ID).agg(
        F.avg("close").alias("mean_close"), F.max("close").alias("max_close"),
        F.min("close").alias("min_close"), F.avg("volume").alias("mean_volume"),
        F.sum("volume").alias("total_volume"))


# fixed values: the three rules on a price
PRICE_RULES = {"too_high": "> 10000", "too_low": "< 0.1", "not_positive": "<= 0"}


def _broken(c: Column) -> dict[str, Column]:
    """A price at or below zero breaks the last two rules at once."""
    return {"too_high": c > 10000, "too_low": c < 0.1, "not_positive": c <= 0}


def abnormal_prices(df: DataFrame, columns: Sequence[str] = OHLC) -> DataFrame:
    """Per symbol, price column and rule: number, minimum, maximum and mean of offending values. Only the
    offending values are unfolded and grouped."""
    cells = [F.when(bad, F.struct(F.lit(c).alias("price_column"), F.lit(rule).alias("rule"), F.col(c).alias("v")))
             for c in columns for rule, bad in _broken(F.col(c)).items()]
    hits = df.where(_any_abnormal(columns)).select(ID, F.explode(F.array_compact(F.array(*cells))).alias("x"))
    return hits.groupBy(ID, "x.price_column", "x.rule").agg(
        F.count("x.v").alias("n"), F.min("x.v").alias("min_price"), F.max("x.v").alias("max_price"), F.avg("x.v").alias("mean_price"))


def abnormal_totals(df: DataFrame) -> DataFrame:
    """Offending values by rule and by column, as rows (kind, name, n)."""
    bad = abnormal_prices(df)
    rules = bad.groupBy(F.col("rule").alias("name")).agg(F.sum("n").alias("n"))
    cols = bad.groupBy(F.col("price_column").alias("name")).agg(F.sum("n").alias("n"))
    return rules.select(F.lit("rule").alias("kind"), "name", "n").unionByName(
        cols.select(F.lit("column").alias("kind"), "name", "n"))


def _any_abnormal(columns: Sequence[str] = OHLC) -> Column:
    out = F.lit(False)
    for c in columns:
        for bad in _broken(F.col(c)).values():
            out = out | F.coalesce(bad, F.lit(False))
    return out


def abnormal_symbols(df: DataFrame, k: int = 20) -> DataFrame:
    """The symbols with the most abnormal bars: bars, abnormal bars, percent."""
    per = df.groupBy(ID).agg(F.count(F.lit(1)).alias("bars"),
                             F.count(F.when(_any_abnormal(), 1)).alias("abnormal"))
    return per.where(F.col("abnormal") > 0).orderBy(F.desc("abnormal"), F.asc(ID)).limit(k).withColumn(
        "abnormal_pct", F.col("abnormal") / F.col("bars") * F.lit(100.0))


def abnormal_summary(df: DataFrame) -> DataFrame:
    """Symbols in the data, symbols with an abnormal bar, their share, abnormal bars."""
    per = df.groupBy(ID).agg(F.count(F.when(_any_abnormal(), 1)).alias("abnormal"))
    hit = F.count(F.when(F.col("abnormal") > 0, 1))
    return per.agg(F.count(F.lit(1)).alias("symbols"), hit.alias("abnormal_symbols"),
                   F.sum("abnormal").alias("abnormal_bars"),
                   (hit / F.count(F.lit(1)) * F.lit(100.0)).alias("abnormal_pct"))


# fixed values: the columns whose nulls a scorer warns of, and the share that is too many
WARNED = ("close", "high", "low", "open", "volume")
NULL_LIMIT = 0.1


def scorer_warnings(df: DataFrame, industries: Sequence[str], limit: float = NULL_LIMIT) -> DataFrame:
    """Warnings on a scorer input, as rows (kind, detail): missing close, empty frame, price or
    volume columns with too many nulls, industries outside the known list."""
    fields = [c for c in WARNED if c in df.columns]
    one = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in fields])
    checks = [F.when(F.col("_n") == 0, F.struct(F.lit("empty").alias("kind"), F.lit("").alias("detail")))]
    if "close" not in df.columns:
        checks.append(F.struct(F.lit("missing_column").alias("kind"), F.lit("close").alias("detail")))
    checks += [F.when(F.try_divide(F.col(c), F.col("_n")) > limit,
                      F.struct(F.lit("nulls").alias("kind"), F.lit(c).alias("detail"))) for c in fields]
    out = one.select(F.explode(F.filter(F.array(*checks), lambda x: x.isNotNull())).alias("w")).select("w.*")
    if "industry" in df.columns:
        odd = df.where(F.col("industry").isNotNull() & ~F.col("industry").isin(list(industries)))
        out = out.unionByName(odd.select(
            F.lit("unknown_industry").alias("kind"), F.col("industry").alias("detail")).distinct())
    return out


def warning_count(df: DataFrame, industries: Sequence[str]) -> DataFrame:
    """One row: how many warnings `scorer_warnings` gives, unknown industries being one together. A single
    pass over a few narrow columns."""
    fields = [c for c in WARNED if c in df.columns]
    n = F.count(F.lit(1))
    found = [F.when(n == 0, 1).otherwise(0)]
    found += [F.when(F.try_divide(F.count(F.when(F.col(c).isNull(), 1)), n) > NULL_LIMIT, 1).otherwise(0) for c in fields]
    if "industry" in df.columns:
        odd = F.col("industry").isNotNull() & ~F.col("industry").isin(list(industries))
        found.append(F.when(F.count(F.when(odd, 1)) > 0, 1).otherwise(0))
    missing = 0 if "close" in df.columns else 1
    return df.agg((sum(found[1:], found[0]) + F.lit(missing)).cast("bigint").alias("warnings"))
