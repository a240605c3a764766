"""Filters, casts, projections and de-duplication."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from barloom.functions.numeric import as_col, usable

ID, DATE = "order_book_id", "date"
OHLC = ["open", "high", "low", "close"]

# fixed values: other spellings of the standard columns
COLUMN_ALIASES = {
    "code": ID, "stock_code": ID, "ticker": ID, "trade_date": DATE, "datetime": DATE,
    "vol": "volume", "turnover": "amount", "total_turnover": "amount",
}


def date_range(df: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    if start is not None:
        df = df.where(F.col(DATE) >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col(DATE) <= F.lit(end).cast("date"))
    return df


def completed_only(df: DataFrame, as_of: str) -> DataFrame:
    return df.where(F.col(DATE) < F.lit(as_of).cast("date"))


def universe(instruments: DataFrame, wanted: Sequence[str] | None = None) -> DataFrame:
    """Active main-market symbols without special-treatment names; an explicit list wins."""
    if wanted:
        return instruments.where(F.col(ID).isin(list(wanted)))
    return instruments.where(
        (F.col("status") == "Active") & F.col(ID).rlike(r"\.(XSHG|XSHE)$")
        & ~F.col("symbol").rlike(r"ST|PT|\*"))


def reorder(df: DataFrame, first: Sequence[str]) -> DataFrame:
    head = [c for c in first if c in df.columns]
    return df.select(*head, *[c for c in df.columns if c not in head])


def to_doubles(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Bad text becomes null."""
    return df.withColumns({c: as_col(c).try_cast("double") for c in columns if c in df.columns})


def to_floats(df: DataFrame, columns: Sequence[str] = (*OHLC, "volume")) -> DataFrame:
    return df.withColumns({c: as_col(c).cast("float") for c in columns if c in df.columns})


def parse_dates(df: DataFrame, columns: Sequence[str] = (DATE,)) -> DataFrame:
    """Text dates -> dates; text that is no date becomes null."""
    texts = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    return df.withColumns({
        c: F.when(F.col(c).rlike(r"^\d{4}-\d{2}-\d{2}"), F.col(c).substr(1, 10)).try_cast("date")
        for c in columns if c in texts})


def standard_names(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed(
        {old: new for old, new in COLUMN_ALIASES.items()
         if old in df.columns and new not in df.columns})


def finite_only(df: DataFrame, column: str, positive: bool = False) -> DataFrame:
    return df.where(usable(column, positive))


def normal_price(low: float = 0.1, high: float = 10000.0) -> Column:
    cond = F.lit(True)
    for c in OHLC:
        cond = cond & F.col(c).between(low, high)
    return F.coalesce(cond, F.lit(False))


def drop_abnormal(df: DataFrame, low: float = 0.1, high: float = 10000.0) -> DataFrame:
    return df.where(normal_price(low, high))


def removed_symbols(df: DataFrame, low: float = 0.1, high: float = 10000.0) -> DataFrame:
    """Symbols with a rejected row, the number of such rows, and the columns at fault."""
    bad = df.where(~normal_price(low, high))
    at_fault = [F.max(F.when(~F.coalesce(F.col(c).between(low, high), F.lit(False)), F.lit(c)))
                for c in OHLC]
    return bad.groupBy(ID).agg(
        F.count(F.lit(1)).alias("bad_rows"), F.concat_ws(",", *at_fault).alias("columns"))


def valid_rsi(df: DataFrame, columns: Sequence[str] = ("rsi_6", "rsi_10", "rsi_14")) -> DataFrame:
    for c in columns:
        df = df.where(usable(c) & F.col(c).between(0, 100))
    return df


def steep_slopes(df: DataFrame, angle: str = "ma10_angle", days: int = 30,
                 steps: Sequence[float] = (1.0, 0.5)) -> DataFrame:
    """Rows near the last day with any slope whose angle exceeds the first threshold that still
    has rows; without any such row, every row with a finite angle.

    The day and the threshold come from one subquery over counts per day."""
    finite = df.where(usable(angle))
    over = [F.count(F.when(F.col(angle) > s, 1)) for s in steps]
    per_day = finite.groupBy(DATE).agg(
        F.count(F.when(F.col(angle) != 0, 1)).alias("moving"), F.array(*over).alias("over"))
    one = per_day.agg(F.max(F.when(F.col("moving") > 0, F.col(DATE))).alias("last"),
                      F.collect_list(F.struct(DATE, "over")).alias("all"))  # one entry per day

    def has_rows(i: int) -> Column:
        return F.exists("all", lambda x: x[DATE].between(F.date_sub("last", days), F.col("last"))
                        & (x["over"][i] > 0))

    cut = F.lit(None).cast("double")
    for i in reversed(range(len(steps))):
        cut = F.when(has_rows(i), F.lit(float(steps[i]))).otherwise(cut)
    pick = one.select(F.struct("last", cut.alias("cut")).alias("p"))
    return finite.withColumn("_p", pick.scalar()).where(
        F.col(DATE).between(F.date_sub("_p.last", days), F.col("_p.last"))
        & (F.col("_p.cut").isNull() | (F.col(angle) > F.col("_p.cut")))).drop("_p")


def with_provenance(df: DataFrame, values: dict[str, str], total: str | None = None) -> DataFrame:
    """Constant columns, and the row count of the frame if a name for it is given."""
    out = df.withColumns({k: F.lit(v) for k, v in values.items()})
    if total:
        out = out.withColumn(total, df.agg(F.count(F.lit(1)).alias("n")).scalar())
    return out


def rename_collisions(df: DataFrame, other: DataFrame, keys: Sequence[str], suffix: str) -> DataFrame:
    return df.withColumnsRenamed(
        {c: f"{c}{suffix}" for c in df.columns if c in other.columns and c not in keys})


def align(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The target's columns in its order; what is missing becomes a typed null."""
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields])


# ---------------------------------------------------------------- nulls and duplicates


def drop_null_rows(df: DataFrame, how: str = "any") -> DataFrame:
    return df.na.drop(how)


def dedup(df: DataFrame, order: Sequence[Column | str], keep: str = "last",
          keys: Sequence[str] = (ID, DATE)) -> DataFrame:
    """One row per key, first or last by a total order. A mergeable aggregate, so copies collapse
    before the shuffle and a key with very many copies stays cheap."""
    keys = [k for k in keys if k in df.columns]
    if not keys:
        raise ValueError("none of the key columns is in the frame")
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[as_col(c) for c in order])
    pick = F.max_by if keep == "last" else F.min_by
    one = df.groupBy(*keys).agg(pick(F.struct(*rest), rank).alias("_r"))
    return one.select(*keys, "_r.*").select(*df.columns)


def duplicate_keys(df: DataFrame, keys: Sequence[str] = (ID, DATE)) -> DataFrame:
    """Number of keys that occur more than once, and the rows beyond the first of each."""
    many = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return many.agg(F.count(F.lit(1)).alias("duplicated_keys"),
                    F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra_rows"))


def clean(df: DataFrame, order: Sequence[Column | str], remove_nulls: bool = True,
          remove_duplicates: bool = True) -> DataFrame:
    if remove_nulls:
        df = drop_null_rows(df)
    return dedup(df, order, keep="first") if remove_duplicates else df


def merge_update(existing: DataFrame, new: DataFrame, keys: Sequence[str] = (ID, DATE),
                 order: Sequence[str] = ()) -> DataFrame:
    """Existing and new rows in one aggregate over the key, the new one winning; a column that only one
    side has keeps that side's values. `order` (columns of both sides) settles repeated keys within a
    side, the largest winning; without it such a key has to be unique."""
    old_only = [c for c in existing.columns if c not in new.columns]
    new_only = [c for c in new.columns if c not in existing.columns]
    shared = [c for c in existing.columns if c in new.columns and c not in keys]
    both = existing.withColumn("_src", F.lit(0)).unionByName(
        new.withColumn("_src", F.lit(1)), allowMissingColumns=True)
    rank = F.struct("_src", *order)
    picks = [(shared, rank), (old_only, F.when(F.col("_src") == 0, rank)), (new_only, F.when(F.col("_src") == 1, rank))]
    picks = [(f"_r{i}", cols, by) for i, (cols, by) in enumerate(picks) if cols]
    if not picks:
        return both.select(*keys).distinct()
    one = both.groupBy(*keys).agg(*[F.max_by(F.struct(*cols), by).alias(name) for name, cols, by in picks])
    found = {c: F.col(name).getField(c).alias(c) for name, cols, _ in picks for c in cols}
    return one.select(*[F.col(c) if c in keys else found[c] for c in [*existing.columns, *new_only]])
