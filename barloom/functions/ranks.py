"""Exact ranks and quantiles without a single-task sort.

`percentile` and un-partitioned rank windows gather all values of a group in one task. Here the
values are first reduced to distinct values with counts (map-side combined, so a value that holds a
third of the rows costs one row), the distinct values are cut into ranges, and ranks follow from a
prefix sum over the range totals plus a window inside each range. The range edges come from a
sketch and only balance the work; any edges give the same exact result.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.functions.reuse import materialised

MAX_RANGES = 8192  # edges held by the driver: at most this many doubles
HEAVY_SHARE = 1000  # a value with more than total/HEAVY_SHARE rows is heavy: at most 1000 of them


def _range_count(df: DataFrame) -> int:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(16, min(2 * parts, MAX_RANGES))


def value_counts(df: DataFrame, value: str, by: Sequence[str] = (),
                 weight: str | None = None) -> DataFrame:
    """Distinct values (no null, no NaN) with their number of rows, or the sum of a row count that
    an earlier aggregation left in `weight`."""
    x = F.col(value).cast("double")
    n = F.col(weight) if weight else F.lit(1).cast("bigint")
    return (
        df.where(x.isNotNull() & ~F.isnan(x))
        .select(*by, (x + F.lit(0.0)).alias(value), n.alias("n"))
        .groupBy(*by, value)
        .agg(F.sum("n").alias("n"))
    )


def cumulative_counts(
    df: DataFrame, value: str, by: Sequence[str] = (), ranges: int | None = None,
    weight: str | None = None,
) -> DataFrame:
    """Per distinct value: `n`, rows strictly `below` it, and the `total` of its group."""
    by = list(by)
    # read three times below (edges, range totals, ranks); the frame behind it only once
    counts = materialised(value_counts(df, value, by, weight))
    k = ranges or _range_count(df)
    points = [i / k for i in range(1, k)]
    cuts = counts.approxQuantile(value, points, 1.0 / (4 * k)) if points else []
    inner = sorted({c for c in cuts if c not in (float("inf"), float("-inf"))})
    splits = [float("-inf"), *inner, float("inf")]
    if len(splits) < 3:
        binned = counts.withColumn("_range", F.lit(0.0))
    else:
        binned = Bucketizer(splits=splits, inputCol=value, outputCol="_range").transform(counts)

    totals = binned.groupBy(*by, "_range").agg(F.sum("n").alias("_n"))
    # at most `ranges` rows per group
    head = Window.partitionBy(*by).orderBy("_range")
    totals = totals.select(
        *by,
        "_range",
        F.coalesce(
            F.sum("_n").over(head.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_start"),
        F.sum("_n").over(Window.partitionBy(*by)).alias("total"),
    )
    inside = Window.partitionBy(*by, "_range").orderBy(value)
    if not by:
        totals = F.broadcast(totals)  # never more than MAX_RANGES rows
    joined = binned.join(totals, [*by, "_range"])
    before = F.coalesce(
        F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    return joined.select(*by, value, "n", (F.col("_start") + before).alias("below"), "total")


def _pick(value: str, rank: Column) -> Column:
    hit = (F.col("below") <= rank) & (rank < F.col("below") + F.col("n"))
    return F.max(F.when(hit, F.col(value)))


def quantile_columns(value: str, probs: Sequence[float], how: str = "linear") -> list[Column]:
    """Aggregates over `cumulative_counts` output, one per probability."""
    out = []
    for p in probs:
        pos = F.lit(float(p)) * (F.col("total") - F.lit(1)).cast("double")
        if how == "nearest":
            out.append(_pick(value, F.floor(pos + F.lit(0.5))))
            continue
        low, high = _pick(value, F.floor(pos)), _pick(value, F.ceil(pos))
        part = F.max(pos - F.floor(pos))
        out.append(low + (high - low) * part)
    return out


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    names: Sequence[str],
    by: Sequence[str] = (),
    how: str = "linear",
) -> DataFrame:
    """Exact quantiles per group: linear interpolation, or the nearest rank (half up)."""
    cum = cumulative_counts(df, value, by)
    cols = [c.alias(n) for c, n in zip(quantile_columns(value, probs, how), names)]
    return cum.groupBy(*by).agg(*cols) if by else cum.agg(*cols)


def join_lookup(rows: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join rows to a table with one row per key and a flag `_heavy` for keys with very many rows.

    The flag may be set for at most HEAVY_SHARE keys per group (each holds more than one part in
    HEAVY_SHARE of the rows), so those are matched by broadcast and no join task receives all rows
    of such a key. The other keys join by shuffle with a bounded share of the rows each.
    """
    keys = list(keys)
    heavy = F.broadcast(table.where("_heavy").drop("_heavy"))
    light = table.where(~F.col("_heavy")).drop("_heavy")
    rest = rows.join(heavy.select(*keys), keys, "left_anti").join(light, keys)
    return rows.join(heavy, keys).unionByName(rest)


def average_rank(df: DataFrame, value: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """Add the tie-averaged rank of `value` (1-based, within the `by` group) to every row with a
    value. `by` has to be a fixed short list of groups, such as indicator names."""
    by = list(by)
    cum = cumulative_counts(df, value, by)
    key = f"_{out}_key"
    table = cum.select(
        *by,
        F.col(value).alias(key),
        (F.col("below") + (F.col("n") + F.lit(1)) / F.lit(2.0)).alias(out),
        (F.col("n") * F.lit(HEAVY_SHARE) > F.col("total")).alias("_heavy"),
    )
    x = F.col(value).cast("double")
    rows = df.where(x.isNotNull() & ~F.isnan(x)).withColumn(key, x + F.lit(0.0))
    return join_lookup(rows, table, [*by, key]).drop(key)


TIE_SHARE = 1 << 6  # salts for the rows of one value that is a range edge


def range_edges(df: DataFrame, columns: Sequence[str], ranges: int) -> dict[str, list[float]]:
    """Strictly rising edges of each column from a quantile sketch, for all columns in one pass. A value that
    holds more than about two parts in `ranges` of the rows is an edge."""
    probs = [k / ranges for k in range(1, ranges)]
    one = df.agg(*[F.percentile_approx(c, probs, 10 * ranges).alias(c) for c in columns]).first()
    return {c: sorted(set(one[c] or ())) for c in columns}


def with_ranges(df: DataFrame, edges: dict[str, list[float]]) -> DataFrame:
    """For each column the number of its range, in `_r_<column>`: odd between two edges, even for the values that
    equal an edge, which are all ties."""
    names = list(edges)
    splits = [[float("-inf"), *(edges[c] or [0.0]), float("inf")] for c in names]
    marked = Bucketizer(splitsArray=splits, inputCols=names, outputCols=[f"_b_{c}" for c in names], handleInvalid="keep").transform(df)
    made = {}
    for c, cut in zip(names, splits):
        at = F.col(f"_b_{c}").cast("int")  # edges at or below the value
        edge = F.get(F.array(*[F.lit(x) for x in cut[:-1]]), at)
        made[f"_r_{c}"] = 2 * at + F.when(F.col(c) == edge, 0).otherwise(1)
    return marked.withColumns(made).drop(*[f"_b_{c}" for c in names])


def rank_in_ranges(df: DataFrame, by: str, value: str, part: str, out: str, counted: DataFrame | None = None) -> DataFrame:
    """The tie-averaged rank of `value` within `by` as column `out`, where `part` is the value's range number from
    `with_ranges`. The rows are shuffled once, by range; ranks inside a range come from its sorted rows and are
    moved by the number of rows in the ranges before it. The rows of an edge value have the same rank, so they
    may lie in any task. `counted` is a frame with the same ranges that is cheaper to read twice."""
    head = Window.partitionBy(by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    totals = (df if counted is None else counted).groupBy(by, part).agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_before", F.coalesce(F.sum("_n").over(head), F.lit(0)))  # one row a range
    tie = F.col(part) % 2 == 0
    rest = [c for c in df.columns if c not in (by, part)]
    salted = df.withColumn("_salt", F.when(tie, F.pmod(F.xxhash64(*rest, F.lit(5)), F.lit(TIE_SHARE))).otherwise(0))
    inside = Window.partitionBy(by, part, "_salt").orderBy(value)
    peers = F.count(F.lit(1)).over(Window.partitionBy(by, part, "_salt", value))  # sorted alike
    ranked = salted.withColumns({"_rank": F.rank().over(inside), "_peers": peers})
    own = F.when(tie, (F.col("_n") + 1) / 2.0).otherwise(F.col("_rank") + (F.col("_peers") - 1) / 2.0)
    return ranked.join(F.broadcast(totals), [by, part]).withColumn(out, F.col("_before") + own).drop(
        "_salt", "_rank", "_peers", "_n", "_before", part)
