"""Rankings, pools and lookups over scored rows."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.functions.reuse import materialised

ID, DATE = "order_book_id", "date"

# fixed values: pool name -> (size)
POOL_SIZES = {"basic": 100, "watch": 50, "core": 20}


def pool(scores: DataFrame, name: str, score: str = "composite_score",
         size: int | None = None) -> DataFrame:
    """The best `size` symbols by a non-null score, ties by id. The sort keeps only that many rows
    per task; the rank window then runs over the few rows that are left."""
    k = POOL_SIZES[name] if size is None else size
    best = (scores.where(F.col(score).isNotNull())
            .select(ID, F.col(score).alias("score")).orderBy(F.desc("score"), F.asc(ID)).limit(k))
    return best.withColumn(
        "rank", F.row_number().over(Window.orderBy(F.desc("score"), F.asc(ID))).cast("bigint"))


def pool_statistics(pools: dict[str, DataFrame]) -> DataFrame:
    """Size of each pool and the number of distinct symbols in any."""
    tagged = None
    for name, df in pools.items():
        part = df.select(ID, F.lit(name).alias("pool"))
        tagged = part if tagged is None else tagged.unionByName(part)
    sizes = [F.count(F.when(F.col("pool") == n, 1)).alias(f"{n}_size") for n in pools]
    return tagged.agg(*sizes, F.countDistinct(ID).alias("distinct_symbols"))


def rank_per_date(scores: DataFrame, score: str = "composite_score") -> DataFrame:
    """Rank of every symbol among the symbols of its day, ties by id.

    Rows are sorted in ranges over (day, score, id), so a large day is spread over several tasks. The rank is
    the place inside the range plus the day's rows in earlier ranges. The broadcast side has a row for each
    day and range that meet, at most one a day plus one a range.
    """
    order = [F.asc(DATE), F.desc_nulls_last(score), F.asc(ID)]
    scores = materialised(scores)  # the range shuffle samples its input first
    # the places count from the start of a range and are kept, so that no later pass cuts other ranges
    placed = materialised(scores.repartitionByRange(*order).sortWithinPartitions(*order)
                          .withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)  # the id holds the partition above 33 bits of row number
    earlier = Window.partitionBy(DATE).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(DATE, part.alias("_part")).agg(
        F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    starts = starts.select(F.col(DATE).alias("_day"), "_part",
                           (F.col("_first") - F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - 1).alias("_zero"))
    ranked = placed.join(F.broadcast(starts), (part == F.col("_part")) & F.col(DATE).eqNullSafe(F.col("_day")))
    return ranked.select(*scores.columns, (F.col("_at") - F.col("_zero")).alias("day_rank"))


def latest_per_symbol(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Newest row of each symbol. A mergeable aggregate instead of a sort of the symbol's rows."""
    row = F.max_by(F.struct(DATE, *columns), F.col(DATE))
    return df.groupBy(ID).agg(row.alias("_r")).select(ID, "_r.*")


def latest_non_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column the newest value that is not null."""
    return df.groupBy(ID).agg(*[
        F.max_by(c, F.when(F.col(c).isNotNull(), F.col(DATE))).alias(c) for c in columns])


def details(bars: DataFrame, factors: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Latest bar of each symbol with its factor row of that day, if any."""
    return latest_per_symbol(bars, columns).join(factors, [ID, DATE], "left")


def screen(df: DataFrame, condition: Column | str, order: Sequence[Column], limit: int) -> DataFrame:
    cond = F.expr(condition) if isinstance(condition, str) else condition
    return df.where(cond).orderBy(*order).limit(limit)


def resolve_codes(codes: DataFrame, known: DataFrame,
                  suffixes: Sequence[str] = (".XSHE", ".XSHG", "")) -> DataFrame:
    """Bare code -> the first known id among code+suffix, in the order of the suffixes."""
    tries = F.array(*[
        F.struct(F.lit(i).alias("priority"), F.concat("code", F.lit(s)).alias(ID))
        for i, s in enumerate(suffixes)])
    cand = codes.select("code", F.explode(tries).alias("t")).select("code", "t.*")
    hits = cand.join(known.select(ID).distinct(), ID)
    return hits.groupBy("code").agg(F.min_by(ID, "priority").alias(ID))


def search_codes(known: DataFrame, part: str, limit: int | None = None) -> DataFrame:
    """Ids that contain the text, ignoring case; with a limit the first ones by id."""
    found = known.select(ID).distinct().where(F.lower(ID).contains(part.lower()))
    return found if limit is None else found.orderBy(ID).limit(limit)


def sub_scores(scores: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sub-scores as rows (id, date, sub_score, value, place), best first."""
    long = scores.unpivot([ID, DATE], list(columns), "sub_score", "value")
    w = Window.partitionBy(ID, DATE).orderBy(F.desc_nulls_last("value"), F.asc("sub_score"))
    return long.withColumn("place", F.row_number().over(w).cast("bigint"))


def pool_membership(scores: DataFrame, definitions: Sequence[dict]) -> DataFrame:
    """Rows of every named pool: its filter, its score (weighted expressions), its status.

    One pass over the scores: each row yields one entry per pool it belongs to.
    """
    entries = []
    for d in definitions:
        weight = float(sum(w for _, w in d["rules"]))
        parts = [F.expr(e).cast("double") * F.lit(float(w)) for e, w in d["rules"]]
        score = F.try_divide(sum(parts[1:], parts[0]), F.lit(weight))
        entries.append(F.when(F.expr(d["filter"]), F.struct(
            F.lit(d["pool_id"]).alias("pool_id"), F.lit(d.get("status", "active")).alias("status"),
            score.alias("pool_score"))))
    hits = F.filter(F.array(*entries), lambda x: x.isNotNull())
    return scores.select(ID, F.explode(hits).alias("p")).select(ID, "p.*")


def pool_overview(members: DataFrame) -> DataFrame:
    return members.groupBy("pool_id", "status").agg(
        F.count(F.lit(1)).alias("members"), F.avg("pool_score").alias("mean_score"))


def activity_filter(history: DataFrame, having: str) -> DataFrame:
    """Per symbol mean score and its correlation with the volume, filtered like a HAVING clause."""
    return history.groupBy(ID).agg(
        F.count(F.lit(1)).alias("bars"), F.avg("composite_score").alias("mean_score"),
        F.corr("composite_score", "volume").alias("score_volume_corr")).where(F.expr(having))
