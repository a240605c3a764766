"""Mixing sources to target weights by Poisson replication.

A source with share w of the target and size s repeats each of its documents a Poisson number of times with
mean w * total / s. The number is the inverse of the Poisson distribution at a uniform number hashed from the
document's id, so it does not depend on partitions or order. Documents are exploded by their counts and
shuffled globally: dealt to partitions and sorted there by a hash of id and replica.

Sizes are UTF-8 bytes of text. Weights default to size ** temperature, scaled to sum to one; given weights are
scaled likewise, and a source that is not in them is left out.

Edge cases: a null source is a source of its own, named ''; null and empty texts count as one byte, so that
every source has a size; repeated rows get equal counts; equal ids draw equal numbers; a null id hashes like
the text ''; an empty table gives no rows; columns named replica or shuffle_key are replaced.
"""
from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from barloom.functions.ranks import HEAVY_SHARE, join_lookup
from barloom.llm.common import saved, table
from barloom.llm.registry import query

TEMPERATURE = 0.5
SEED = 17
DEVIATIONS = 12  # a distribution is tabulated so many standard deviations around its mean
BROADCAST_STEPS = 1 << 22  # so many numbers (32 MB) of all distributions together are broadcast, more are joined
LEAST_START = 50  # a table starts above zero only from here on, where Stirling's series is exact to 1e-15
HEX = 12  # digits of a hash that make a uniform number: 48 bits


def _hash(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(SEED)), *parts).cast("binary"))


def _id(doc_id: str) -> Column:
    return F.coalesce(F.col(doc_id).cast("string"), F.lit(""))


def uniform(doc_id: str) -> Column:
    return F.conv(F.substring(_hash(_id(doc_id)), 1, HEX), 16, 10).cast("double") / F.lit(float(1 << 4 * HEX))


def _size(text: str) -> Column:
    return F.greatest(F.octet_length(F.coalesce(F.col(text), F.lit(""))), F.lit(1)).cast("long")


def rates(docs: DataFrame, weights: Mapping[str, float] | None = None, temperature: float = TEMPERATURE,
          source: str = "source", text: str = "text") -> DataFrame:
    """Per source its rows, size, and mean number of repetitions."""
    sizes = docs.groupBy(F.coalesce(F.col(source), F.lit("")).alias("_source")).agg(
        F.count("*").alias("rows"), F.sum(_size(text)).alias("size"))
    if weights is None:
        sizes = sizes.withColumn("_w", F.pow(F.col("size").cast("double"), F.lit(float(temperature))))
    else:
        if any(w < 0 for w in weights.values()) or not sum(weights.values()) > 0:
            raise ValueError("weights are not negative and their sum is positive")
        given = docs.sparkSession.createDataFrame([(k, float(w)) for k, w in weights.items()], "_source string, _w double")
        sizes = sizes.join(given, "_source", "left").fillna(0.0, ["_w"])
    sizes = saved(sizes, "sizes")
    total = sizes.agg(F.sum("size").alias("total"), F.sum("_w").alias("all")).first()
    if total["total"] is None or not total["all"]:
        return sizes.select("_source", "rows", "size", F.lit(0.0).alias("rate"))
    return sizes.select("_source", "rows", "size", (
        F.col("_w") / F.lit(float(total["all"])) * F.lit(float(total["total"])) / F.col("size")).alias("rate"))


def _log_factorial(n: Column) -> Column:
    """Stirling's series."""
    x = n.cast("double")
    return (x * F.log(x) - x + F.lit(0.5) * F.log(F.lit(2 * math.pi) * x) + F.lit(1 / 12) / x - F.lit(1 / 360) / (x * x * x)
            + F.lit(1 / 1260) / (x * x * x * x * x))


def _bounds(rate: Column) -> tuple[Column, Column]:
    spread = F.lit(DEVIATIONS) * F.sqrt(rate) + F.lit(20)
    low = F.floor(rate - spread)
    return F.when(low < LEAST_START, F.lit(0)).otherwise(low).cast("long"), F.ceil(rate + spread).cast("long")


def poisson_steps(rate: DataFrame) -> DataFrame:
    """Per source the count `start` and the ascending values `cdf` of its distribution function from there on, as far
    as the function can be told from 0 and 1; logs keep large means from underflow."""
    low, high = _bounds(F.col("rate"))
    steps = rate.where("rate > 0").withColumn("start", low).withColumn("k", F.explode(F.sequence(low, high)))
    so_far = Window.partitionBy("_source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    further = F.sum(F.when(F.col("k") > F.col("start"), F.log(F.col("k").cast("double"))).otherwise(0.0)).over(so_far)
    factorial = further + F.when(F.col("start") > 0, _log_factorial(F.greatest("start", F.lit(1)))).otherwise(0.0)
    p = F.exp(F.col("k") * F.log("rate") - F.col("rate") - factorial)
    steps = steps.withColumn("p", p).withColumn("cdf", F.sum("p").over(so_far))
    return steps.groupBy("_source", "start").agg(F.sort_array(F.collect_list("cdf")).alias("cdf"))


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, temperature: float = TEMPERATURE,
        doc_id: str = "doc_id", source: str = "source", text: str = "text", marks: bool = True) -> DataFrame:
    """The documents, each as often as drawn, dealt out and sorted by a random key; with `marks` also
    `replica` (from 0) and that key, `shuffle_key`."""
    rate = saved(rates(docs, weights, temperature, source, text), "rates")
    low, high = _bounds(F.col("rate"))
    found = rate.agg(F.sum(high - low + 1).alias("steps"), F.sum("rows").alias("rows")).first()
    steps = poisson_steps(rate)
    # the row travels as one struct, so that no name of its own can clash with those used here
    rows = docs.select(F.coalesce(F.col(source), F.lit("")).alias("_source"), uniform(doc_id).alias("u"),
                       _id(doc_id).alias("id"), F.struct(*docs.columns).alias("doc"))
    if (found["steps"] or 0) <= BROADCAST_STEPS:
        drawn = rows.join(F.broadcast(steps), "_source")
    else:  # then sources with over a thousandth of the rows, at most a thousand, are broadcast
        heavy = rate.select("_source", (F.col("rows") * HEAVY_SHARE > F.lit(found["rows"])).alias("_heavy"))
        drawn = join_lookup(rows, saved(steps.join(heavy, "_source"), "steps"), ["_source"])
    above = F.size(F.filter("cdf", lambda c: c <= F.col("u")))
    drawn = drawn.withColumn("n", (F.col("start") + above).cast("int")).where("n > 0")
    out = drawn.select("id", "doc", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("replica"))
    out = out.select("doc", "replica", _hash(F.col("id"), F.col("replica").cast("string")).alias("shuffle_key"))
    out = out.repartition("shuffle_key").sortWithinPartitions("shuffle_key")
    own = [F.col("doc").getField(c).alias(c) for c in docs.columns if not marks or c not in ("replica", "shuffle_key")]
    return out.select(*own, "replica", "shuffle_key") if marks else out.select(*own)


_ORACLE = f"""
WITH sizes AS (
  SELECT coalesce(source, '') AS s, sum(greatest(strlen(coalesce(text, '')), 1))::BIGINT AS size FROM documents GROUP BY 1),
rates AS (
  SELECT s, pow(size::DOUBLE, {TEMPERATURE}) / (SELECT sum(pow(size::DOUBLE, {TEMPERATURE})) FROM sizes)
            * (SELECT sum(size) FROM sizes)::DOUBLE / size AS rate FROM sizes),
steps AS (
  SELECT s, k, sum(exp(k * ln(rate) - rate - f)) OVER (PARTITION BY s ORDER BY k ROWS UNBOUNDED PRECEDING) AS cdf
  FROM (SELECT s, rate, k, sum(CASE WHEN k > 0 THEN ln(k::DOUBLE) ELSE 0e0 END) OVER (PARTITION BY s ORDER BY k ROWS UNBOUNDED PRECEDING) AS f
        FROM (SELECT s, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 20)::BIGINT + 1)) AS k FROM rates))),
drawn AS (
  SELECT *, ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, {HEX}))::BIGINT / {float(1 << 4 * HEX)}::DOUBLE AS u FROM documents)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, steps.k::INTEGER AS replica,
       md5('{SEED}:' || coalesce(d.doc_id::VARCHAR, '') || ':' || steps.k) AS shuffle_key
FROM drawn d JOIN steps ON steps.s = coalesce(d.source, '') AND steps.cdf <= d.u"""


@query("op6_mixing", _ORACLE)
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
