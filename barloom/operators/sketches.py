"""Profiles of files as sketches that are stored per file and united on read.

A file is read once; what is kept of a column is a row with its counts, extremes, a distinct-count sketch and a
quantile sketch. All of them merge, so the profile of any set of files comes from those rows. The relative error
of a distinct count is about 1.6 % (one standard deviation), the rank of a quantile is off by at most about 1.7 %
of the rows; small files are exact.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from barloom.functions import files

SKETCH = ("file string, modified timestamp, column string, rows long, nulls long, low double, high double, "
          "distinct binary, quantiles binary")
DISTINCT_ERROR, RANK_ERROR = 0.016, 0.017
LOG_BUCKETS = 12


def _column_sketch(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    number = F.col(name).cast("double") if isinstance(kind, T.NumericType) else F.lit(None).cast("double")
    text = F.col(name).cast("string")
    return F.struct(
        F.lit(name).alias("column"), F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col(name).isNull(), 1)).alias("nulls"),
        F.min(number).alias("low"), F.max(number).alias("high"), F.hll_sketch_agg(text, F.lit(LOG_BUCKETS)).alias("distinct"),
        F.kll_sketch_agg_double(number).alias("quantiles"))


def file_sketches(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row a file and column of a frame read from files."""
    source = df.select(*columns, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_modification_time").alias("_modified"))
    one = source.groupBy("_file", "_modified").agg(*[_column_sketch(source, c).alias(f"s{i}") for i, c in enumerate(columns)])
    return one.select(F.col("_file").alias("file"), F.col("_modified").alias("modified"),
                      F.inline(F.array(*[F.col(f"s{i}") for i in range(len(columns))])))


def stored(spark: SparkSession, path: str) -> DataFrame:
    if not files.exists(spark, path):
        return spark.createDataFrame([], SKETCH)
    return spark.read.schema(SKETCH).parquet(path)


def sketch_new_files(spark: SparkSession, pattern: str, path: str, columns: Sequence[str]) -> list[str]:
    """Sketch the parquet files that match the pattern and are not in the table at `path` with their present
    time, append them, and give their names. Other files are listed, not opened."""
    listed = spark.read.format("binaryFile").load(pattern).select(  # the content column is pruned
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified"))
    known = stored(spark, path).select("file", "modified").distinct()
    new = sorted(r["file"] for r in listed.join(known, ["file", "modified"], "left_anti").collect())  # what a reader lists anyway
    if new:
        file_sketches(spark.read.parquet(*new), columns).write.mode("append").parquet(path)
    return new


def united(spark: SparkSession, path: str, probs: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Per column: files, rows, nulls, extremes, distinct values and quantiles of all files together, each by its
    newest sketch."""
    rest = [c.split()[0] for c in SKETCH.split(", ")][3:]
    newest = stored(spark, path).groupBy("file", "column").agg(F.max_by(F.struct(*rest), "modified").alias("s"))
    one = newest.select("column", "s.*").groupBy("column").agg(
        F.count(F.lit(1)).alias("files"), F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), F.min("low").alias("low"),
        F.max("high").alias("high"), F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("distinct"),
        F.kll_merge_agg_double("quantiles").alias("_q"))
    has = F.col("low").isNotNull()
    return one.select(*[c for c in one.columns if c != "_q"], *[
        F.when(has, F.kll_sketch_get_quantile_double(F.when(has, F.col("_q")), F.lit(float(p)))).alias(f"p{round(100 * p)}") for p in probs])
