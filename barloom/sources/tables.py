"""Reading and writing: files by suffix, named tables in zones, snapshots, retention, SQL.

A zone is a folder per kind of data (raw, processed, metadata) under one base path that every
executor can reach.
"""
from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce
from pathlib import PurePosixPath

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from barloom.functions import files
from barloom.operators.clean import date_range, dedup, drop_null_rows, to_doubles

FORMATS = {".parquet": "parquet", ".csv": "csv", ".json": "json"}
ZONES = ("raw", "processed", "metadata")
ID, DATE = "order_book_id", "date"


# ---------------------------------------------------------------- files


def format_of(path: str) -> str:
    suffix = PurePosixPath(path.rstrip("/")).suffix
    if suffix not in FORMATS:
        raise ValueError(f"no reader for {path!r}")
    return FORMATS[suffix]


def load(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Read parquet, csv or json by suffix. Give a schema for text formats at scale: without one
    Spark reads the text twice."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    fmt = format_of(path)
    if fmt == "csv":
        reader = reader.option("header", True)
        if schema is None:
            reader = reader.option("inferSchema", True)
    return reader.format(fmt).load(path)


def save(df: DataFrame, path: str, mode: str = "overwrite", **options) -> None:
    fmt = format_of(path)
    if fmt == "csv":
        options.setdefault("header", True)
    df.write.format(fmt).mode(mode).options(**options).save(path)


def save_parts(parts: Sequence[DataFrame], path: str, **options) -> None:
    """Frames of one schema, saved one after the other as one. The marker of a finished file comes with the last, and
    if one fails the others go."""
    for k, df in enumerate(parts):
        marker = {} if k == len(parts) - 1 else {"mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}
        try:
            save(df, path, "append" if k else "overwrite", **options, **marker)
        except BaseException:
            if k:
                files.delete(df.sparkSession, path)
            raise


def load_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A list of records, one object, or one object of parallel lists -> rows. Such a file is read by one
    task, which suits small landed files; with `lines` a file has a record a line and is split."""
    df = spark.read.option("multiLine", not lines).json(path)
    if df.columns and all(isinstance(f.dataType, T.ArrayType) for f in df.schema.fields):
        zipped = F.arrays_zip(*[F.col(f"`{c}`") for c in df.columns])
        return df.select(F.inline(zipped))
    return df


def json_to_table(spark: SparkSession, path: str, base: str, table: str, lines: bool = False) -> None:
    save_table(load_json(spark, path, lines), base, table)


# ---------------------------------------------------------------- named tables


def table_path(base: str, table: str, zone: str = "processed") -> str:
    """The one place that maps a table to its folder, for writing and for reading."""
    if zone not in ZONES:
        raise ValueError(f"unknown zone {zone!r}")
    return f"{base.rstrip('/')}/{zone}/{table}"


def save_table(df: DataFrame, base: str, table: str, zone: str = "processed",
               partition_by: Sequence[str] = (), mode: str = "overwrite", **options) -> None:
    """Parquet with snappy. Partition columns gather each partition's rows first so that a task does
    not open a file in every partition; a hot partition is split over tasks by the planner."""
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.mode(mode).option("compression", "snappy").options(**options)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(table_path(base, table, zone))


def load_table(spark: SparkSession, base: str, table: str, zone: str = "processed") -> DataFrame:
    return spark.read.parquet(table_path(base, table, zone))


def list_tables(spark: SparkSession, base: str, zone: str = "processed") -> list[str]:
    """Names of the tables in a zone, through the file system of the base path."""
    return sorted(files.folders(spark, f"{base.rstrip('/')}/{zone}"))


def table_info(spark: SparkSession, base: str, table: str, zone: str = "processed") -> DataFrame:
    """One row: rows, columns, types, files, bytes."""
    df = load_table(spark, base, table, zone)
    per_file = df.groupBy(F.col("_metadata.file_path").alias("f")).agg(
        F.count(F.lit(1)).alias("n"), F.max("_metadata.file_size").alias("b"))
    return per_file.agg(
        F.lit(table).alias("table"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.lit(len(df.columns)).alias("columns"),
        F.lit(",".join(f"{c}:{t}" for c, t in df.dtypes)).alias("types"),
        F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("b"), F.lit(0)).alias("bytes"))


def record_metadata(spark: SparkSession, base: str, table: str, zone: str = "processed",
                    partition_by: Sequence[str] = ()) -> None:
    """Append the table's current facts to the metadata zone."""
    info = table_info(spark, base, table, zone).withColumns({
        "partition_by": F.lit(",".join(partition_by)), "recorded_at": F.current_timestamp()})
    info.coalesce(1).write.mode("append").parquet(table_path(base, "table_metadata", "metadata"))


def latest_metadata(spark: SparkSession, base: str) -> DataFrame:
    df = load_table(spark, base, "table_metadata", "metadata")
    rest = [c for c in df.columns if c != "table"]
    return df.groupBy("table").agg(F.max_by(F.struct(*rest), F.col("recorded_at")).alias("r")).select("table", "r.*")


def compact(spark: SparkSession, base: str, table: str, zone: str = "processed",
            partition_by: Sequence[str] = ()) -> str:
    """Rewrite a table with zstd into a new sibling folder `<table>_compacted` and give its path.

    Spark cannot overwrite the files it reads; the caller points readers at the new folder or swaps
    the two once no job reads the old one.
    """
    df = load_table(spark, base, table, zone)
    target = f"{table}_compacted"
    save_table(df.hint("rebalance", *partition_by), base, target, zone, partition_by, compression="zstd")
    return table_path(base, target, zone)


def retained(df: DataFrame, days: int = 90, as_of: str | None = None) -> DataFrame:
    """Rows not older than `days` before `as_of` (today when not given)."""
    end = F.lit(as_of).cast("date") if as_of else F.current_date()
    return df.where(F.col(DATE) >= F.date_sub(end, days))


def drop_expired(spark: SparkSession, base: str, table: str, days: int = 90, as_of: str | None = None,
                 zone: str = "processed", whole: bool = False) -> list[str]:
    """Delete the day partitions of a stored table that are older than `days` before `as_of` (today when
    not given), and give their names. No file is read or written again. A table without day partitions is
    refused unless `whole` is set; its one age is then that of its newest file, and if that is older, the whole table goes
    and its name is given. Rows of month tables are cut by `store.drop_before`."""
    end = F.lit(as_of).cast("date") if as_of else F.current_date()
    edge = spark.range(1).select(F.date_sub(end, days).alias("d")).select("d", F.unix_timestamp(F.col("d").cast("timestamp")).alias("s")).first()
    path, cut = table_path(base, table, zone), f"{DATE}={edge['d']}"
    held = files.folders(spark, path)
    dated = sorted(f for f in held if re.fullmatch(rf"{DATE}=\d{{4}}-\d\d-\d\d", f))
    if dated:
        gone = {f: held[f] for f in dated if f < cut}
    elif not whole:
        raise ValueError(f"{table} is not partitioned by {DATE}")
    else:
        changed = files.newest_change(spark, path)
        gone = {table: path} if changed is not None and changed < edge["s"] else {}
    for place in gone.values():
        files.delete(spark, place)
    spark.catalog.refreshByPath(path)
    return sorted(gone)


def save_bucketed(df: DataFrame, name: str, path: str, buckets: int, by: Sequence[str] = (ID,),
                  sort: Sequence[str] = (ID, DATE)) -> None:
    """A catalogue table at `path` in buckets by symbol, one sorted file each. Windows by symbol and joins of two
    such tables with equally many buckets need no exchange (joins by symbol and day, if the session sets
    spark.sql.requireAllClusterKeysForCoPartition to false). A symbol's bars are bounded by the calendar, so a bucket
    holds about its share of the symbols."""
    (df.repartition(buckets, *by).write.bucketBy(buckets, *by).sortBy(*sort).mode("overwrite").option("path", path)
     .option("compression", "snappy").saveAsTable(name))


LISTED = 32  # a longer symbol list is joined instead of written into the filter


def of_symbols(df: DataFrame, symbols: Sequence[str] | None) -> DataFrame:
    """Rows of some symbols. A short list reaches the scan as a filter; a longer one is a broadcast semi-join, since
    a filter of thousands of literals is planned and sent with every task. The list comes from the driver, which
    bounds it."""
    if not symbols:
        return df
    wanted = sorted(set(symbols))
    if len(wanted) <= LISTED:
        return df.where(F.col(ID).isin(wanted))
    listed = df.sparkSession.createDataFrame([(s,) for s in wanted], f"{ID} string")
    return df.where(F.col(ID).between(wanted[0], wanted[-1])).join(F.broadcast(listed), ID, "left_semi")


def load_market_data(spark: SparkSession, base: str, symbols: Sequence[str] | None = None,
                     start: str | None = None, end: str | None = None, table: str = "bars") -> DataFrame:
    """Bars of some symbols in a date range; the filters reach the scan."""
    return date_range(of_symbols(load_table(spark, base, table), symbols), start, end)


def route(spark: SparkSession, source: str | Sequence[str] | dict, base: str | None = None) -> DataFrame:
    """A path, a list of symbols, or {path | symbols, start, end, data_types}: one frame. Several
    data types are joined on symbol and day."""
    if isinstance(source, str):
        return load(spark, source)
    if not isinstance(source, dict):
        source = {"symbols": list(source)}
    if source.get("path"):
        return date_range(load(spark, source["path"]), source.get("start"), source.get("end"))
    if base is None:
        raise ValueError("a base path is needed to load by symbol")
    from barloom.operators.joins import outer_on_common

    kinds = source.get("data_types") or ["bars"]
    frames = [load_market_data(spark, base, source.get("symbols"), source.get("start"),
                               source.get("end"), k) for k in kinds]
    out = frames[0]
    for f in frames[1:]:
        out = outer_on_common(out, f, [ID, DATE])
    return out


def clean_files(spark: SparkSession, paths: Sequence[str], out: str, doubles: Sequence[str] = (),
                steps: Sequence[Callable[[DataFrame], DataFrame]] = ()) -> None:
    """Clean many parquet inputs in one job, each for itself; the output keeps the input's last path part
    as a partition."""
    names = [p.rstrip("/").rsplit("/", 1)[-1] for p in paths]
    if len(set(names)) < len(names):
        raise ValueError("inputs need different names")
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [
        spark.read.parquet(p).withColumn("source_file", F.lit(n)) for p, n in zip(paths, names)])
    df = to_doubles(df, doubles) if doubles else df
    order = [c for c in df.columns if c not in (ID, DATE, "source_file")]
    df = dedup(drop_null_rows(df.where(F.col(DATE).isNotNull())), order, "first", (ID, DATE, "source_file"))
    for step in steps:
        df = step(df)
    df.hint("rebalance", "source_file").write.mode("overwrite").partitionBy("source_file").parquet(out)


# ---------------------------------------------------------------- snapshots


def write_snapshot(df: DataFrame, base: str, table: str, stamp: str) -> None:
    """Add a snapshot; `stamp` is text like 20240131_093000 and sorts by time. Running the same
    snapshot again replaces only that snapshot."""
    (df.withColumn("snapshot_ts", F.lit(stamp)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_ts")
     .parquet(table_path(base, table)))


def snapshot(spark: SparkSession, base: str, table: str, stamp: str) -> DataFrame:
    """Rows of one snapshot; the stamp is a filter on the partition."""
    return load_table(spark, base, table).where(F.col("snapshot_ts") == stamp).drop("snapshot_ts")


def latest_snapshot(spark: SparkSession, base: str, table: str) -> DataFrame:
    """Rows of the newest snapshot. Stamps are folder names, so only the newest snapshot's files are opened."""
    path = table_path(base, table)
    stamps = [f.removeprefix("snapshot_ts=") for f in files.folders(spark, path) if f.startswith("snapshot_ts=")]
    if not stamps:
        raise FileNotFoundError(f"no snapshot of {table}")
    newest = max(stamps)
    return spark.read.parquet(f"{path}/snapshot_ts={newest}").withColumn("snapshot_ts", F.lit(newest))


def latest_file(spark: SparkSession, pattern: str) -> DataFrame:
    """Rows of the newest among files whose names carry _YYYYmmdd_HHMMSS."""
    # only names are listed here: the content column is pruned, so no file is opened
    names = spark.read.format("binaryFile").load(pattern).select(
        F.regexp_extract("path", r"^(.*_\d{8}_\d{6}[^/]*)", 1).alias("path"),
        F.regexp_extract("path", r"_(\d{8}_\d{6})[^/]*(?:/[^/]*)?$", 1).alias("stamp")).where("stamp != ''")
    newest = names.agg(F.max("stamp")).first()[0]
    if newest is None:
        raise FileNotFoundError(f"no stamped file matches {pattern}")
    paths = names.where(F.col("stamp") == newest).select("path").distinct().collect()  # of one stamp
    return spark.read.parquet(*[r["path"] for r in paths])


def profile_files(spark: SparkSession, pattern: str, symbol: str) -> DataFrame:
    """Per file: rows, rows with an id, bytes, whether the symbol occurs."""
    df = spark.read.parquet(pattern)
    return df.groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.count(F.lit(1)).alias("rows"), F.count(ID).alias("with_id"),
        F.max("_metadata.file_size").alias("bytes"),
        F.coalesce(F.bool_or(F.col(ID) == symbol), F.lit(False)).alias("has_symbol"))


# ---------------------------------------------------------------- SQL


def register(spark: SparkSession, name: str, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    df.createOrReplaceTempView(name)
    return df


def run_sql(spark: SparkSession, text: str, params: dict | Sequence | None = None) -> DataFrame:
    """SQL with named (:name) or positional (?) parameters."""
    if params is None:
        return spark.sql(text)
    return spark.sql(text, args=params if isinstance(params, dict) else list(params))


def create_view(spark: SparkSession, name: str, text: str) -> None:
    spark.sql(text).createOrReplaceTempView(name)


def column_types(spark: SparkSession, name: str) -> dict[str, str]:
    return dict(spark.table(name).dtypes)


def describe_table(spark: SparkSession, name: str) -> DataFrame:
    df = spark.table(name)
    return df.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows"),
                  F.lit(len(df.columns)).alias("columns"), F.lit(",".join(df.columns)).alias("names"))


def batch_sql(spark: SparkSession, queries: Sequence[tuple[str, dict | None]]) -> list[DataFrame]:
    """One frame per query; a query that cannot be analysed gives an empty frame."""
    out = []
    for text, params in queries:
        try:
            out.append(run_sql(spark, text, params))
        except AnalysisException:
            out.append(spark.createDataFrame([], T.StructType([])))
    return out


def query_file(spark: SparkSession, path: str, columns: Sequence[str] | None = None,
               condition: str | None = None) -> DataFrame:
    """Columns and a predicate over a parquet file; both reach the scan."""
    df = spark.read.parquet(path)
    if condition:
        df = df.where(F.expr(condition))
    return df.select(*columns) if columns else df
