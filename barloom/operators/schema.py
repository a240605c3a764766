"""Field catalog, table schemas, and checks of frames against them."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

ID, DATE = "order_book_id", "date"

TYPES = {
    "float64": T.DoubleType(), "float32": T.FloatType(), "int64": T.LongType(),
    "int32": T.IntegerType(), "string": T.StringType(), "bool": T.BooleanType(),
    "date": T.DateType(), "datetime": T.TimestampType(),
}
# fixed values: Spark types accepted for each declared type
COMPATIBLE = {
    "float64": {"double", "float"}, "float32": {"float", "double"},
    "int64": {"bigint", "int", "smallint", "tinyint"}, "int32": {"int", "smallint", "tinyint"},
    "string": {"string"}, "bool": {"boolean"}, "date": {"date", "string"},
    "datetime": {"timestamp", "timestamp_ntz"},
}


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    nullable: bool
    category: str
    source: str


# fixed values: the catalog (name, type, nullable, category, source), by group
PRICE_FIELDS = [
    Field("open", "float64", False, "price", "vendor"),
    Field("close", "float64", False, "price", "vendor"),
    Field("high", "float64", False, "price", "vendor"),
    Field("low", "float64", False, "price", "vendor"),
    Field("volume", "int64", False, "volume", "vendor"),
    Field("amount", "float64", True, "volume", "vendor"),
]
FUNDAMENTAL_FIELDS = [
    Field("pe_ratio", "float64", True, "valuation", "vendor"),
    Field("pb_ratio", "float64", True, "valuation", "vendor"),
    Field("ps_ratio", "float64", True, "valuation", "vendor"),
    Field("pcf_ratio", "float64", True, "valuation", "vendor"),
    Field("market_cap", "float64", True, "market", "vendor"),
    Field("circulating_market_cap", "float64", True, "market", "vendor"),
    Field("total_shares", "float64", True, "market", "vendor"),
    Field("float_shares", "float64", True, "market", "vendor"),
    Field("turnover_ratio", "float64", True, "liquidity", "vendor"),
    Field("float_turnover_ratio", "float64", True, "liquidity", "vendor"),
    Field("roe", "float64", True, "profitability", "vendor"),
    Field("roa", "float64", True, "profitability", "vendor"),
    Field("gross_profit_margin", "float64", True, "profitability", "vendor"),
    Field("net_profit_margin", "float64", True, "profitability", "vendor"),
    Field("debt_to_equity", "float64", True, "solvency", "vendor"),
    Field("current_ratio", "float64", True, "solvency", "vendor"),
]
INSTRUMENT_FIELDS = [
    Field("order_book_id", "string", False, "instrument", "vendor"),
    Field("symbol", "string", False, "instrument", "vendor"),
    Field("exchange", "string", False, "instrument", "vendor"),
    Field("type", "string", False, "instrument", "vendor"),
    Field("status", "string", True, "instrument", "vendor"),
    Field("listed_date", "string", True, "instrument", "vendor"),
    Field("de_listed_date", "string", True, "instrument", "vendor"),
    Field("sector_code", "string", True, "instrument", "vendor"),
    Field("industry_code", "string", True, "instrument", "vendor"),
    Field("board_type", "string", True, "instrument", "vendor"),
]
# dates are real dates here; the stored text form is still accepted
FACTOR_FIELDS = [
    Field("date", "date", False, "temporal", "calculated"),
    Field("factor_name", "string", False, "factor", "calculated"),
    Field("factor_value", "float64", True, "factor", "calculated"),
    Field("factor_category", "string", True, "factor", "calculated"),
]
TECHNICAL_FIELDS = [
    Field("sma_5", "float64", True, "technical", "calculated"),
    Field("sma_10", "float64", True, "technical", "calculated"),
    Field("sma_20", "float64", True, "technical", "calculated"),
    Field("sma_30", "float64", True, "technical", "calculated"),
    Field("ema_5", "float64", True, "technical", "calculated"),
    Field("ema_10", "float64", True, "technical", "calculated"),
    Field("ema_20", "float64", True, "technical", "calculated"),
    Field("ema_30", "float64", True, "technical", "calculated"),
    Field("rsi_6", "float64", True, "technical", "calculated"),
    Field("rsi_12", "float64", True, "technical", "calculated"),
    Field("rsi_14", "float64", True, "technical", "calculated"),
    Field("macd", "float64", True, "technical", "calculated"),
    Field("macd_signal", "float64", True, "technical", "calculated"),
    Field("macd_hist", "float64", True, "technical", "calculated"),
    Field("bollinger_upper", "float64", True, "technical", "calculated"),
    Field("bollinger_middle", "float64", True, "technical", "calculated"),
    Field("bollinger_lower", "float64", True, "technical", "calculated"),
    Field("stoch_k", "float64", True, "technical", "calculated"),
    Field("stoch_d", "float64", True, "technical", "calculated"),
    Field("atr_14", "float64", True, "technical", "calculated"),
    Field("vwap", "float64", True, "technical", "calculated"),
    Field("returns", "float64", True, "technical", "calculated"),
    Field("volume_ratio", "float64", True, "technical", "calculated"),
    Field("price_change", "float64", True, "price", "calculated"),
    Field("price_change_pct", "float64", True, "price", "calculated"),
    Field("high_low_range", "float64", True, "price", "calculated"),
    Field("avg_price", "float64", True, "price", "calculated"),
]

FIELDS = {f.name: f for f in [*PRICE_FIELDS, *FUNDAMENTAL_FIELDS, *INSTRUMENT_FIELDS, *FACTOR_FIELDS, *TECHNICAL_FIELDS]}

# fixed values: fields per kind of fetch and whether the kind is required
FETCH_GROUPS = {
    "price_data": (["open", "close", "high", "low", "volume", "amount"], True),
    "fundamental_data": (["pe_ratio", "pb_ratio", "market_cap", "turnover_ratio", "roe"], False),
    "technical_data": (["sma_5", "sma_10", "sma_20", "rsi_14", "macd"], False),
}


@dataclass(frozen=True)
class TableSchema:
    name: str
    columns: tuple[str, ...]
    primary_key: tuple[str, ...]
    partition_by: tuple[str, ...] = ()
    types: tuple[tuple[str, str], ...] = ()
    version: str = "1.0"

    def field(self, name: str) -> Field:
        own = dict(self.types)
        if name in own:
            return Field(name, own[name], name not in self.primary_key, "user", "user")
        return FIELDS[name]

    def struct(self) -> T.StructType:
        """Spark schema; category, source and key are column metadata."""
        fields = []
        for n in self.columns:
            f = self.field(n)
            fields.append(T.StructField(n, TYPES[f.type], f.nullable, {
                "category": f.category, "source": f.source, "primary_key": n in self.primary_key,
                "partition": n in self.partition_by}))
        return T.StructType(fields)


TABLES = {
    "instruments": TableSchema(
        "instruments", tuple(f.name for f in INSTRUMENT_FIELDS), (ID,), ("exchange",)),
    "factors": TableSchema(
        "factors", (ID, "symbol", DATE, "factor_name", "factor_value", "factor_category"),
        (ID, DATE, "factor_name"), (DATE,)),
    "valuation": TableSchema(
        "valuation", (ID, DATE, *[f.name for f in FUNDAMENTAL_FIELDS]), (ID, DATE), (DATE,)),
}


def fields_by(category: str | None = None, source: str | None = None) -> list[str]:
    return [f.name for f in FIELDS.values()
            if category in (None, f.category) and source in (None, f.source)]


def required_fields(required: bool = True) -> list[str]:
    return [f for fields, need in FETCH_GROUPS.values() if need == required for f in fields]


def catalog_frame(spark: SparkSession) -> DataFrame:
    """The catalog as a small frame, for lookups in SQL."""
    rows = [(f.name, f.type, f.nullable, f.category, f.source) for f in FIELDS.values()]
    return spark.createDataFrame(
        rows, "name string, type string, nullable boolean, category string, source string")


def lineage(spark: SparkSession) -> DataFrame:
    return catalog_frame(spark).groupBy("source", "category").agg(F.count(F.lit(1)).alias("fields"))


def user_schema(name: str, columns: dict[str, str], primary_key: Sequence[str] = (),
                version: str = "1.0") -> TableSchema:
    return TableSchema(name, tuple(columns), tuple(primary_key), types=tuple(columns.items()), version=version)


def save_user_schema(spark: SparkSession, schema: TableSchema, registry: str) -> None:
    """Append the schema as rows; a later version does not replace an earlier one."""
    rows = [(schema.name, schema.version, i, n, schema.field(n).type, n in schema.primary_key)
            for i, n in enumerate(schema.columns)]
    spark.createDataFrame(
        rows, "schema string, version string, position int, column string, type string, key boolean"
    ).coalesce(1).write.mode("append").parquet(registry)


def list_user_schemas(spark: SparkSession, registry: str) -> DataFrame:
    return spark.read.parquet(registry).groupBy("schema", "version").agg(
        F.count(F.lit(1)).alias("columns"))


def load_user_schema(spark: SparkSession, name: str, registry: str, version: str | None = None) -> TableSchema:
    df = spark.read.parquet(registry).where(F.col("schema") == name)
    if version is not None:
        df = df.where(F.col("version") == version)
    rows = df.orderBy("version", "position").collect()  # one row per column of one schema
    if not rows:
        raise ValueError(f"no schema {name!r} in {registry}")
    last = rows[-1]["version"]
    rows = [r for r in rows if r["version"] == last]
    return user_schema(name, {r["column"]: r["type"] for r in rows},
                       [r["column"] for r in rows if r["key"]], last)


def find_schema(name: str, extra: dict[str, TableSchema] | None = None) -> TableSchema:
    known = {**TABLES, **(extra or {})}
    if name not in known:
        raise ValueError(f"no schema named {name!r}")
    return known[name]


def schema_problems(df: DataFrame, schema: TableSchema) -> list[tuple[str, str, str]]:
    """(kind, column, detail) for missing, extra and type-incompatible columns."""
    have = dict(df.dtypes)
    out = [("missing", c, schema.field(c).type) for c in schema.columns if c not in have]
    out += [("extra", c, t) for c, t in have.items() if c not in schema.columns]
    out += [("type", c, f"{have[c]} for {schema.field(c).type}") for c in schema.columns
            if c in have and have[c] not in COMPATIBLE[schema.field(c).type]]
    return out


def check_schema(df: DataFrame, schema: TableSchema) -> DataFrame:
    """The problems as rows, with the number of values the frame holds in that column."""
    problems = schema_problems(df, schema)
    if not problems:
        return df.sparkSession.createDataFrame([], "kind string, column string, detail string, values bigint")
    counts = df.agg(*[
        F.struct(F.lit(kind).alias("kind"), F.lit(c).alias("column"), F.lit(detail).alias("detail"),
                 (F.count(c) if c in df.columns else F.lit(0).cast("bigint")).alias("values")).alias(f"p{i}")
        for i, (kind, c, detail) in enumerate(problems)])
    return counts.select(F.inline(F.array(*[F.col(f"p{i}") for i in range(len(problems))])))


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def gate(df: DataFrame, check_rows: bool = True) -> DataFrame:
    """Refuse a frame without symbol, date and numeric close, or without rows. Looking for a row runs the frame's
    plan up to the first one, so give it a frame that is stored or `materialised`."""
    require_columns(df, [ID, DATE, "close"])
    if not isinstance(df.schema["close"].dataType, T.NumericType):
        raise ValueError("close is not numeric")
    if check_rows and df.isEmpty():
        raise ValueError("the frame has no rows")
    return df


def field_validity(df: DataFrame, schema: TableSchema) -> DataFrame:
    """Per declared column that the frame has: rows, disallowed nulls, values that do not cast."""
    cols = [c for c in schema.columns if c in df.columns]
    aggs = []
    for c in cols:
        f = schema.field(c)
        cast = F.col(c).try_cast(TYPES[f.type])
        bad_null = F.col(c).isNull() if not f.nullable else F.lit(False)
        aggs.append(F.struct(
            F.lit(c).alias("column"), F.count(F.lit(1)).alias("rows"),
            F.count(F.when(bad_null, 1)).alias("bad_nulls"),
            F.count(F.when(F.col(c).isNotNull() & cast.isNull(), 1)).alias("bad_types")).alias(c))
    return df.agg(*aggs).select(F.inline(F.array(*[F.col(f"`{c}`") for c in cols])))


def key_violations(df: DataFrame, schema: TableSchema) -> DataFrame:
    """Primary keys that occur more than once, with their number of rows."""
    return df.groupBy(*schema.primary_key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def coerce(df: DataFrame, schema: TableSchema) -> DataFrame:
    """Declared types; values that do not fit become null."""
    return df.withColumns({c: F.col(c).try_cast(TYPES[schema.field(c).type])
                           for c in schema.columns if c in df.columns})


def compliance(df: DataFrame, schema: TableSchema, max_null: float = 0.5) -> DataFrame:
    """Per declared column: present, type fits, null share, accepted; and the share of accepted
    columns of the whole schema on every row."""
    have = dict(df.dtypes)
    present = [c for c in schema.columns if c in have]
    one = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in present])
    rows = []
    for c in schema.columns:
        fits = c in have and have[c] in COMPATIBLE[schema.field(c).type]
        share = (F.try_divide(F.col(c), F.col("_n")) if c in have else F.lit(None)).cast("double")
        rows.append(F.struct(
            F.lit(c).alias("column"), F.lit(c in have).alias("present"), F.lit(fits).alias("type_fits"),
            share.alias("null_share"),
            (F.lit(fits) & F.coalesce(share <= max_null, F.lit(False))).alias("accepted")))
    long = one.select(F.array(*rows).alias("r"))
    score = F.size(F.filter("r", lambda x: x["accepted"])) / F.lit(float(len(schema.columns)))
    return long.withColumn("score", score).select("score", F.inline("r"))
