"""The given tables seen as market data.

Trades: a line item is a trade of the supplier's symbol on its ship day, at the unit price rounded
to the tick. Events: an event is a trade of the user's symbol at its value. Symbols are a padded
code with a market suffix, as the universe rules expect.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barloom.functions.numeric import to_tick
from barloom.plans.registry import cte
from barloom.sources.bars import daily_bars, large_order_ratio, with_large_sizes
from barloom.sources.calendar import market_days, weekdays_of

# fixed values: industry names of the demo instruments; the last one is outside the scorer's list
INDUSTRIES = ["科技", "新能源", "医药", "消费", "金融", "资源", "其他", "综合"]
MARKETS = ["XSHE", "XSHG", "XHKG"]
FACTOR_NAMES = ["click", "error", "purchase", "signup", "view"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def symbol_code(key: Column) -> Column:
    text = key.cast("string")
    padded = F.lpad(text, F.greatest(F.lit(6), F.length(text)), F.lit("0"))
    market = F.element_at(F.array(*[F.lit(m) for m in MARKETS]),
                          (F.pmod(key, F.lit(len(MARKETS))) + 1).cast("int"))
    return F.concat(padded, F.lit("."), market)


def trade_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("order_book_id"),
        F.col("l_shipdate").cast("date").alias("date"),
        to_tick(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("size"),
        F.col("l_extendedprice").alias("amount"),
        "l_orderkey", "l_linenumber", "l_partkey",
    )


def _keyed_bars(ticks: DataFrame, large_from: str | None = None) -> DataFrame:
    """Bars of the line items by the numeric key."""
    # line numbers are one digit below 8, so order key and line number make one whole number
    number = F.col("l_orderkey") * F.lit(8) + F.col("l_linenumber")
    return daily_bars(ticks, "order_book_id", "date", "price", "size", "amount", sequence=number, large_from=large_from)


def trade_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of the line items: grouped by the numeric key, the text code is added afterwards."""
    bars = _keyed_bars(trade_ticks(spark, sf_dir))
    return bars.withColumn("order_book_id", symbol_code(F.col("order_book_id")))


def sized_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with the order-size share, which the pass over the trades that makes the bars counts too."""
    bars = _keyed_bars(with_large_sizes(trade_ticks(spark, sf_dir)), "large_from")
    return bars.withColumn("order_book_id", symbol_code(F.col("order_book_id")))


def trade_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days with a trade, numbered: the same days the bars have, without building the bars."""
    return market_days(trade_ticks(spark, sf_dir).select("date"))


def event_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekday calendar over the span of the events."""
    return weekdays_of(table(spark, sf_dir, "events").select(F.col("ts").cast("date").alias("date")))


def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select(
        "user_id", "ts", "event_id", "value", F.lit(1.0).alias("one"))
    bars = daily_bars(ev, "user_id", "ts", "value", "one", "value", ["ts", "event_id"])
    return bars.withColumn("order_book_id", symbol_code(F.col("order_book_id")))


def instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    key = F.col("s_suppkey")
    prefix = (F.when(F.pmod(key, F.lit(17)) == 3, "ST").when(F.pmod(key, F.lit(17)) == 7, "*ST")
              .when(F.pmod(key, F.lit(17)) == 11, "PT").otherwise(""))
    # nation and region are fixed small dimensions; the planner broadcasts them by their size
    return (
        s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
        .select(
            symbol_code(key).alias("order_book_id"),
            F.concat(prefix, F.col("s_name")).alias("symbol"),
            F.col("r_name").alias("exchange"),
            F.lit("CS").alias("type"),
            F.when(F.col("s_acctbal") < 0, "Suspended").otherwise("Active").alias("status"),
            F.element_at(F.array(*[F.lit(i) for i in INDUSTRIES]),
                         (F.pmod(F.col("n_nationkey"), F.lit(len(INDUSTRIES))) + 1).cast("int"))
            .alias("industry"),
            (F.col("s_acctbal") * F.lit(1e7)).alias("market_cap"),
        )
    )


def tick_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trade_ticks(spark, sf_dir).select("order_book_id", "date", "size", "amount")


def order_size_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = large_order_ratio(tick_sizes(spark, sf_dir))
    return share.withColumn("order_book_id", symbol_code(F.col("order_book_id")))


def factors_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long factor table: events per user, day and type."""
    return (
        table(spark, sf_dir, "events")
        .groupBy("user_id", F.col("ts").cast("date").alias("date"),
                 F.col("event_type").alias("factor_name"))
        .agg(F.count(F.lit(1)).cast("double").alias("factor_value"))
        .select(symbol_code(F.col("user_id")).alias("order_book_id"), "date", "factor_name",
                "factor_value", F.lit("activity").alias("factor_category"))
    )


# ---------------------------------------------------------------- the same in SQL


def code_sql(key: str) -> str:
    return (f"(lpad(CAST({key} AS VARCHAR), CAST(greatest(6, length(CAST({key} AS VARCHAR))) AS INTEGER), '0')"
            f" || CASE {key} % 3 WHEN 0 THEN '.XSHE' WHEN 1 THEN '.XSHG' ELSE '.XHKG' END)")


cte("ticks", f"""
SELECT {code_sql('l_suppkey')} AS order_book_id, CAST(l_shipdate AS DATE) AS date,
       floor(l_extendedprice / l_quantity * 100 + 0.5) / 100 AS price,
       l_quantity AS size, l_extendedprice AS amount,
       row_number() OVER (PARTITION BY l_suppkey, CAST(l_shipdate AS DATE)
         ORDER BY l_orderkey, l_linenumber, floor(l_extendedprice / l_quantity * 100 + 0.5)) AS rn,
       count(*) OVER (PARTITION BY l_suppkey, CAST(l_shipdate AS DATE)) AS cnt
FROM lineitem""")
cte("bars", """
SELECT order_book_id, date,
       max(CASE WHEN rn = 1 THEN price END) AS open, max(price) AS high, min(price) AS low,
       max(CASE WHEN rn = cnt THEN price END) AS close,
       sum(size) AS volume, floor(sum(amount) * 100 + 0.5) / 100 AS amount,
       CAST(count(*) AS BIGINT) AS trades
FROM ticks GROUP BY order_book_id, date""", "ticks")
cte("ebars", f"""
SELECT {code_sql('user_id')} AS order_book_id, CAST(ts AS DATE) AS date,
       arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
       arg_max(value, (ts, event_id)) AS close,
       CAST(count(*) AS DOUBLE) AS volume, floor(sum(value) * 100 + 0.5) / 100 AS amount,
       CAST(count(*) AS BIGINT) AS trades
FROM events GROUP BY user_id, CAST(ts AS DATE)""")
cte("instruments", f"""
SELECT {code_sql('s_suppkey')} AS order_book_id,
       CASE s_suppkey % 17 WHEN 3 THEN 'ST' WHEN 7 THEN '*ST' WHEN 11 THEN 'PT' ELSE '' END || s_name AS symbol,
       r_name AS exchange, 'CS' AS type,
       CASE WHEN s_acctbal < 0 THEN 'Suspended' ELSE 'Active' END AS status,
       CASE n_nationkey % 8 WHEN 0 THEN '科技' WHEN 1 THEN '新能源' WHEN 2 THEN '医药' WHEN 3 THEN '消费'
         WHEN 4 THEN '金融' WHEN 5 THEN '资源' WHEN 6 THEN '其他' ELSE '综合' END AS industry,
       s_acctbal * CAST(1e7 AS DOUBLE) AS market_cap
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
cte("factors", f"""
SELECT {code_sql('user_id')} AS order_book_id, CAST(ts AS DATE) AS date, event_type AS factor_name,
       CAST(count(*) AS DOUBLE) AS factor_value, 'activity' AS factor_category
FROM events GROUP BY user_id, CAST(ts AS DATE), event_type""")
