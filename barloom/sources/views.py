"""Panels derived from the driver's tables, in Spark and as SQL text.

Prices are made from whole numbers (percent points of discount and tax), so
both engines arrive at the same doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rnd(c: Column, k: int) -> Column:
    """Half up on the double itself; what lies a hair below a half (as sums in another order do) goes up too."""
    return F.floor(c * F.lit(10.0**k) + 0.50001) / F.lit(10.0**k)


def _percent(name: str) -> Column:
    return F.floor(F.col(name) * 100 + 0.5)


def _walk(daily: DataFrame, key: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy("date")
    close = daily.withColumn("close", rnd(100 * F.exp(F.sum("r6").over(w) / 1e6), 4))
    opened = close.withColumn("open", F.coalesce(F.lag("close").over(w), F.lit(100.0)))
    return opened.select(
        "date",
        key,
        "open",
        rnd(F.greatest("open", "close") * (1 + F.col("tax") / 1000), 4).alias("high"),
        rnd(F.least("open", "close") * (1 - F.col("tax") / 1000), 4).alias("low"),
        "close",
        "volume",
    )


def _daily(rows: DataFrame, *keys) -> DataFrame:
    return rows.groupBy(*keys).agg(
        (F.floor(F.sum(_percent("l_discount")) * 1e4 / F.count("*") + 0.5) - 50_000).alias("r6"),
        (F.sum(_percent("l_tax")) / F.count("*")).alias("tax"),
        (F.sum("l_quantity") * 2000).alias("volume"),
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per supplier and ship day."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("ticker"), F.to_date("l_shipdate").alias("date"), "l_discount", "l_tax", "l_quantity"
    )
    # days and walk are both made where a ticker's rows lie: they are dealt out once
    return _walk(_daily(rows.repartition("ticker"), "ticker", "date"), "ticker")


def index_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same walk over all rows of a day; its key is the benchmark's name."""
    rows = table(spark, sf_dir, "lineitem").select(F.lit(".ALL").alias("ticker"), F.to_date("l_shipdate").alias("date"), "l_discount", "l_tax", "l_quantity")
    return _walk(_daily(rows, "ticker", "date"), "ticker")


def sector_index_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The walk by nation and day."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    rows = rows.select(F.concat(F.lit(".N"), F.col("s_nationkey").cast("string")).alias("ticker"), F.to_date("l_shipdate").alias("date"), "l_discount", "l_tax", "l_quantity")
    return _walk(_daily(rows, "ticker", "date"), "ticker")


def sector_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("ticker"), F.col("n_name").alias("sector"))


def _sql_walk(name: str, ticker: str, source: str) -> str:
    return f"""
{name}_d AS (SELECT {ticker} AS ticker, CAST(l_shipdate AS date) AS date,
    CAST(floor(sum(floor(l_discount * 100 + 0.5)) * 1e4 / count(*) + 0.5) - 50000 AS bigint) AS r6,
    sum(floor(l_tax * 100 + 0.5)) / count(*) AS tax, sum(l_quantity) * 2000 AS volume FROM {source} GROUP BY 1, 2),
{name}_c AS (SELECT *, floor(100 * exp(sum(r6) OVER (PARTITION BY ticker ORDER BY date) / 1e6) * 10000.0 + 0.50001) / 10000.0 AS close FROM {name}_d),
{name}_o AS (SELECT *, coalesce(lag(close) OVER (PARTITION BY ticker ORDER BY date), 100.0) AS open FROM {name}_c),
{name} AS (SELECT date, ticker, open, floor(greatest(open, close) * (1 + tax / 1000) * 10000.0 + 0.50001) / 10000.0 AS high,
    floor(least(open, close) * (1 - tax / 1000) * 10000.0 + 0.50001) / 10000.0 AS low, close, volume FROM {name}_o)"""


BARS = _sql_walk("bars", "'S' || l_suppkey", "lineitem")
INDEX_BARS = _sql_walk("index_bars", "'.ALL'", "lineitem")
SECTOR_INDEX_BARS = _sql_walk("sector_index_bars", "'.N' || s_nationkey", "lineitem JOIN supplier ON l_suppkey = s_suppkey")
SECTOR_MAP = "sector_map AS (SELECT 'S' || s_suppkey AS ticker, n_name AS sector FROM supplier JOIN nation ON s_nationkey = n_nationkey)"


def sql_rnd(e: str, k: int) -> str:
    return f"floor(({e}) * {10.0**k} + 0.50001) / {10.0**k}"
