"""A8 to A10 on a stored bars table: partitioned by month, bucketed by ticker.

A bucket holds a ticker's bars of a month in order, so a look-up of a ticker
reads one bucket, a look back reads the months it spans, and whatever groups or
joins by ticker needs no shuffle. An upsert rewrites the months that it touches.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.indicators import history_trim
from ..shared import shared_dir
from .ingest import upsert

COLUMNS = ("ticker", "date", "open", "high", "low", "close", "volume")
BUCKETS = 64


def month_of(date: str | Column = "date") -> Column:
    return F.date_format(date, "yyyy-MM")


def _dealt(bars: DataFrame, buckets: int, width: int) -> DataFrame:
    """A month's bucket in one task, and so in one file: the expression is the one that Spark deals buckets by."""
    return bars.repartition(width, "month", F.pmod(F.hash("ticker"), F.lit(buckets)))


def _width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def create_bars(bars: DataFrame, name: str, buckets: int = BUCKETS, path: str | None = None) -> DataFrame:
    """Write ``bars`` as the table ``name``; columns other than a bar's go along."""
    rows = _dealt(bars.withColumn("month", month_of()), buckets, _width(bars.sparkSession))
    out = rows.write.partitionBy("month").bucketBy(buckets, "ticker").sortBy("ticker", "date")
    (out.option("path", path) if path else out).saveAsTable(name)
    return bars.sparkSession.table(name)


def stored(df: DataFrame, label: str, buckets: int | None = None) -> DataFrame:
    """Any rows by ticker, written once to the shared folder and read back in buckets: what follows by ticker shuffles none of them.

    The table's name goes at once, as the returned rows know their files.
    """
    spark = df.sparkSession
    buckets = buckets or _width(spark)
    name = f"barloom_{label}_{uuid.uuid4().hex}"
    df.repartition(buckets, "ticker").write.bucketBy(buckets, "ticker").sortBy("ticker").option("path", shared_dir(spark, label)).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return out


def latest_date(spark: SparkSession, name: str):
    """The table's last date, from the files of its last month."""
    months = [r[0].split("=")[1] for r in spark.sql(f"SHOW PARTITIONS {name}").collect()]  # names of months
    return spark.table(name).where(F.col("month") == max(months)).agg(F.max("date")).head()[0] if months else None


def stored_ticker(spark: SparkSession, name: str, ticker: str) -> DataFrame:
    """One ticker's trimmed bars, from its bucket."""
    return history_trim(spark.table(name).where(F.col("ticker") == ticker).drop("month"))


def stored_lookback(spark: SparkSession, name: str, days: int) -> DataFrame:
    """The bars of the last ``days`` days before the latest date, from the months these lie in."""
    last = latest_date(spark, name)
    if last is None:
        return spark.table(name).drop("month")
    first = F.date_sub(F.lit(last), days)
    from_month = spark.range(1).select(month_of(first)).head()[0]
    return spark.table(name).where((F.col("month") >= from_month) & (F.col("date") >= first)).drop("month")


def upsert_stored(new: DataFrame, name: str, version: list[str | Column]) -> list[str]:
    """A10: the newest version of each (ticker, date) into the table; the names of the months that were rewritten.

    The months' rows are merged into a folder of their own first, as a table cannot be read and overwritten at once.
    """
    spark = new.sparkSession
    table = spark.table(name)
    new = new.withColumn("month", month_of())
    touched = sorted(r[0] for r in new.select("month").distinct().collect())  # one short text a month
    if not touched:
        return []
    merged = upsert(table.where(F.col("month").isin(touched)), new, ["ticker", "date"], version)
    folder = shared_dir(spark, "merged")
    merged.select(*table.columns).write.parquet(folder)
    buckets = int({r[0]: r[1] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()}["Num Buckets"])
    rows = _dealt(spark.read.schema(table.schema).parquet(folder), buckets, _width(spark))
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        rows.select(*table.columns).write.insertInto(name, overwrite=True)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)
    return touched
