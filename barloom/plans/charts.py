"""Chart series and the shards a page reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import indicators as I
from ..operators import structure as S
from ..sources import ingest
from ..sources.views import rnd

RANGE = 250


def stock_charts(bars: DataFrame, n: int = 365) -> DataFrame:
    """A ticker's last n bars as parallel arrays with the volume-weighted price, its nearest zones, pivots and patterns.

    Where no zone lies above or below the price, the highest high and the lowest low of 250 bars stand in.
    Tickers with a single bar are left out.
    """
    prepared = S.Prepared(bars)  # all parts read the bars as stored
    bars = prepared.bars
    recent = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date")))
    df = I.money_flow(bars).withColumn("_r", recent).where(F.col("_r") <= max(n, RANGE))
    near, shown = F.col("_r") <= RANGE, F.col("_r") <= n
    fields = ("date", "open", "high", "low", "close", "volume")
    one = F.struct(*fields, rnd(F.col("vwap_20"), 4).alias("vwap"))
    rows = df.groupBy("ticker").agg(
        F.array_sort(F.collect_list(F.when(shown, one))).alias("_b"), F.max(F.when(near, F.col("high"))).alias("_high"), F.min(F.when(near, F.col("low"))).alias("_low")
    ).where(F.size("_b") >= 2)
    zones = S.support_resistance(bars).where("rank = 1").groupBy("ticker").agg(*[F.max(F.when(F.col("side") == s, F.col("level"))).alias(f"_{s}") for s in ("resistance", "support")])
    points = I.pivot_points(bars)
    points = points.select("ticker", F.struct(*[c for c in points.columns if c != "ticker"]).alias("pivots"))
    found = S.detect_all(prepared).groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("start_index", "end_index", "pattern", "direction", "quality"))).alias("patterns"))
    out = rows.join(zones, "ticker", "left").join(points, "ticker", "left").join(found, "ticker", "left")
    return out.select(
        "ticker", *[F.col(f"_b.{c}").alias(f"{c}s") for c in (*fields, "vwap")], F.coalesce("_resistance", "_high").alias("resistance"), F.coalesce("_support", "_low").alias("support"),
        "pivots", F.coalesce("patterns", F.array()).alias("patterns"),
    )


def sector_charts(index: DataFrame, n: int = 365) -> DataFrame:
    """The last n values of every sector's index, to two places. ``index``: sector, date, index."""
    recent = index.withColumn("_r", F.row_number().over(Window.partitionBy("sector").orderBy(F.desc("date")))).where(F.col("_r") <= n)
    rows = recent.groupBy("sector").agg(F.array_sort(F.collect_list(F.struct("date", rnd(F.col("index"), 2).alias("close")))).alias("_b"))
    return rows.select("sector", F.col("_b.date").alias("dates"), F.col("_b.close").alias("closes"))


def ticker_shards(charts: DataFrame, matrix: DataFrame, sectors: DataFrame) -> DataFrame:
    """Per ticker its sector, its matrix row (null without one) and its chart, as one nested row for ``write_per_key``."""
    row = ingest.publishable(matrix)
    row = row.select("ticker", F.struct(*[c for c in row.columns if c != "ticker"]).alias("matrix"))
    chart = charts.select("ticker", F.element_at("dates", -1).alias("last_data_date"), F.struct(*[c for c in charts.columns if c != "ticker"]).alias("chart_history"))
    return chart.join(row, "ticker", "left").join(sectors.select("ticker", "sector"), "ticker", "left")
