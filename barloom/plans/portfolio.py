"""Held positions against the scan (K4), market state (K5) and small selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ROUND_TRIP, T
from ..functions import rules as R
from ..operators import indicators as I
from ..operators import structure as S


def positions_to_latest(owned: DataFrame, latest: DataFrame) -> DataFrame:
    """Holdings with their latest bar; without one the price is the cost. ``owned``: ticker, buy_price, shares, purchase_date."""
    cols = [c for c in ("close", "atr_14", "vwap_20", "n_bars", "sector") if c in latest.columns]
    df = owned.join(latest.select("ticker", *cols), "ticker", "left")
    price = F.coalesce("close", "buy_price")
    return df.withColumns({"price": price, "has_data": F.col("close").isNotNull(), "cost": F.col("buy_price") * F.col("shares"), "value": price * F.col("shares")})


def with_targets(positions: DataFrame, targets: DataFrame) -> DataFrame:
    """The position's profit target. ``targets``: ticker, target_mode, target_value."""
    df = positions.join(targets.select("ticker", "target_mode", "target_value"), "ticker", "left")
    return df.withColumns(R.target_fields("target_mode", "target_value", "buy_price", "shares"))


def with_enrichment(rows: DataFrame, enrichment: DataFrame) -> DataFrame:
    """The latest fundamentals of each ticker."""
    newest = enrichment.withColumn("_r", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date")))).where("_r = 1").drop("_r", "date")
    return rows.join(newest, "ticker", "left")


def exits(owned: DataFrame, bars: DataFrame, latest: DataFrame, as_of: str) -> DataFrame:
    """K4: holdings with stop, P&L, days, drawdown since the purchase, averaging-down and the exit action."""
    df = positions_to_latest(owned, latest)
    peaks = I.peak_since(bars, owned.select("ticker", F.col("purchase_date").alias("entry_date")).distinct())
    df = df.join(peaks.select("ticker", F.col("entry_date").alias("purchase_date"), "peak"), ["ticker", "purchase_date"], "left")
    long = F.coalesce(F.col("n_bars") >= T.min_bars, F.lit(False))
    atr = F.when(F.col("atr_14") > 0, F.col("atr_14")).otherwise(F.col("price") * 0.02)
    df = df.withColumns(
        {
            "stop": F.when(long, F.col("price") - T.atr_stop * atr).otherwise(F.col("price") * 0.95),
            "take_profit": F.when(long, R.take_profit("price", atr)).otherwise(F.col("price") * (1 + T.default_profit_pct / 100 + ROUND_TRIP)),
            "pnl_pct": F.when(F.col("buy_price") > 0, (F.col("price") / F.col("buy_price") - 1) * 100),
            "days": F.datediff(F.lit(as_of).cast("date"), "purchase_date"),
            "peak": F.coalesce("peak", F.greatest("buy_price", "price")),
        }
    )
    df = df.withColumns(R.exit_analytics("pnl_pct", "days", "price", "stop", "peak", "cost", "value")).withColumns(R.breakeven_fields("buy_price", "shares", "price"))
    return df.withColumn("action", R.exit_action(F.coalesce("n_bars", F.lit(0)), "pnl_pct", "price", F.coalesce("vwap_20", "price"), "take_profit"))


def market_state(index: DataFrame, sector_indices: DataFrame, pair: tuple[str, str]) -> DataFrame:
    """K5: regimes of all indices, the rotation between a pair and its peak divergence, as (name, state, date)."""
    both = index.unionByName(sector_indices)
    regimes = I.latest(I.regime_series(both)).select(F.col("ticker").alias("name"), F.col("regime").alias("state"), "date")
    a, b = (sector_indices.where(F.col("ticker") == t) for t in pair)
    turn = I.ratio_rotation(a, b).orderBy(F.desc("date")).limit(1).select(F.lit("rotation").alias("name"), F.col("signal").alias("state"), "date")
    last = both.agg(F.max("date").alias("date"))
    apart = S.peak_divergence(a, b).join(last).select(F.lit("divergence").alias("name"), F.col("divergence").alias("state"), "date")
    return regimes.unionByName(turn).unionByName(apart)


def top_mover(rows: DataFrame) -> DataFrame:
    """The best score among buy actions."""
    return rows.where(F.col("raw_action").contains("BUY")).agg(F.max_by("ticker", F.struct("score", "ticker")).alias("ticker"), F.max("score").alias("score"))


def signal_reason() -> Column:
    """Action, trend and what speaks for it."""
    idle = F.col("raw_action").startswith("HOLD")
    parts = [
        F.col("raw_action"),
        F.concat(F.lit("trend="), "trend_class"),
        F.when(idle, "no decisive edge").when(F.col("confirmed"), "confirmed").otherwise("awaiting confirmation"),
        F.when(F.col("weekly_aligned"), "weekly aligned"),
        F.when(F.col("bb_kc_squeeze") & ~idle, "volatility squeeze"),
        F.when((F.col("cmf_20") > 0) & ~idle, "positive money flow"),
        F.when(F.col("volume_ratio") >= 1.0, F.format_string("vol x%.2f", "volume_ratio")),
    ]
    return F.concat_ws(" | ", F.array_compact(F.array(*parts)))


def divergence_note(action: Column, consensus: Column) -> Column:
    """The outside ratings are clearly on the other side."""
    ours = F.when(action.contains("BUY") | action.contains("ACCUMULATE"), 1).when(action.contains("SELL"), -1).otherwise(0)
    text = "Diverges from external consensus (%+.1f/2, {})"
    return F.when((ours == 1) & (consensus <= -1), F.format_string(text.format("bearish"), consensus)).when(
        (ours == -1) & (consensus >= 1), F.format_string(text.format("bullish"), consensus)
    )


def ticker_filter(df: DataFrame, tickers: list[str]) -> DataFrame:
    """Raw or normalised symbols."""
    from ..functions.clean import symbol

    wanted = [t.strip().upper() for t in tickers]
    return df.where(F.col("ticker").isin(wanted) | symbol("ticker").isin(wanted))


def without_demo(df: DataFrame) -> DataFrame:
    """C12."""
    return df.where(~F.coalesce(F.col("is_demo"), F.lit(False)))


def file_coverage(rows: DataFrame, year: int) -> DataFrame:
    """Rows, first and last date of every file (``_file``), and the rows before a year."""
    return rows.groupBy("_file").agg(F.count("date").alias("rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count_if(F.year("date") < year).alias("before"))
