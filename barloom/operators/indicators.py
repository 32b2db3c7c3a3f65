"""Technical indicators over (ticker, date) bars.

Rolling measures are window expressions; everything that smooths exponentially
is computed in one grouped pass, because its recurrence runs through a ticker's
whole history. All of it hangs on one partitioning by ticker.

Windows adapt to short histories (k = min(k, bars)). Null means missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import T
from ..functions.batches import by_ticker
from ..functions.isolation import per_ticker, sound
from ..functions.smoothing import SMOOTHED, smoothed, smoothed_batch


def w():
    return Window.partitionBy("ticker").orderBy("date")


def every():
    return Window.partitionBy("ticker")


def last(k: int):
    """Frame of the last k bars."""
    return w().rowsBetween(1 - k, 0)


def n_bars() -> Column:
    return F.count("*").over(every())


def history_trim(bars: DataFrame, gap_days: int = T.gap_days, min_bars: int = T.min_bars) -> DataFrame:
    """bars from the last gap of more than ``gap_days`` on, if enough remain."""
    gap = F.datediff("date", F.lag("date").over(w())) > gap_days
    cut = bars.withColumn("_start", F.when(gap, F.col("date"))).withColumn("_start", F.max("_start").over(every()))
    cut = cut.withColumn("_left", F.sum(F.when(F.col("_start").isNull() | (F.col("date") >= F.col("_start")), 1).otherwise(0)).over(every()))
    keep = F.col("_start").isNull() | (F.col("_left") < min_bars) | (F.col("date") >= F.col("_start"))
    return cut.where(keep).drop("_start", "_left")


def scan_ticker(bars: DataFrame, ticker: str) -> DataFrame:
    """One ticker's trimmed bars."""
    return history_trim(bars.where(F.col("ticker") == ticker))


def scan_lookback(bars: DataFrame, days: int) -> DataFrame:
    """All bars of the last ``days`` days before the latest date."""
    latest = bars.agg(F.max("date").alias("_latest"))
    return bars.join(F.broadcast(latest), F.col("date") >= F.date_sub("_latest", days)).drop("_latest")


def sma(k: int) -> Column:
    """F2."""
    return F.avg("close").over(last(k))


def true_range() -> Column:
    prev = F.lag("close").over(w())
    return F.when(
        prev.isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))
    )


def atr(k: int = 14) -> Column:
    """expects the column ``tr``."""
    return F.coalesce(F.avg("tr").over(last(k)), F.lit(0.0))


def bollinger(df: DataFrame, k: int = 20) -> DataFrame:
    """F8."""
    mean, std = F.avg("close").over(last(k)), F.coalesce(F.stddev_samp("close").over(last(k)), F.lit(0.0))
    df = df.withColumns({"bb_upper": mean + 2 * std, "bb_lower": mean - 2 * std})
    width = F.col("bb_upper") - F.col("bb_lower")
    return df.withColumn("bb_percent_b", F.when(width != 0, (F.col("close") - F.col("bb_lower")) / width).otherwise(F.lit(0.5)))


def keltner(df: DataFrame) -> DataFrame:
    """expects ema_20, atr_14 and the Bollinger bands."""
    df = df.withColumns({"kc_upper": F.col("ema_20") + 1.5 * F.col("atr_14"), "kc_lower": F.col("ema_20") - 1.5 * F.col("atr_14")})
    return df.withColumn("bb_kc_squeeze", (F.col("bb_upper") <= F.col("kc_upper")) & (F.col("bb_lower") >= F.col("kc_lower")))


def volume_stats(df: DataFrame, k: int = 20) -> DataFrame:
    """F10."""
    df = df.withColumn("volume_avg", F.avg("volume").over(last(k)))
    std = F.stddev_samp("volume").over(last(k))
    return df.withColumns(
        {
            "volume_ratio": F.coalesce(F.try_divide("volume", "volume_avg"), F.lit(1.0)),
            "vol_z_score": F.coalesce(F.when(std > 1e-8, (F.col("volume") - F.col("volume_avg")) / std), F.lit(0.0)),
        }
    )


def money_flow(df: DataFrame, k: int = 20) -> DataFrame:
    """F11."""
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3.0
    spread = F.col("high") - F.col("low")
    flow = F.when(spread != 0, ((F.col("close") - F.col("low")) - (F.col("high") - F.col("close"))) / spread).otherwise(F.lit(0.0))
    volume = F.sum("volume").over(last(k))
    return df.withColumns(
        {
            "vwap_20": F.coalesce(F.try_divide(F.sum(typical * F.col("volume")).over(last(k)), volume), F.col("close")),
            "cmf_20": F.coalesce(F.try_divide(F.sum(flow * F.col("volume")).over(last(k)), volume), F.lit(0.0)),
        }
    )


def with_smoothed(bars: DataFrame, adapt: bool = True) -> DataFrame:
    """F3, F4, F5, F7, F12; ``adapt``: how short histories are taken (see ``smoothed``)."""
    bars = bars.select("ticker", "date", "open", "high", "low", "close", "volume")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in bars.schema) + "".join(f", {c} double" for c in SMOOTHED)
    out = by_ticker(bars, lambda t: smoothed_batch(t, adapt), schema)
    return out.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("w_sma_50", "w_rsi")})


def smoothed_or_error(bars: DataFrame) -> DataFrame:
    """M5: as ``with_smoothed``, with the column ``error``; a ticker whose history cannot be smoothed is one row."""
    bars = bars.select("ticker", "date", "open", "high", "low", "close", "volume")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in bars.schema) + "".join(f", {c} double" for c in SMOOTHED)

    def one(g):
        sound(g)
        return smoothed(g)

    out = per_ticker(bars, one, schema)
    return out.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("w_sma_50", "w_rsi")})


def trend_class() -> Column:
    """F13."""
    above, rsi = F.col("close") >= F.col("sma_50"), F.col("rsi_14")
    strong = F.col("adx_14") >= 20
    return (
        F.when(above & (rsi >= 45) & strong, "Strong Bullish")
        .when(above & (rsi >= 45), "Weak Bullish (Low Trend Strength)")
        .when(F.col("close") >= F.col("sma_50") * 0.95, "Weak Bullish")
        .when((rsi >= 40) & (rsi <= 60), "Consolidation / Neutral")
        .when((F.col("close") < F.col("sma_50")) & (rsi < 40) & strong, "Strong Bearish")
        .when((F.col("close") < F.col("sma_50")) & (rsi < 40), "Weak Bearish (Low Trend Strength)")
        .otherwise("Weak Bearish")
    )


def validated(df: DataFrame) -> DataFrame:
    """rsi and adx within 0 to 100, atr not negative."""
    def clip(c):
        return F.least(F.greatest(F.coalesce(c, F.lit(50.0 if c == "rsi_14" else 0.0)), F.lit(0.0)), F.lit(100.0))

    return df.withColumns({"rsi_14": clip("rsi_14"), "adx_14": clip("adx_14"), "atr_14": F.greatest(F.coalesce("atr_14", F.lit(0.0)), F.lit(0.0))})


def indicators(bars: DataFrame, adapt: bool = True) -> DataFrame:
    """K1: every indicator for every bar."""
    df = with_smoothed(bars, adapt)
    df = df.withColumns({"n_bars": n_bars(), "sma_50": sma(50), "sma_200": sma(200), "tr": true_range()})
    df = df.withColumn("atr_14", atr())
    df = keltner(bollinger(df))
    df = money_flow(volume_stats(df))
    df = df.withColumns(
        {
            "macd": F.col("ema_12") - F.col("ema_26"),
            "w_sma_50": F.coalesce("w_sma_50", "sma_50"),
            "w_rsi": F.coalesce("w_rsi", "rsi_14"),
        }
    )
    df = df.withColumn("macd_histogram", F.col("macd") - F.col("macd_signal"))
    return validated(df).withColumn("trend_class", trend_class())


def latest(df: DataFrame) -> DataFrame:
    """the last bar of every ticker."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date")))).where("_n = 1").drop("_n")


def range_position(df: DataFrame, k: int = T.lookback) -> DataFrame:
    """F16: gap to the previous close, extremes of the last k bars, position between them."""
    prev = F.lag("close").over(w())
    df = df.withColumns(
        {
            "prev_close": prev,
            "gap_pct": F.coalesce(F.when(prev > 0, (F.col("close") - prev) / prev * 100), F.lit(0.0)),
            "range_high": F.max("high").over(last(k)),
            "range_low": F.min("low").over(last(k)),
        }
    )
    width = F.col("range_high") - F.col("range_low")
    return df.withColumn("range_pos", F.when(width > 0, (F.col("close") - F.col("range_low")) / width * 100).otherwise(F.lit(50.0)))


def macd_state() -> Column:
    """F17."""
    h = F.col("macd_histogram")
    prev = F.coalesce(F.lag("macd_histogram").over(w()), h)
    return (
        F.when((h > 0) & (prev <= 0), "Bullish Cross").when((h < 0) & (prev >= 0), "Bearish Cross").when(h > 0, "Bullish").when(h < 0, "Bearish").otherwise("Neutral")
    )


def crossover() -> Column:
    """the close passes its 50-bar mean."""
    prev_close, prev_mean = F.coalesce(F.lag("close").over(w()), F.col("close")), F.coalesce(F.lag("sma_50").over(w()), F.col("sma_50"))
    return (prev_close <= prev_mean) & (F.col("close") > F.col("sma_50"))


def momentum() -> Column:
    """F18."""
    return (F.col("close") > F.col("ema_20")) & (F.col("rsi_14") >= T.momentum_rsi)


def n_bar_return(k: int) -> Column:
    """F33, in percent; null without k earlier bars."""
    before = F.lag("close", k).over(w())
    return F.when(before > 0, (F.col("close") - before) / before * 100)


def regime_series(df: DataFrame) -> DataFrame:
    """bull, bear or neutral; unknown for the first ten bars. Adds ``sma_50``."""
    df = df.withColumn("sma_50", sma(50))
    before = F.lag("sma_50", 10).over(w())
    regime = (
        F.when(before.isNull(), "unknown")
        .when((F.col("close") > F.col("sma_50")) & (F.col("sma_50") > before), "bull")
        .when((F.col("close") < F.col("sma_50")) & (F.col("sma_50") < before), "bear")
        .otherwise("neutral")
    )
    return df.withColumn("regime", regime)


def align(a: DataFrame, b: DataFrame) -> DataFrame:
    """Dates that both series have, with both closes."""
    left = a.where("close is not null").select("date", F.col("close").alias("close_a"))
    return left.join(b.where("close is not null").select("date", F.col("close").alias("close_b")), "date")


def ratio_rotation(a: DataFrame, b: DataFrame, fast: int = 20, slow: int = 50) -> DataFrame:
    """the ratio's fast against slow mean, over full windows, as a signal for the next bar."""
    pair = align(a, b).withColumn("ticker", F.lit("ratio")).withColumn("ratio", F.col("close_a") / F.col("close_b"))

    def full(k):
        return F.when(F.count("*").over(last(k)) == k, F.avg("ratio").over(last(k)))

    pair = pair.withColumns({"fast": full(fast), "slow": full(slow)})
    now = F.when(F.col("slow").isNotNull(), F.when(F.col("fast") > F.col("slow"), "a").when(F.col("fast") < F.col("slow"), "b").otherwise("flat"))
    return pair.withColumn("signal", F.lag(now).over(w())).select("date", "ratio", "fast", "slow", "signal")


def volume_build(df: DataFrame) -> DataFrame:
    """mean volume of the last 5 bars over the 5 before, and of 10 over 50."""
    recent, prior = F.avg("volume").over(last(5)), F.avg("volume").over(w().rowsBetween(-9, -5))
    return df.withColumns(
        {
            "volume_build": F.when(n_bars() >= 10, F.coalesce(F.try_divide(recent, prior), F.lit(0.0))).otherwise(F.lit(1.0)),
            "dry_up": F.when(n_bars() >= 50, F.try_divide(F.avg("volume").over(last(10)), F.avg("volume").over(last(50)))),
        }
    )


def atr_percentile(df: DataFrame, k: int = 60) -> DataFrame:
    """for the latest bars, the share of the last k ATR percentages that are not above the current one."""
    share = F.col("atr_14") / F.col("close") * 100
    hist = df.select("ticker", "date", share.alias("_p"), F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date"))).alias("_i")).where(F.col("_i") <= k)
    now = F.max(F.when(F.col("_i") == 1, F.col("_p"))).over(every())
    ranked = hist.withColumn("_now", now).groupBy("ticker").agg(
        F.count("_p").alias("_n"), F.sum((F.col("_p") <= F.col("_now")).cast("int")).alias("_le")
    )
    return ranked.select("ticker", F.when(F.col("_n") >= 10, F.col("_le") / F.col("_n") * 100).alias("atr_percentile"))


def up_down_volume(k: int = 15) -> Column:
    """expects ``_up``."""
    up = F.sum(F.when(F.col("_up"), F.col("volume")).otherwise(0.0)).over(last(k))
    down = F.sum(F.when(~F.col("_up"), F.col("volume")).otherwise(0.0)).over(last(k))
    return F.when(F.count("*").over(w()) >= k + 1, F.when(down > 0, up / down).when(up > 0, F.lit(1.3)))


def with_up_down_volume(df: DataFrame, k: int = 15) -> DataFrame:
    df = df.withColumn("_up", F.col("close") >= F.lag("close").over(w()))
    return df.withColumn("up_down_volume", up_down_volume(k)).drop("_up")


def adx_rising() -> Column:
    """F31; short histories compare with themselves."""
    return F.col("adx_14") > F.when(F.count("*").over(w()) > 6, F.lag("adx_14", 5).over(w())).otherwise(F.col("adx_14"))


def failed_test(level: Column, k: int = 10, near_pct: float = 2.0, reject_pct: float = 5.0) -> Column:
    """F32: the level was nearly touched in the last k bars and the price has fallen back since."""
    touched = F.max("high").over(last(k)) >= level * (1 - near_pct / 100)
    return F.coalesce((level > 0) & touched & (F.col("close") <= level * (1 - reject_pct / 100)), F.lit(False))


def peak_since(bars: DataFrame, entries: DataFrame) -> DataFrame:
    """``entries`` (ticker, entry_date) with the highest close since and the drawdown from it."""
    held = bars.join(entries, "ticker").where("date >= entry_date")
    out = held.groupBy("ticker", "entry_date").agg(F.max("close").alias("peak"), F.max_by("close", "date").alias("now"))
    return out.withColumn("drawdown_pct", (F.col("now") - F.col("peak")) / F.col("peak") * 100)


def trendline(df: DataFrame) -> DataFrame:
    """least squares over the bar number; change of the fitted line, in percent."""
    x = F.row_number().over(w()) - 1
    fit = df.withColumn("_x", x).groupBy("ticker").agg(
        F.regr_slope("close", "_x").alias("slope"), F.regr_intercept("close", "_x").alias("intercept"), F.count("*").alias("n")
    )
    end = F.col("intercept") + F.col("slope") * (F.col("n") - 1)
    return fit.select("ticker", "slope", "intercept", ((end - F.col("intercept")) / F.col("intercept") * 100).alias("change_pct"))


def weekly_bars(bars: DataFrame, ends: str = "FRI") -> DataFrame:
    """Calendar weeks ending on Friday or Sunday."""
    week = F.next_day(F.date_sub("date", 1), ends).alias("week")
    return bars.groupBy("ticker", week).agg(
        F.min_by("open", "date").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "date").alias("close"),
        F.sum("volume").alias("volume"),
    )


def pivot_points(bars: DataFrame) -> DataFrame:
    """from the last completed week that ends on Sunday."""
    weeks = weekly_bars(bars, "SUN").withColumn("_i", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("week"))))
    h, low, c = F.col("high"), F.col("low"), F.col("close")
    pp = (h + low + c) / 3
    return weeks.where("_i = 2").select(
        "ticker", pp.alias("pp"),
        (2 * pp - low).alias("r1"), (pp + (h - low)).alias("r2"), (h + 2 * (pp - low)).alias("r3"),
        (2 * pp - h).alias("s1"), (pp - (h - low)).alias("s2"), (low - 2 * (h - pp)).alias("s3"),
    )


def price_and_atr_latest(df: DataFrame) -> DataFrame:
    """last close and ATR; zeros under five bars. Expects ``atr_14`` and ``n_bars``."""
    enough = F.col("n_bars") >= 5
    return latest(df).select("ticker", F.when(enough, F.col("close")).otherwise(0.0).alias("price"), F.when(enough, F.col("atr_14")).otherwise(0.0).alias("atr"))
