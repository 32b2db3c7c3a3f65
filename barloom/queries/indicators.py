"""Queries of the indicator operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import indicators as I
from ..sources.views import BARS, INDEX_BARS, SECTOR_INDEX_BARS, bars, index_bars, rnd, sector_index_bars
from . import query
from .sqltext import ALL_INDICATORS, LATEST, W, ctes, last, rnds


def rounded(df, k, *names):
    return [rnd(F.col(n).cast("double"), k).alias(n) for n in names]


@query("F1_history_trim", ctes(BARS) + f"""
, g AS (SELECT *, CASE WHEN date - lag(date) OVER ({W}) > 25 THEN date END AS cut FROM bars),
s AS (SELECT ticker, max(cut) AS start FROM g GROUP BY 1),
n AS (SELECT ticker, start, count(*) AS remaining FROM bars JOIN s USING (ticker) WHERE start IS NULL OR date >= start GROUP BY 1, 2)
SELECT ticker, count(*) AS bars, min(date) AS first_date, max(date) AS last_date, sum(close * volume) AS turnover
FROM bars JOIN n USING (ticker) WHERE start IS NULL OR remaining < 15 OR date >= start GROUP BY 1""".replace("sum(close * volume)", "floor(sum(close * volume) * 1.0 + 0.5) / 1.0"))
def f1(spark, d):
    out = I.history_trim(bars(spark, d)).groupBy("ticker").agg(
        F.count("*").alias("bars"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.sum(F.col("close") * F.col("volume")).alias("turnover")
    )
    return out.withColumn("turnover", rnd(F.col("turnover"), 0))


@query("A8_scan_ticker", ctes(BARS) + f"""
, g AS (SELECT *, CASE WHEN date - lag(date) OVER ({W}) > 25 THEN date END AS cut FROM bars WHERE ticker = 'S7'),
s AS (SELECT max(cut) AS start, count(*) FILTER (WHERE date >= (SELECT max(cut) FROM g)) AS remaining FROM g)
SELECT date, ticker, open, high, low, close, volume FROM g, s WHERE start IS NULL OR remaining < 15 OR date >= start""")
def a8(spark, d):
    return I.scan_ticker(bars(spark, d), "S7")


@query("A9_scan_bulk_lookback", ctes(BARS) + "SELECT * FROM bars WHERE date >= (SELECT max(date) FROM bars) - 400")
def a9(spark, d):
    return I.scan_lookback(bars(spark, d), 400)


@query("F2_sma", ctes(BARS) + f"SELECT ticker, date, {rnds(6, f'avg(close) OVER {last(50)} AS sma_50', f'avg(close) OVER {last(200)} AS sma_200')} FROM bars")
def f2(spark, d):
    df = bars(spark, d)
    return df.select("ticker", "date", rnd(I.sma(50), 6).alias("sma_50"), rnd(I.sma(200), 6).alias("sma_200"))


@query("F6_F8_F9_bands", ctes(*ALL_INDICATORS, LATEST) + f"SELECT ticker, bb_kc_squeeze, {rnds(5, 'atr_14', 'bb_upper', 'bb_lower', 'bb_percent_b', 'ema_20 + 1.5 * atr_14 AS kc_upper', 'ema_20 - 1.5 * atr_14 AS kc_lower')} FROM latest")
def bands(spark, d):
    df = I.latest(I.indicators(bars(spark, d)))
    return df.select("ticker", "bb_kc_squeeze", *rounded(df, 5, "atr_14", "bb_upper", "bb_lower", "bb_percent_b", "kc_upper", "kc_lower"))


@query("F3_F4_F5_F7_smoothed", ctes(*ALL_INDICATORS, LATEST) + f"SELECT ticker, {rnds(6, 'ema_20', 'rsi_14', 'macd', 'macd_signal', 'macd_histogram', 'adx_14')} FROM latest")
def smooth(spark, d):
    df = I.latest(I.indicators(bars(spark, d)))
    return df.select("ticker", *rounded(df, 6, "ema_20", "rsi_14", "macd", "macd_signal", "macd_histogram", "adx_14"))


@query("F10_F11_volume_and_flow", ctes(BARS) + f"""
SELECT ticker, date, {rnds(5, f'avg(volume) OVER {last(20)} AS volume_avg', f'volume / nullif(avg(volume) OVER {last(20)}, 0) AS volume_ratio',
f'coalesce(sum((high + low + close) / 3.0 * volume) OVER {last(20)} / nullif(sum(volume) OVER {last(20)}, 0), close) AS vwap_20',
f'coalesce(sum(coalesce((2 * close - low - high) / nullif(high - low, 0), 0) * volume) OVER {last(20)} / nullif(sum(volume) OVER {last(20)}, 0), 0) AS cmf_20')},
{rnds(4, f'CASE WHEN stddev_samp(volume) OVER {last(20)} > 1e-8 THEN (volume - avg(volume) OVER {last(20)}) / stddev_samp(volume) OVER {last(20)} ELSE 0 END AS vol_z_score')} FROM bars""")
def f10(spark, d):
    df = I.money_flow(I.volume_stats(bars(spark, d)))
    return df.select("ticker", "date", *rounded(df, 5, "volume_avg", "volume_ratio", "vwap_20", "cmf_20"), *rounded(df, 4, "vol_z_score"))


@query("F12_D5_weekly_asof", ctes(*ALL_INDICATORS, LATEST) + f"SELECT ticker, {rnds(6, 'w_sma_50', 'w_rsi')} FROM latest")
def f12(spark, d):
    df = I.latest(I.indicators(bars(spark, d)))
    return df.select("ticker", *rounded(df, 6, "w_sma_50", "w_rsi"))


@query("F13_F14_F15_trend_class", ctes(*ALL_INDICATORS, LATEST) + f"SELECT ticker, date, close, trend_class, {rnds(4, 'rsi_14', 'adx_14')} FROM latest")
def f13(spark, d):
    df = I.latest(I.indicators(bars(spark, d)))
    return df.select("ticker", "date", "close", "trend_class", *rounded(df, 4, "rsi_14", "adx_14"))


@query("F16_range_position", ctes(BARS) + f"""
, x AS (SELECT *, lag(close) OVER ({W}) AS pc, max(high) OVER {last(250)} AS range_high, min(low) OVER {last(250)} AS range_low FROM bars)
SELECT ticker, date, range_high, range_low, {rnds(6, 'coalesce((close - pc) / pc * 100, 0) AS gap_pct', 'CASE WHEN range_high > range_low THEN (close - range_low) / (range_high - range_low) * 100 ELSE 50 END AS range_pos')} FROM x""")
def f16(spark, d):
    df = I.range_position(bars(spark, d))
    return df.select("ticker", "date", "range_high", "range_low", *rounded(df, 6, "gap_pct", "range_pos"))


@query("F17_F18_signals", ctes(*ALL_INDICATORS, LATEST) + """
SELECT ticker, CASE WHEN macd_histogram > 0 AND prev_hist <= 0 THEN 'Bullish Cross' WHEN macd_histogram < 0 AND prev_hist >= 0 THEN 'Bearish Cross'
  WHEN macd_histogram > 0 THEN 'Bullish' WHEN macd_histogram < 0 THEN 'Bearish' ELSE 'Neutral' END AS macd_state,
  coalesce(pc, close) <= prev_sma AND close > sma_50 AS crossover, close > ema_20 AND rsi_14 >= 55 AS momentum FROM latest""")
def f17(spark, d):
    df = I.indicators(bars(spark, d)).withColumns({"macd_state": I.macd_state(), "crossover": I.crossover(), "momentum": I.momentum()})
    return I.latest(df).select("ticker", "macd_state", "crossover", "momentum")


REGIME_SQL = f"""
r0 AS (SELECT *, avg(close) OVER {last(50)} AS sma_50 FROM index_bars),
r1 AS (SELECT *, lag(sma_50, 10) OVER ({W}) AS before FROM r0),
regimes AS (SELECT ticker, date, close, CASE WHEN before IS NULL THEN 'unknown' WHEN close > sma_50 AND sma_50 > before THEN 'bull'
    WHEN close < sma_50 AND sma_50 < before THEN 'bear' ELSE 'neutral' END AS regime FROM r1)"""


@query("F19_regime_series", ctes(INDEX_BARS, REGIME_SQL) + "SELECT * FROM regimes")
def f19(spark, d):
    return I.regime_series(index_bars(spark, d)).select("ticker", "date", "close", "regime")


@query("F20_regime_snapshot", ctes(SECTOR_INDEX_BARS, REGIME_SQL.replace("index_bars", "sector_index_bars")) + "SELECT ticker, arg_max(regime, date) AS regime, arg_max(close, date) AS close, max(date) AS date FROM regimes GROUP BY 1")
def f20(spark, d):
    return I.latest(I.regime_series(sector_index_bars(spark, d))).select("ticker", "regime", "close", "date")


@query("D4_F21_ratio_rotation", ctes(SECTOR_INDEX_BARS) + """
, p AS (SELECT a.date, a.close / b.close AS ratio FROM sector_index_bars a JOIN sector_index_bars b USING (date) WHERE a.ticker = '.N1' AND b.ticker = '.N2'),
q AS (SELECT *, CASE WHEN count(*) OVER f = 20 THEN avg(ratio) OVER f END AS fast, CASE WHEN count(*) OVER s = 50 THEN avg(ratio) OVER s END AS slow FROM p
  WINDOW f AS (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), s AS (ORDER BY date ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))
SELECT date, """ + rnds(9, "ratio", "fast", "slow") + ", lag(CASE WHEN slow IS NOT NULL THEN CASE WHEN fast > slow THEN 'a' WHEN fast < slow THEN 'b' ELSE 'flat' END END) OVER (ORDER BY date) AS signal FROM q")
def f21(spark, d):
    s = sector_index_bars(spark, d)
    df = I.ratio_rotation(s.where("ticker = '.N1'"), s.where("ticker = '.N2'"))
    return df.select("date", *rounded(df, 9, "ratio", "fast", "slow"), "signal")


@query("F28_volume_build", ctes(BARS) + f"""
, x AS (SELECT *, count(*) OVER (PARTITION BY ticker) AS n, avg(volume) OVER {last(5)} AS a, avg(volume) OVER ({W} ROWS BETWEEN 9 PRECEDING AND 5 PRECEDING) AS b, avg(volume) OVER {last(10)} AS c, avg(volume) OVER {last(50)} AS e FROM bars)
SELECT ticker, date, {rnds(6, 'CASE WHEN n >= 10 THEN coalesce(a / nullif(b, 0), 0) ELSE 1 END AS volume_build', 'CASE WHEN n >= 50 THEN c / nullif(e, 0) END AS dry_up')} FROM x""")
def f28(spark, d):
    df = I.volume_build(bars(spark, d))
    return df.select("ticker", "date", *rounded(df, 6, "volume_build", "dry_up"))


ATR_PERCENTILE_SQL = f"""
ap AS (SELECT *, coalesce(avg(tr) OVER {last(14)}, 0) / close * 100 AS p FROM moves),
atrp AS (SELECT ticker, CASE WHEN count(p) >= 10 THEN count(*) FILTER (WHERE p <= now) * 1.0 / count(p) * 100 END AS atr_percentile
  FROM (SELECT *, max(CASE WHEN i = n_bars THEN p END) OVER (PARTITION BY ticker) AS now FROM ap WHERE i > n_bars - 60) GROUP BY ticker)"""


@query("F29_atr_percentile", ctes(BARS, ALL_INDICATORS[1], ATR_PERCENTILE_SQL) + f"SELECT ticker, {rnds(6, 'atr_percentile')} FROM atrp")
def f29(spark, d):
    df = bars(spark, d).withColumn("tr", I.true_range()).withColumn("atr_14", I.atr())
    out = I.atr_percentile(df)
    return out.select("ticker", *rounded(out, 6, "atr_percentile"))


@query("F30_up_down_volume", ctes(BARS) + f"""
, x AS (SELECT *, close >= lag(close) OVER ({W}) AS up, row_number() OVER ({W}) AS i FROM bars),
y AS (SELECT ticker, date, i, sum(CASE WHEN up THEN volume ELSE 0 END) OVER {last(15)} AS u, sum(CASE WHEN NOT up THEN volume ELSE 0 END) OVER {last(15)} AS v FROM x)
SELECT ticker, date, {rnds(6, 'CASE WHEN i >= 16 THEN CASE WHEN v > 0 THEN u / v WHEN u > 0 THEN 1.3 END END AS up_down_volume')} FROM y""")
def f30(spark, d):
    df = I.with_up_down_volume(bars(spark, d))
    return df.select("ticker", "date", *rounded(df, 6, "up_down_volume"))


@query("F31_adx_rising", ctes(*ALL_INDICATORS) + f", z AS (SELECT ticker, date, i, n_bars, adx_14 > lag(adx_14, 5) OVER ({W}) AS adx_rising FROM ind) SELECT ticker, adx_rising FROM z WHERE i = n_bars")
def f31(spark, d):
    return I.latest(I.indicators(bars(spark, d)).withColumn("adx_rising", I.adx_rising())).select("ticker", "adx_rising")


@query("F32_failed_resistance_test", ctes(BARS) + f"""
, x AS (SELECT *, max(high) OVER {last(250)} AS level, max(high) OVER {last(10)} AS touched FROM bars)
SELECT ticker, date, level, touched >= level * 0.98 AND close <= level * 0.95 AS failed FROM x""")
def f32(spark, d):
    df = bars(spark, d).withColumn("level", F.max("high").over(I.last(250)))
    return df.select("ticker", "date", "level", I.failed_test(F.col("level")).alias("failed"))


@query("F33_n_bar_returns", ctes(BARS) + f"SELECT ticker, date, {rnds(6, f'(close - lag(close) OVER ({W})) / lag(close) OVER ({W}) * 100 AS ret_1', f'(close - lag(close, 5) OVER ({W})) / lag(close, 5) OVER ({W}) * 100 AS ret_5')} FROM bars")
def f33(spark, d):
    return bars(spark, d).select("ticker", "date", rnd(I.n_bar_return(1), 6).alias("ret_1"), rnd(I.n_bar_return(5), 6).alias("ret_5"))


@query("F34_peak_since_entry", ctes(BARS) + """
, e AS (SELECT 'S' || (o_custkey % 10) AS ticker, CAST(o_orderdate AS date) AS entry_date FROM orders GROUP BY 1, 2)
SELECT ticker, entry_date, max(close) AS peak, arg_max(close, date) AS now, """ + rnds(6, "(arg_max(close, date) - max(close)) / max(close) * 100 AS drawdown_pct") + " FROM bars JOIN e USING (ticker) WHERE date >= entry_date GROUP BY 1, 2")
def f34(spark, d):
    from ..sources.views import table

    e = table(spark, d, "orders").select(F.concat(F.lit("S"), (F.col("o_custkey") % 10).cast("string")).alias("ticker"), F.to_date("o_orderdate").alias("entry_date")).distinct()
    df = I.peak_since(bars(spark, d), e)
    return df.select("ticker", "entry_date", "peak", "now", *rounded(df, 6, "drawdown_pct"))


@query("F36_linear_trendline", ctes(BARS) + f"""
, x AS (SELECT ticker, close, row_number() OVER ({W}) - 1 AS x FROM bars),
f AS (SELECT ticker, regr_slope(close, x) AS slope, regr_intercept(close, x) AS intercept, count(*) AS n FROM x GROUP BY 1)
SELECT ticker, {rnds(6, 'slope', 'intercept')}, {rnds(2, 'slope * (n - 1) / intercept * 100 AS change_pct')} FROM f""")
def f36(spark, d):
    df = I.trendline(bars(spark, d))
    return df.select("ticker", *rounded(df, 6, "slope", "intercept"), *rounded(df, 2, "change_pct"))


def _weeks(day: int) -> str:
    return f"SELECT ticker, date + CAST(({day + 7} - isodow(date)) % 7 AS integer) AS week, arg_min(open, date) AS open, max(high) AS high, min(low) AS low, arg_max(close, date) AS close, sum(volume) AS volume FROM bars GROUP BY 1, 2"


@query("E33_weekly_bars", ctes(BARS) + _weeks(5))
def e33(spark, d):
    return I.weekly_bars(bars(spark, d))


@query("F27_pivot_points", ctes(BARS, f"w AS ({_weeks(7)})") + """
, p AS (SELECT *, (high + low + close) / 3 AS pp FROM w QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY week DESC) = 2)
SELECT ticker, """ + rnds(5, "pp", "2 * pp - low AS r1", "pp + (high - low) AS r2", "high + 2 * (pp - low) AS r3", "2 * pp - high AS s1", "pp - (high - low) AS s2", "low - 2 * (high - pp) AS s3") + " FROM p")
def f27(spark, d):
    df = I.pivot_points(bars(spark, d))
    return df.select("ticker", *rounded(df, 5, "pp", "r1", "r2", "r3", "s1", "s2", "s3"))


@query("F38_price_and_atr_latest", ctes(BARS, ALL_INDICATORS[1]) + f", a AS (SELECT *, coalesce(avg(tr) OVER {last(14)}, 0) AS atr FROM moves) SELECT ticker, close AS price, {rnds(6, 'atr')} FROM a WHERE i = n_bars")
def f38(spark, d):
    df = bars(spark, d).withColumns({"tr": I.true_range(), "n_bars": I.n_bars()}).withColumn("atr_14", I.atr())
    out = I.price_and_atr_latest(df)
    return out.select("ticker", "price", *rounded(out, 6, "atr"))
