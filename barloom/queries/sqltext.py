"""Pieces of SQL text that several queries share."""

from __future__ import annotations

from ..sources.views import BARS, sql_rnd


def ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def rnds(k: int, *names: str) -> str:
    return ", ".join(f"{sql_rnd(n.split(' AS ')[0], k)} AS {n.split(' AS ')[-1]}" for n in names)


def ewm(name: str, source: str, columns: dict[str, tuple[str, str, int | str]]) -> str:
    """Closed form of exponential smoothing: column -> (input, alpha, number of the first bar)."""
    sums = ", ".join(
        f"sum(CASE WHEN b.i = {first} THEN pow(1 - {alpha}, a.i - b.i) WHEN b.i > {first} THEN ({alpha}) * pow(1 - {alpha}, a.i - b.i) END * b.{x}) AS {c}"
        for c, (x, alpha, first) in columns.items()
    )
    return f"{name} AS (SELECT a.ticker, a.i, {sums} FROM {source} a JOIN {source} b ON a.ticker = b.ticker AND b.i <= a.i GROUP BY 1, 2)"


W = "PARTITION BY ticker ORDER BY date"


def last(k: int) -> str:
    return f"({W} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"


def _alpha(k: int) -> str:
    return f"(2.0 / {k + 1})"


NUMBERED = f"""
numbered AS (SELECT *, row_number() OVER ({W}) AS i, count(*) OVER (PARTITION BY ticker) AS n_bars,
    lag(close) OVER ({W}) AS pc, lag(high) OVER ({W}) AS ph, lag(low) OVER ({W}) AS pl FROM bars),
moves AS (SELECT *, CASE WHEN close > pc THEN close - pc ELSE 0 END AS gain, CASE WHEN close < pc THEN pc - close ELSE 0 END AS loss,
    CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr,
    CASE WHEN high - ph > pl - low AND high > ph THEN high - ph ELSE 0 END AS pdm,
    CASE WHEN pl - low > high - ph AND pl > low THEN pl - low ELSE 0 END AS mdm FROM numbered)"""

SMOOTH_1 = ewm(
    "smooth1",
    "moves",
    {
        "ema_20": ("close", _alpha(20), 1), "ema_12": ("close", _alpha(12), 1), "ema_26": ("close", _alpha(26), 1),
        "ag": ("gain", "1.0 / 14", 1), "al": ("loss", "1.0 / 14", 1),
        "str": ("tr", "1.0 / 14", 2), "spdm": ("pdm", "1.0 / 14", 1), "smdm": ("mdm", "1.0 / 14", 1),
    },
)
SMOOTH_2 = """
dx0 AS (SELECT *, ema_12 - ema_26 AS macd,
    CASE WHEN i > 1 THEN 100 * abs(spdm - smdm) / nullif(spdm + smdm, 0) END AS dx FROM smooth1),
dx AS (SELECT *, min(i) FILTER (WHERE dx IS NOT NULL) OVER (PARTITION BY ticker) AS dx_from FROM dx0),
""" + ewm("smooth2", "dx", {"macd_signal": ("macd", _alpha(9), 1), "adx": ("dx", "1.0 / 14", "b.dx_from")})  # from the first bar that has a value

WEEKLY = """
weeks AS (SELECT ticker, CAST(date AS date) + CAST((12 - isodow(date)) % 7 AS integer) AS label, arg_max(close, date) AS close FROM bars GROUP BY 1, 2),
wnum AS (SELECT *, row_number() OVER w AS i, lag(close) OVER w AS pc, lead(label) OVER w AS next_label,
    avg(close) OVER (PARTITION BY ticker ORDER BY label ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS sma FROM weeks WINDOW w AS (PARTITION BY ticker ORDER BY label)),
wmove AS (SELECT *, CASE WHEN close > pc THEN close - pc ELSE 0 END AS gain, CASE WHEN close < pc THEN pc - close ELSE 0 END AS loss FROM wnum),
""" + ewm("wsmooth", "wmove", {"ag": ("gain", "1.0 / 14", 1), "al": ("loss", "1.0 / 14", 1)}) + """,
wvalue AS (SELECT m.ticker, m.next_label, m.sma AS w_sma_50,
    CASE WHEN s.al = 0 AND s.ag > 0 THEN 100 WHEN s.al = 0 THEN 50 ELSE 100 - 100 / (1 + s.ag / s.al) END AS w_rsi
    FROM wmove m JOIN wsmooth s USING (ticker, i) WHERE m.next_label IS NOT NULL),
wdaily AS (SELECT b.ticker, b.date, v.w_sma_50, v.w_rsi FROM bars b ASOF LEFT JOIN wvalue v ON b.ticker = v.ticker AND b.date >= v.next_label)"""

INDICATORS = f"""
ind1 AS (SELECT m.*, s.ema_20, s.ag, s.al, d.macd, t.macd_signal, coalesce(t.adx, 0) AS adx_14,
    CASE WHEN s.al = 0 AND s.ag > 0 THEN 100 WHEN s.al = 0 THEN 50 ELSE 100 - 100 / (1 + s.ag / s.al) END AS rsi_14,
    d.macd - t.macd_signal AS macd_histogram
    FROM moves m JOIN smooth1 s USING (ticker, i) JOIN dx d USING (ticker, i) JOIN smooth2 t USING (ticker, i)),
ind2 AS (SELECT *, avg(close) OVER {last(50)} AS sma_50, avg(close) OVER {last(200)} AS sma_200, coalesce(avg(tr) OVER {last(14)}, 0) AS atr_14,
    avg(close) OVER {last(20)} AS bb_mean, coalesce(stddev_samp(close) OVER {last(20)}, 0) AS bb_std,
    avg(volume) OVER {last(20)} AS volume_avg, stddev_samp(volume) OVER {last(20)} AS vol_std,
    sum((high + low + close) / 3.0 * volume) OVER {last(20)} / nullif(sum(volume) OVER {last(20)}, 0) AS vwap0,
    sum(coalesce((2 * close - low - high) / nullif(high - low, 0), 0) * volume) OVER {last(20)} / nullif(sum(volume) OVER {last(20)}, 0) AS cmf0,
    max(high) OVER {last(250)} AS range_high, min(low) OVER {last(250)} AS range_low FROM ind1),
ind3 AS (SELECT *, bb_mean + 2 * bb_std AS bb_upper, bb_mean - 2 * bb_std AS bb_lower,
    coalesce((close - (bb_mean - 2 * bb_std)) / nullif(4 * bb_std, 0), 0.5) AS bb_percent_b,
    bb_mean + 2 * bb_std <= ema_20 + 1.5 * atr_14 AND bb_mean - 2 * bb_std >= ema_20 - 1.5 * atr_14 AS bb_kc_squeeze,
    coalesce(volume / nullif(volume_avg, 0), 1) AS volume_ratio, CASE WHEN vol_std > 1e-8 THEN (volume - volume_avg) / vol_std ELSE 0 END AS vol_z_score,
    coalesce(vwap0, close) AS vwap_20, coalesce(cmf0, 0) AS cmf_20,
    coalesce((close - pc) / pc * 100, 0) AS gap_pct,
    CASE WHEN range_high > range_low THEN (close - range_low) / (range_high - range_low) * 100 ELSE 50 END AS range_pos,
    coalesce(lag(sma_50) OVER ({W}), sma_50) AS prev_sma, coalesce(lag(macd_histogram) OVER ({W}), macd_histogram) AS prev_hist FROM ind2),
ind AS (SELECT x.*, coalesce(w.w_sma_50, sma_50) AS w_sma_50, coalesce(w.w_rsi, rsi_14) AS w_rsi,
    CASE WHEN close >= sma_50 AND rsi_14 >= 45 AND adx_14 >= 20 THEN 'Strong Bullish'
      WHEN close >= sma_50 AND rsi_14 >= 45 THEN 'Weak Bullish (Low Trend Strength)'
      WHEN close >= sma_50 * 0.95 THEN 'Weak Bullish' WHEN rsi_14 BETWEEN 40 AND 60 THEN 'Consolidation / Neutral'
      WHEN close < sma_50 AND rsi_14 < 40 AND adx_14 >= 20 THEN 'Strong Bearish'
      WHEN close < sma_50 AND rsi_14 < 40 THEN 'Weak Bearish (Low Trend Strength)' ELSE 'Weak Bearish' END AS trend_class
    FROM ind3 x JOIN wdaily w USING (ticker, date))"""

#: ``bars`` as the market scan takes them: the last 400 days, each ticker from its last gap over 25 days on if 15 bars remain.
UNIVERSE = BARS.replace("bars", "bars0") + f""",
back AS (SELECT * FROM bars0 WHERE date >= (SELECT max(date) FROM bars0) - 400),
back_gap AS (SELECT *, CASE WHEN date - lag(date) OVER ({W}) > 25 THEN date END AS cut FROM back),
back_cut AS (SELECT ticker, max(cut) AS start FROM back_gap GROUP BY 1),
back_left AS (SELECT ticker, start, count(*) AS remaining FROM back JOIN back_cut USING (ticker) WHERE start IS NULL OR date >= start GROUP BY 1, 2),
bars AS (SELECT back.* FROM back JOIN back_left USING (ticker) WHERE start IS NULL OR remaining < 15 OR date >= start)"""
#: Everything that ``ind`` needs.
ALL_INDICATORS = (BARS, NUMBERED, SMOOTH_1, SMOOTH_2, WEEKLY, INDICATORS)
LATEST = "latest AS (SELECT * FROM ind WHERE i = n_bars)"

#: Actions and gates of the rows in ``latest``.
ACTIONS = """
act AS (SELECT *, coalesce(pc, close) <= prev_sma AND close > sma_50 AS crossover, close > ema_20 AND rsi_14 >= 55 AS momentum, volume_avg >= 50000 AS liquid,
  close > w_sma_50 AND w_rsi >= 50 AS weekly_aligned FROM latest WHERE n_bars >= 15),
raw AS (SELECT *, CASE WHEN close <= sma_50 * 0.75 AND rsi_14 <= 28 THEN 'SELL / AVOID' WHEN range_pos >= 88 AND rsi_14 BETWEEN 58 AND 72 AND gap_pct >= 0.2 THEN 'STRONG BUY'
  WHEN crossover AND momentum AND gap_pct >= 0 THEN 'BREAKOUT BUY (X-OVER + MOMENTUM)' WHEN crossover AND gap_pct >= 0 THEN 'BREAKOUT BUY (X-OVER)'
  WHEN momentum AND gap_pct >= 0 THEN 'BREAKOUT BUY (MOMENTUM)' WHEN close < sma_50 * 0.97 AND rsi_14 <= 42 AND cmf_20 <= -0.05 THEN 'SELL / AVOID (TREND)'
  WHEN range_pos <= 20 OR rsi_14 <= 35 THEN 'BUY ON DIP' WHEN range_pos >= 45 AND rsi_14 >= 45 AND cmf_20 >= 0 AND (close >= ema_20 OR close >= sma_50) THEN 'ACCUMULATE'
  ELSE 'HOLD / NEUTRAL' END AS raw_action FROM act),
gate AS (SELECT *, raw_action = 'BUY ON DIP' AS dip, starts_with(raw_action, 'BREAKOUT') AS brk,
  adx_14 >= 22 AND (volume_ratio >= 1.6 OR vol_z_score >= 1.5) AS strong, close >= vwap_20 * 1.01 AS vwap_ok FROM raw),
conf AS (SELECT *, CASE WHEN raw_action = 'STRONG BUY' THEN strong AND vwap_ok WHEN brk THEN strong AND vwap_ok AND bb_kc_squeeze WHEN dip THEN weekly_aligned AND cmf_20 >= 0.15 ELSE true END AS confirmed,
  CASE WHEN raw_action = 'STRONG BUY' OR brk THEN concat_ws(', ', CASE WHEN NOT strong THEN 'low ADX/volume' END, CASE WHEN NOT vwap_ok THEN 'below VWAP' END, CASE WHEN brk AND NOT bb_kc_squeeze THEN 'no squeeze release' END)
    WHEN dip THEN concat_ws(', ', CASE WHEN NOT weekly_aligned THEN 'weekly trend not aligned' END, CASE WHEN cmf_20 < 0.15 THEN 'CMF below accumulation floor' END) ELSE '' END AS unmet,
  CASE raw_action WHEN 'SELL / AVOID' THEN -45.0 WHEN 'SELL / AVOID (TREND)' THEN -27.0 WHEN 'STRONG BUY' THEN 48.0 WHEN 'BREAKOUT BUY (X-OVER + MOMENTUM)' THEN 56.0 WHEN 'BREAKOUT BUY (X-OVER)' THEN 32.0
    WHEN 'BREAKOUT BUY (MOMENTUM)' THEN 24.0 WHEN 'BUY ON DIP' THEN 30.0 WHEN 'ACCUMULATE' THEN 10.0 ELSE 0.0 END AS base,
  CASE WHEN raw_action IN ('STRONG BUY', 'ACCUMULATE', 'BUY ON DIP') OR brk THEN CASE WHEN cmf_20 >= 0.15 THEN 12.0 ELSE 0.0 END + CASE WHEN bb_kc_squeeze THEN 8.0 ELSE 0.0 END ELSE 0.0 END AS extras FROM gate)"""


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)
