"""Queries of positions and market state."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import portfolio as P
from ..sources.views import BARS, INDEX_BARS, SECTOR_INDEX_BARS, bars, index_bars, sector_index_bars, table
from . import query
from .indicators import REGIME_SQL, rounded
from .market import MATRIX_BASE, matrix_of
from .sqltext import ctes, rnds
from .stats import LEDGER_BASE, closed_of

OWNED = "owned AS (SELECT 'S' || (c_custkey % 130) AS ticker, 90 + c_custkey % 40 * 1.0 AS buy_price, 10 + c_custkey % 5 AS shares, DATE '1998-01-01' + CAST(c_custkey % 700 AS integer) AS purchase_date, c_custkey FROM customer)"


def owned(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(
        F.concat(F.lit("S"), (k % 130).cast("string")).alias("ticker"), (90 + k % 40 * 1.0).alias("buy_price"), (10 + k % 5).alias("shares"), F.date_add(F.lit("1998-01-01").cast("date"), (k % 700).cast("int")).alias("purchase_date"), k,
    )


@query("D9_D10_positions_and_targets", ctes(BARS, OWNED, "nowp AS (SELECT ticker, arg_max(close, date) AS close FROM bars GROUP BY 1)") + f"""
SELECT c_custkey, ticker, close IS NOT NULL AS has_data, {rnds(4, 'coalesce(close, buy_price) * shares AS value', 'buy_price + 500.0 / shares AS target_price', '(500.0 / shares) / buy_price * 100 AS target_pct')} FROM owned LEFT JOIN nowp USING (ticker)""")
def d9(spark, d):
    from ..operators import indicators as I

    pos = P.positions_to_latest(owned(spark, d), I.latest(bars(spark, d)))
    targets = owned(spark, d).select("ticker").distinct().select("ticker", F.lit("AMOUNT").alias("target_mode"), F.lit(500.0).alias("target_value"))
    df = P.with_targets(pos, targets)
    return df.select("c_custkey", "ticker", "has_data", *rounded(df, 4, "value", "target_price", "target_pct"))


@query("K4_exits", MATRIX_BASE + f""", {OWNED},
k AS (SELECT c_custkey, ticker, buy_price, shares, purchase_date, n_bars, vwap_20, coalesce(close, buy_price) AS price, n_bars IS NOT NULL AS long, CASE WHEN atr_14 > 0 THEN atr_14 ELSE coalesce(close, buy_price) * 0.02 END AS atr FROM owned LEFT JOIN scored USING (ticker)),
p AS (SELECT o.ticker, o.purchase_date, max(close) AS peak FROM (SELECT DISTINCT ticker, purchase_date FROM owned) o JOIN bars0 b ON b.ticker = o.ticker AND b.date >= o.purchase_date GROUP BY 1, 2),
v AS (SELECT k.*, coalesce(peak, greatest(buy_price, price)) AS peak, (price / buy_price - 1) * 100 AS pnl_pct, CASE WHEN long THEN price - 2 * atr ELSE price * 0.95 END AS stop, price * (1 + CASE WHEN long THEN coalesce(atr * 2.5 / price, 0.03) ELSE 0.05 END + 0.007) AS tp FROM k LEFT JOIN p USING (ticker, purchase_date))
SELECT c_custkey, ticker, CAST(DATE '2002-01-01' - purchase_date AS integer) AS days, {rnds(4, 'price', 'stop', 'pnl_pct', '(price / peak - 1) * 100 AS drawdown_pct', '(price - buy_price) * shares - (price + buy_price) * shares * 0.0035 AS net_pnl')},
CASE WHEN price * 1.007 >= buy_price THEN 0 ELSE CAST(ceil(shares * (buy_price - price * 1.007) / (price * 1.007 - price) - 1e-9) AS bigint) END AS breakeven_shares,
CASE WHEN NOT long THEN 'HOLD' WHEN pnl_pct <= -8 OR (price < coalesce(vwap_20, price) * 0.92 AND pnl_pct < 0) THEN 'CUT LOSS' WHEN price >= tp THEN 'TAKE PROFIT' ELSE 'HOLD' END AS action FROM v""")
def k4(spark, d):
    out = P.exits(owned(spark, d), bars(spark, d), matrix_of(spark, d), "2002-01-01")
    return out.select("c_custkey", "ticker", "days", *rounded(out, 4, "price", "stop", "pnl_pct", "drawdown_pct", "net_pnl"), "breakeven_shares", "action")


@query("K5_market_state", ctes(INDEX_BARS, SECTOR_INDEX_BARS, REGIME_SQL.replace("FROM index_bars", "FROM (SELECT * FROM index_bars UNION ALL SELECT * FROM sector_index_bars)")) + """
, p AS (SELECT a.date, a.close AS a, b.close AS b FROM sector_index_bars a JOIN sector_index_bars b USING (date) WHERE a.ticker = '.N1' AND b.ticker = '.N2'),
q AS (SELECT date, CASE WHEN count(*) OVER s = 50 THEN CASE WHEN avg(a / b) OVER f > avg(a / b) OVER s THEN 'a' WHEN avg(a / b) OVER f < avg(a / b) OVER s THEN 'b' ELSE 'flat' END END AS turn FROM p
  WINDOW f AS (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), s AS (ORDER BY date ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)),
turns AS (SELECT date, lag(turn) OVER (ORDER BY date) AS turn FROM q),
l AS (SELECT 'a' AS ticker, date, a AS close FROM p UNION ALL SELECT 'b', date, b FROM p),
k AS (SELECT *, close >= coalesce(max(close) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), close) AND close >= coalesce(max(close) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING), close) AS peak FROM l),
r AS (SELECT ticker, close, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS r FROM k WHERE peak),
v AS (SELECT max(close) FILTER (WHERE ticker = 'a' AND r = 1) - max(close) FILTER (WHERE ticker = 'a' AND r = 2) AS a, max(close) FILTER (WHERE ticker = 'b' AND r = 1) - max(close) FILTER (WHERE ticker = 'b' AND r = 2) AS b FROM r)
SELECT ticker AS name, arg_max(regime, date) AS state, max(date) AS date FROM regimes GROUP BY 1
UNION ALL (SELECT 'rotation', turn, date FROM turns ORDER BY date DESC LIMIT 1)
UNION ALL SELECT 'divergence', CASE WHEN (SELECT count(*) FROM p) < 60 THEN 'unavailable' WHEN a > 0 AND b < 0 THEN 'bearish' WHEN a < 0 AND b > 0 THEN 'bullish' ELSE 'none' END, (SELECT max(date) FROM regimes) FROM v""")
def k5(spark, d):
    return P.market_state(index_bars(spark, d), sector_index_bars(spark, d), (".N1", ".N2"))


@query("G8_top_mover", MATRIX_BASE + f"SELECT arg_max(ticker, {{'s': score, 't': ticker}}) AS ticker, {rnds(4, 'max(score) AS score')} FROM scored WHERE contains(raw_action, 'BUY')")
def g8(spark, d):
    df = P.top_mover(matrix_of(spark, d))
    return df.select("ticker", *rounded(df, 4, "score"))


@query("I14_I15_notes", MATRIX_BASE + """SELECT ticker, concat_ws(' | ', raw_action, 'trend=' || trend_class, CASE WHEN starts_with(raw_action, 'HOLD') THEN 'no decisive edge' WHEN confirmed THEN 'confirmed' ELSE 'awaiting confirmation' END,
CASE WHEN weekly_aligned THEN 'weekly aligned' END, CASE WHEN bb_kc_squeeze AND NOT starts_with(raw_action, 'HOLD') THEN 'volatility squeeze' END, CASE WHEN cmf_20 > 0 AND NOT starts_with(raw_action, 'HOLD') THEN 'positive money flow' END) AS reason,
volume_ratio >= 1 AS busy, CASE WHEN contains(raw_action, 'BUY') OR contains(raw_action, 'ACCUMULATE') THEN 'Diverges from external consensus (-1.5/2, bearish)' END AS note FROM scored""")
def i14(spark, d):
    reason = P.signal_reason()
    # the last part holds a rounded number, which engines print differently on ties
    return matrix_of(spark, d).select("ticker", F.regexp_replace(reason, r" \| vol x[0-9.]+$", "").alias("reason"), reason.contains(" | vol x").alias("busy"), P.divergence_note(F.col("raw_action"), F.lit(-1.5)).alias("note"))


@query("C3_C12_filters", LEDGER_BASE + "SELECT ticker, count(*) AS n FROM closed WHERE ticker IN ('S1', 'S2') AND shares <> 5 GROUP BY 1")
def c3(spark, d):
    rows = closed_of(spark, d).withColumn("is_demo", F.col("shares") == 5)
    return P.without_demo(P.ticker_filter(rows, ["s1", "S2.CA"])).groupBy("ticker").agg(F.count("*").alias("n"))
