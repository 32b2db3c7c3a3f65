"""Queries of feeds, shards, logs, account reports and alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import indicators as I
from ..operators import stats as S
from ..operators import structure as T
from ..plans import charts
from ..plans import market as M
from ..plans import picks as P
from ..plans import portfolio as O
from ..shared import shared_dir
from ..sources import ingest
from ..sources.views import BARS, SECTOR_INDEX_BARS, SECTOR_MAP, bars, index_bars, rnd, sector_index_bars, sector_map, sql_rnd, table
from ..streaming import jobs
from . import SQL, query
from .indicators import REGIME_SQL, rounded
from .jobs import AS_OF, NOW, PICKS, picks_of, prices_of
from .market import MATRIX_BASE, SECTOR_BASE, SECTORS, matrix_of, rows_of
from .sqltext import W, ctes, last, rnds
from .stats import LEDGER_BASE, closed_of, held_of, ledger_of

# --- feeds -----------------------------------------------------------------------------------

LATE = "2010-01-01"  # behind every bar, so that no date is rejected as lying in the future
HEADER = ["Date", "Ticker", "Open", "High", "Low", "Close", "Volume"]


def _as_feed(df):
    """Bars with the header of a feed; in group 3 no row has a close, in group 0 the 13th of a month has no date."""
    group = F.substring("ticker", 2, 20).cast("long") % 4
    day = F.when((group == 0) & (F.dayofmonth("date") == 13), "").otherwise(F.date_format("date", "yyyy-MM-dd"))
    close = F.when(group == 3, F.lit("-")).otherwise(F.col("close").cast("string"))
    return df.select(day.alias("Date"), F.col("ticker").alias("Ticker"), *[F.col(c).alias(c.title()) for c in ("open", "high", "low")], close.alias("Close"), F.col("volume").alias("Volume"), group.alias("part"))


def _feed(spark, d):
    folder = shared_dir(spark, "feed")
    _as_feed(bars(spark, d)).hint("rebalance", "part").write.partitionBy("part").option("header", True).csv(folder)
    return folder


FED = "fed AS (SELECT *, CAST(substr(ticker, 2) AS bigint) % 4 AS part, CAST(substr(ticker, 2) AS bigint) % 4 <> 3 AND NOT (CAST(substr(ticker, 2) AS bigint) % 4 = 0 AND day(date) = 13) AS valid FROM bars)"
AS_FED = "CASE WHEN length(ticker) <= 6 THEN ticker || '.CA' ELSE ticker END AS ticker, date, open, high, low, close, volume"


@query("A1_A10_csv_feed", ctes(BARS, FED) + f"SELECT {AS_FED} FROM fed WHERE valid")
def a1(spark, d):
    good, _ = ingest.split_valid(ingest.read_feed(spark, [f"{_feed(spark, d)}/part=*/*.csv"], LATE))
    stored = good.select("date", "ticker", "open", "high", "low", "close", "volume")
    return ingest.upsert(stored.limit(0), good, ["ticker", "date"], ["_file_time", "_file"])


@query("A4_A13_tracker_and_quarantine", ctes(BARS, FED) + """SELECT CAST(part AS varchar) AS part, CASE WHEN count(*) FILTER (WHERE valid) > 0 THEN 'read' ELSE 'no valid row' END AS outcome, part = 3 AS found_again,
count(*) FILTER (WHERE part <> 3 AND NOT valid) AS no_date, count(*) FILTER (WHERE part = 3) AS no_close FROM fed GROUP BY 1, part""")
def a13(spark, d):
    folder = _feed(spark, d)
    tracker = spark.createDataFrame([], "file_path string, last_modified timestamp, file_hash string")
    found = ingest.discover(spark, folder, tracker)
    rows = ingest.read_feed(spark, [f"{folder}/part=*/*.csv"], LATE)
    read, failed = ingest.file_outcomes(found, rows)
    tracker = ingest.track(tracker, read)
    part = lambda c: F.regexp_extract(c, r"part=(\d+)", 1).alias("part")
    again = ingest.discover(spark, folder, tracker).groupBy(part("path")).agg(F.count("*").alias("_n"))  # only the files that failed are found again
    files = tracker.select(part("file_path"), F.lit("read").alias("outcome")).unionByName(failed.select(part("file_path"), F.col("error_message").alias("outcome"))).distinct()
    _, bad = ingest.split_valid(rows)
    faults = bad.groupBy(part("_file")).agg(F.count_if(F.col("error_message") == "no valid date").alias("no_date"), F.count_if(F.col("error_message") == "no valid close").alias("no_close"))
    out = files.join(faults, "part", "left").join(again, "part", "left").fillna(0, ["no_date", "no_close", "_n"])
    return out.select("part", "outcome", "no_date", "no_close", (F.col("_n") > 0).alias("found_again"))


@query("L1_L3_ingest_stream", ctes(BARS, FED) + f"SELECT {AS_FED} FROM fed WHERE valid")
def l1(spark, d):
    feed, out = shared_dir(spark, "l1-in"), shared_dir(spark, "l1-out")
    rows = _as_feed(bars(spark, d)).withColumn("half", F.when(F.substring("Date", 1, 4) < "1998", 0).otherwise(1))
    for half in (0, 1):  # two runs, the second of which finds the first one's table
        rows.where(F.col("half") == half).select(*HEADER).write.mode("append").option("header", True).csv(feed)
        jobs.start_ingest(spark, feed, HEADER, LATE, out, f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/bars").select("ticker", "date", "open", "high", "low", "close", "volume")


@query("A6_A7_B13_vendor_history", ctes(BARS) + """SELECT ticker, date, open, high, low, close, CAST(round_even(volume / 1000, 0) AS bigint) * 1000.0 AS volume FROM bars WHERE CAST(substr(ticker, 2) AS bigint) % 7 <> 0 AND day(date) <> 31""")
def a6(spark, d):
    k = F.substring("ticker", 2, 20).cast("long")
    two = F.when((k % 7 == 0) & (F.dayofmonth("date") % 2 == 0), F.lit(" copy")).otherwise(F.lit(""))  # two files claim every seventh ticker
    day = F.when(F.dayofmonth("date") == 31, F.lit("2/31/1999")).otherwise(F.date_format("date", "M/d/yyyy"))
    raw = bars(spark, d).select(
        F.concat(F.lit("/in/Firm_"), "ticker", two, F.lit(" Stock Price History (1).csv")).alias("_file"), day.alias("Date"), F.col("close").cast("string").alias("Price"),
        *[F.col(c).cast("string").alias(c.title()) for c in ("open", "high", "low")], F.concat(F.bround(F.col("volume") / 1000, 0).cast("long").cast("string"), F.lit("K")).alias("Vol."),
    )
    keys = sector_map(spark, d).select("ticker", F.explode(F.array(F.lit(""), F.lit(" copy"))).alias("tail"))
    names = keys.select(F.concat(F.lit("firm "), F.lower("ticker"), "tail").alias("filename"), "ticker")
    return ingest.normalise_history(raw, names)


@query("A3_enrichment", """SELECT ticker, cap, pe, consensus FROM (SELECT 'S' || o_orderkey AS ticker, CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice END AS cap, CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_custkey AS double) END AS pe,
CASE o_orderpriority WHEN '1-URGENT' THEN 2.0 WHEN '2-HIGH' THEN 1.0 WHEN '3-MEDIUM' THEN 0.0 WHEN '4-NOT SPECIFIED' THEN -2.0 END AS consensus FROM orders) WHERE cap IS NOT NULL OR pe IS NOT NULL OR consensus IS NOT NULL""")
def a3(spark, d):
    k, p = F.col("o_orderkey"), F.col("o_orderpriority")
    raw = table(spark, d, "orders").select(
        F.concat(F.lit("S"), k.cast("string")).alias("ticker"), F.when(k % 3 == 0, "-").otherwise(F.col("o_totalprice").cast("string")).alias("cap"), F.when(k % 5 == 0, "N/A").otherwise(F.format_number(F.col("o_custkey"), 0)).alias("pe"),
        F.when(p == "1-URGENT", "Strong Buy").when(p == "2-HIGH", "Buy").when(p == "3-MEDIUM", "Neutral").when(p == "4-NOT SPECIFIED", "Strong Sell").otherwise("?").alias("rating"),
    )
    return ingest.enrichment(raw, ["cap", "pe"], ["rating"]).select("ticker", "cap", "pe", "consensus")


@query("E26_file_coverage", ctes(BARS) + "SELECT ticker || '.csv' AS _file, count(*) FILTER (WHERE k > 0) AS rows, min(date) FILTER (WHERE k > 0) AS first_date, max(date) FILTER (WHERE k > 0) AS last_date, count(*) FILTER (WHERE k > 0 AND year(date) < 1997) AS before FROM (SELECT *, CAST(substr(ticker, 2) AS bigint) % 10 AS k FROM bars) GROUP BY 1")
def e26(spark, d):
    empty = F.substring("ticker", 2, 20).cast("long") % 10 == 0  # files whose rows have no date
    return O.file_coverage(bars(spark, d).select(F.concat("ticker", F.lit(".csv")).alias("_file"), F.when(~empty, F.col("date")).alias("date")), 1997)


@query("E25_coverage_extremes", ctes(BARS) + """, c AS (SELECT ticker, count(*) AS bars FROM bars GROUP BY 1)
(SELECT 'worst' AS side, * FROM c ORDER BY bars, ticker LIMIT 10) UNION ALL (SELECT 'best', * FROM c ORDER BY bars DESC, ticker LIMIT 10)""")
def e25x(spark, d):
    return S.coverage_extremes(S.bar_coverage(bars(spark, d))).select("side", "ticker", "bars")


# --- shards and logs -------------------------------------------------------------------------


@query("A14_A20_topics", ctes(BARS, SECTOR_MAP) + "SELECT 'bars' AS topic, count(*) AS rows, 'ticker,date,close' AS columns, 0 AS faults FROM bars UNION ALL SELECT 'sectors', count(*), 'ticker,sector', 0 FROM sector_map")
def a14(spark, d):
    folder = shared_dir(spark, "topics")
    ingest.write_topics({"bars": bars(spark, d).select("ticker", "date", "close", F.lit(1.0).alias("cash")), "sectors": sector_map(spark, d)}, folder)
    faults = ingest.validate_topics(spark, folder, {"bars": ["ticker", "date", "close"], "sectors": ["sector"]})
    return spark.read.json(f"{folder}/manifest").select("topic", "rows", "columns", F.lit(len(faults)).alias("faults"))


#: The charts' numbers: last value weighted by volume, nearest zones or the range of 250 bars, pivot, patterns.
CHART = f"""WITH zones AS ({SQL['F26_support_resistance']}), piv AS ({SQL['F27_pivot_points']}), pats AS ({SQL['J14_H6_M1_detect_all']}),
{BARS},
v AS (SELECT *, coalesce(sum((high + low + close) / 3.0 * volume) OVER {last(20)} / nullif(sum(volume) OVER {last(20)}, 0), close) AS vwap_20, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS r FROM bars),
c AS (SELECT ticker, list(date ORDER BY date) FILTER (WHERE r <= 365) AS dates, list(close ORDER BY date) FILTER (WHERE r <= 365) AS closes, list({sql_rnd('vwap_20', 4)} ORDER BY date) FILTER (WHERE r <= 365) AS vwaps,
  max(high) FILTER (WHERE r <= 250) AS top, min(low) FILTER (WHERE r <= 250) AS bottom FROM v GROUP BY 1 HAVING count(*) >= 2),
z AS (SELECT ticker, max(level) FILTER (WHERE side = 'resistance') AS res, max(level) FILTER (WHERE side = 'support') AS sup FROM zones WHERE rank = 1 GROUP BY 1),
n AS (SELECT ticker, count(*) AS patterns FROM (SELECT DISTINCT ticker, pattern, start_index, end_index FROM pats) GROUP BY 1)
"""


@query("A16_stock_charts", CHART + f"SELECT c.ticker, dates, closes, vwaps, {rnds(4, 'coalesce(res, top) AS resistance', 'coalesce(sup, bottom) AS support', 'pp AS pivot')}, coalesce(patterns, 0) AS patterns FROM c LEFT JOIN z USING (ticker) LEFT JOIN piv USING (ticker) LEFT JOIN n USING (ticker)")
def a16s(spark, d):
    df = charts.stock_charts(bars(spark, d)).withColumn("pivot", F.col("pivots.pp"))
    return df.select("ticker", "dates", "closes", "vwaps", *rounded(df, 4, "resistance", "support", "pivot"), F.size("patterns").cast("long").alias("patterns"))


@query("A16_sector_charts", f"""WITH i AS ({SQL['D21_F37_sector_index']}) SELECT sector, list(date ORDER BY date) AS dates, list({sql_rnd('index', 2)} ORDER BY date) AS closes
FROM (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY sector ORDER BY date DESC) <= 365) GROUP BY 1""")
def a16x(spark, d):
    index = M.sector_index(bars(spark, d), sector_map(spark, d))
    return charts.sector_charts(index.withColumn("index", rnd(F.col("index"), 5)))


@query("A15_ticker_shards", MATRIX_BASE + f""", c0 AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS r FROM bars0)
SELECT c.ticker, sector, last_data_date, raw_action, bars, {rnds(3, 'score')} FROM (SELECT ticker, CAST(max(date) AS varchar) AS last_data_date, count(*) FILTER (WHERE r <= 365) AS bars FROM c0 GROUP BY 1 HAVING count(*) >= 2) c
LEFT JOIN (SELECT ticker, raw_action, score FROM scored) USING (ticker) LEFT JOIN sector_map USING (ticker)""")
def a15(spark, d):
    folder = shared_dir(spark, "tickers")
    b, sectors = bars(spark, d), sector_map(spark, d)
    ingest.write_per_key(charts.ticker_shards(charts.stock_charts(b), matrix_of(spark, d), sectors), "ticker", folder)
    schema = "sector string, last_data_date string, matrix struct<raw_action: string, score: double>, chart_history struct<dates: array<string>>"
    df = ingest.read_per_key(spark, folder, "ticker", schema)
    df = df.select("ticker", "sector", "last_data_date", "matrix.raw_action", F.size("chart_history.dates").cast("long").alias("bars"), F.col("matrix.score").alias("score"))
    return df.select("ticker", "sector", "last_data_date", "raw_action", "bars", *rounded(df, 3, "score"))


@query("A21_run_history", LEDGER_BASE + f"""SELECT year(trade_date) AS run_id, count(*) AS trades, {rnds(2, 'sum((sell_price - buy_price) * shares) AS net')}, min(ticker) AS first_ticker FROM closed GROUP BY 1 ORDER BY 1 DESC LIMIT 3""")
def a21(spark, d):
    folder, closed = shared_dir(spark, "runs"), closed_of(spark, d)
    years = [r[0] for r in closed.select(F.year("trade_date")).distinct().collect()]  # one number a year
    for year in years:
        one = closed.where(F.year("trade_date") == year)
        summary = S.ledger_summary(one).select("trades", "net", F.lit(year).alias("run_at"))
        ingest.save_run(summary, one, year, folder)
    newest = ingest.saved_runs(spark, folder, 3)
    ids = [r["id"] for r in newest.select("id").collect()]  # three numbers
    parts = [ingest.saved_run(spark, folder, i).agg(F.lit(i).alias("run_id"), F.min("ticker").alias("first_ticker")) for i in ids]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = newest.withColumnRenamed("id", "run_id").join(out, "run_id")
    return out.select(F.col("run_id").cast("long").alias("run_id"), "trades", *rounded(out, 2, "net"), "first_ticker")


@query("A22_snapshot_log", ctes(BARS) + f"SELECT ticker, date AS session_date, CASE WHEN day(date) > 20 THEN -close ELSE close END AS score FROM bars WHERE date >= DATE '{AS_OF}'")
def a22(spark, d):
    rows = bars(spark, d).select("ticker", F.col("date").alias("session_date"), F.col("close").alias("score"))
    late = F.dayofmonth("session_date") > 20  # these are logged again, with another score
    new = rows.where(late).select("ticker", "session_date", (-F.col("score")).alias("score"), F.lit(1).alias("run"))
    return ingest.snapshots_since(ingest.upsert(rows, new, ["ticker", "session_date"], ["run"]), AS_OF)


# --- account and market ----------------------------------------------------------------------


@query("E19_risk_allocations", LEDGER_BASE + f"""
, e AS (SELECT sum(value) + 50000.0 AS equity, count(DISTINCT ticker) AS held FROM held),
s AS (SELECT 'sector' AS kind, sector AS name, sum(value) AS value FROM held GROUP BY 2 UNION ALL SELECT 'position', ticker, sum(value) FROM held GROUP BY 2),
a AS (SELECT kind, name, value, value / equity * 100 AS pct, held >= 2 AND row_number() OVER (PARTITION BY kind ORDER BY value DESC, name) = 1 AND value / equity * 100 >= CASE kind WHEN 'sector' THEN 35 ELSE 25 END AS warning FROM s, e
  UNION ALL SELECT 'cash', 'cash', 50000.0, 50000.0 / equity * 100, 50000.0 / equity * 100 < 5 FROM e)
SELECT kind, name, warning, {rnds(2, 'value')}, {rnds(4, 'pct AS pct_of_equity', "CASE WHEN kind = 'position' THEN pct END AS risk_multiple")} FROM a""")
def e19x(spark, d):
    df = S.risk_allocations(held_of(spark, d), 50_000.0)
    return df.select("kind", "name", "warning", *rounded(df, 2, "value"), *rounded(df, 4, "pct_of_equity", "risk_multiple"))


@query("E22_account_total", LEDGER_BASE + f"""
, h AS (SELECT *, value - cost AS pnl FROM held), n AS (SELECT sum(shares) AS shares FROM ledger WHERE side = 'BUY' AND ticker IN (SELECT ticker FROM held)),
a AS (SELECT count(*) AS positions, sum(cost) AS cost, sum(value) AS value, sum(pnl) AS pnl, avg(days_held) AS avg_days, count(*) FILTER (WHERE pnl > 0) AS winners, count(*) FILTER (WHERE pnl < 0) AS losers, count(*) FILTER (WHERE pnl = 0) AS flat,
  arg_max(ticker, pnl) AS best, arg_min(ticker, pnl) AS worst, greatest(-min(pnl), 0) / sum(-pnl) FILTER (WHERE pnl < 0) * 100 AS loss_share, greatest(max(pnl), 0) / sum(pnl) FILTER (WHERE pnl > 0) * 100 AS gain_share FROM h),
r AS (SELECT sum((sell_price - buy_price) * shares) AS realised FROM closed)
SELECT positions, shares, winners, losers, flat, best, worst, CASE WHEN loss_share >= 50 THEN worst || ' drives losses' WHEN gain_share >= 50 THEN best || ' drives gains' END AS driver,
{rnds(2, 'cost', 'value', 'pnl', 'avg_days', 'pnl / cost * 100 AS pnl_pct', 'loss_share', 'gain_share', 'realised', 'pnl + realised AS total_pnl')} FROM a, n, r""")
def e22x(spark, d):
    shares = ledger_of(spark, d).where("side = 'BUY'").groupBy("ticker").agg(F.sum("shares").alias("shares"))
    df = S.account_total(held_of(spark, d).join(shares, "ticker"), closed_of(spark, d))
    return df.select("positions", "shares", "winners", "losers", "flat", "best", "worst", "driver", *rounded(df, 2, "cost", "value", "pnl", "avg_days", "pnl_pct", "loss_share", "gain_share", "realised", "total_pnl"))


@query("E24_usage_report", f"""WITH u AS (SELECT CAST(user_id AS varchar) AS user, count(*) AS sessions, sum(CAST(floor(value) AS bigint)) AS total_seconds FROM events WHERE event_type <> 'error' GROUP BY 1),
t AS (SELECT CAST(o_custkey AS varchar) AS user, count(*) AS trade_count, sum(o_totalprice) AS trade_value FROM orders GROUP BY 1)
SELECT u.user, sessions, total_seconds, coalesce(trade_count, 0) AS trade_count, {rnds(1, 'coalesce(trade_value, 0) AS trade_value')} FROM u LEFT JOIN t ON u.user = t.user""")
def e24x(spark, d):
    e = table(spark, d, "events")
    start = F.date_trunc("second", "ts")
    rows = e.select(
        F.col("user_id").cast("string").alias("uid"), F.lit(None).cast("string").alias("email"), F.lit("web").alias("source"),
        F.when(F.col("event_type") != "error", start).alias("start"), F.timestamp_seconds(F.unix_timestamp(start) + F.floor("value")).alias("last_seen"),
    )
    stats = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("uid"), F.lit(1).alias("trade_count"), F.col("o_totalprice").alias("trade_value"), F.lit(0.0).alias("portfolio_value"))
    df = S.usage_report(rows, stats)
    return df.select("user", "sessions", "total_seconds", "trade_count", *rounded(df, 1, "trade_value"))


@query("E4_weekly_report", ctes(*SECTOR_BASE, SECTORS, SECTOR_INDEX_BARS, REGIME_SQL.replace("index_bars", "sector_index_bars")) + f"""
, r AS (SELECT ticker, ret_5, row_number() OVER (ORDER BY ret_5 DESC, ticker) AS a, row_number() OVER (ORDER BY ret_5, ticker) AS b FROM sector_rows WHERE n_bars >= 6),
q AS (SELECT sector, ret_5d, row_number() OVER (ORDER BY ret_5d DESC, sector) AS a, row_number() OVER (ORDER BY ret_5d, sector) AS b FROM sectors),
x AS (SELECT 'top' AS kind, ticker AS name, ret_5 AS pct, NULL AS state FROM r WHERE a <= 3 UNION ALL SELECT 'bottom', ticker, ret_5, NULL FROM r WHERE b <= 3
  UNION ALL SELECT 'best_sector', sector, ret_5d, NULL FROM q WHERE a = 1 UNION ALL SELECT 'worst_sector', sector, ret_5d, NULL FROM q WHERE b = 1
  UNION ALL SELECT 'index', ticker, NULL, arg_max(regime, date) FROM regimes GROUP BY ticker)
SELECT kind, name, state, {rnds(6, 'pct')} FROM x""")
def e4x(spark, d):
    rows = rows_of(spark, d)
    df = M.weekly_report(rows, M.sector_analytics(rows), I.latest(I.regime_series(sector_index_bars(spark, d))))
    return df.select("kind", "name", "state", *rounded(df, 6, "pct"))


@query("D10_with_enrichment", LEDGER_BASE + ", e AS (SELECT 'S' || (o_orderkey % 60) AS ticker, o_custkey AS pe FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderkey % 60 ORDER BY o_orderkey DESC) = 1) SELECT ticker, sector, pe FROM held LEFT JOIN e USING (ticker)")
def d10(spark, d):
    k = F.col("o_orderkey")
    latest = table(spark, d, "orders").select(F.concat(F.lit("S"), (k % 60).cast("string")).alias("ticker"), k.alias("date"), F.col("o_custkey").alias("pe"))
    return O.with_enrichment(held_of(spark, d), latest).select("ticker", "sector", "pe")


# --- picks and alerts ------------------------------------------------------------------------


@query("G12_closed_and_active", ctes(PICKS) + ", o AS (SELECT *, row_number() OVER (ORDER BY achieved_date DESC, id DESC) AS r FROM picks WHERE status = 'achieved') SELECT 'closed' AS kind, id FROM o WHERE r <= 50 UNION ALL SELECT 'active', id FROM picks WHERE status = 'active' AND horizon = 'short'")
def g12x(spark, d):
    p = picks_of(spark, d)
    closed = ingest.recent(p.where("status = 'achieved'"), "achieved_date", 50).select(F.lit("closed").alias("kind"), "id")
    return closed.unionByName(ingest.recent(p.where("status = 'active' and horizon = 'short'"), "pick_date").select(F.lit("active").alias("kind"), "id"))


NEAR = "abs(b.close - {p}) <= greatest({p} * 0.5 / 100, 1e-9)"


@query("K15_repair_future_picks", ctes(BARS, PICKS) + f"""
, x AS (SELECT *, ref_price + id % 7 AS achieved_price FROM picks),
m1 AS (SELECT x.id, b.date, CASE WHEN achieved_date <= DATE '{AS_OF}' THEN achieved_date END AS anchor FROM bars b JOIN x USING (ticker) WHERE x.pick_date > DATE '{AS_OF}' AND b.date <= DATE '{AS_OF}' AND {NEAR.format(p='x.ref_price')}),
c1 AS (SELECT id, CASE WHEN count(DISTINCT date) = 1 THEN min(date) ELSE max(date) FILTER (WHERE date <= anchor) END AS chosen FROM m1 GROUP BY 1),
y AS (SELECT x.* REPLACE (coalesce(chosen, pick_date) AS pick_date), CASE WHEN x.pick_date <= DATE '{AS_OF}' THEN 'kept' WHEN chosen IS NULL THEN 'review' ELSE 'repaired' END AS pick_action FROM x LEFT JOIN c1 USING (id)),
m2 AS (SELECT y.id, b.date, CASE WHEN pick_date <= DATE '{AS_OF}' THEN pick_date END AS anchor FROM bars b JOIN y USING (ticker) WHERE y.achieved_date > DATE '{AS_OF}' AND b.date <= DATE '{AS_OF}' AND {NEAR.format(p='y.achieved_price')}),
c2 AS (SELECT id, CASE WHEN count(DISTINCT date) = 1 THEN min(date) ELSE min(date) FILTER (WHERE date >= anchor) END AS chosen FROM m2 GROUP BY 1)
SELECT id, pick_date, coalesce(chosen, achieved_date) AS achieved_date, pick_action, CASE WHEN achieved_date > DATE '{AS_OF}' THEN CASE WHEN chosen IS NULL THEN 'review' ELSE 'repaired' END ELSE 'kept' END AS achieved_action FROM y LEFT JOIN c2 USING (id)""")
def k15x(spark, d):
    picks = picks_of(spark, d).withColumn("achieved_price", F.col("ref_price") + F.col("id") % 7)
    return P.repair_future_picks(picks, bars(spark, d), AS_OF).select("id", "pick_date", "achieved_date", "pick_action", "achieved_action")


@query("D3_match_review", f"""WITH m AS ({SQL['B12_D2_fuzzy_name_match']}) SELECT CAST(p_partkey AS varchar) AS key, CASE WHEN matched THEN 'matched' ELSE 'review' END AS kind, right_key, {rnds(6, 'm.ratio AS ratio')} FROM part LEFT JOIN m ON left_key = CAST(p_partkey AS varchar)""")
def d3(spark, d):
    part = table(spark, d, "part")
    a = part.select(F.col("p_partkey").cast("string").alias("key"), F.concat_ws(" ", "p_name", "p_type").alias("name"))
    b = part.select(F.col("p_name").alias("key"), F.col("p_name").alias("name")).distinct()
    good, review = P.review_split(a, P.fuzzy_match(a, b))
    df = good.withColumn("kind", F.lit("matched")).unionByName(review.withColumn("kind", F.lit("review")))
    return df.select("key", "kind", "right_key", *rounded(df, 6, "ratio"))


@query("K18_alert_events", f"""WITH exposed AS ({SQL['E19_risk_allocations']}), apart AS ({SQL['K5_market_state']}), done AS ({SQL['K10_mark_achieved']}), {PICKS},
high AS (SELECT ticker FROM ({SQL['K3_G3_watchlist']}) WHERE tier = 'High Confidence')
SELECT 'pick_achieved' AS kind, 'pick_achieved:' || ticker || ':' || horizon AS alert_key, DATE '{AS_OF}' AS event_date, count(*) AS n FROM done JOIN picks USING (id) WHERE done.status = 'achieved' AND picks.status = 'active' GROUP BY 2
UNION ALL SELECT 'concentration', 'concentration:' || name, DATE '{AS_OF}', count(*) FROM exposed WHERE kind = 'sector' AND warning GROUP BY 2
UNION ALL SELECT 'pre_breakout', 'pre_breakout:' || ticker, DATE '{AS_OF}', count(*) FROM high GROUP BY 2
UNION ALL SELECT 'divergence', 'divergence:' || state, DATE '{AS_OF}', count(*) FROM apart WHERE name = 'divergence' AND state IN ('bullish', 'bearish') GROUP BY 2""")
def k18(spark, d):
    from . import QUERIES

    active = picks_of(spark, d).where("status = 'active'")
    achieved = P.mark_achieved(active, prices_of(spark, d), AS_OF).where("status = 'achieved'")
    exposed = S.risk_allocations(held_of(spark, d), 50_000.0).where("kind = 'sector'").select(F.col("name").alias("sector"), "pct_of_equity", F.col("warning").alias("sector_warning"))
    state = O.market_state(index_bars(spark, d), sector_index_bars(spark, d), (".N1", ".N2")).where("name = 'divergence'").select(F.col("state").alias("divergence"))
    events = P.alert_events(achieved, exposed, QUERIES["K3_G3_watchlist"](spark, d), state, AS_OF)
    return events.groupBy("kind", "alert_key", "event_date").agg(F.count("*").alias("n"))
