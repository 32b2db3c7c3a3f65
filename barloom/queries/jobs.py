"""Queries of cleaning, upserts, picks, repairs and streams."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import clean as C
from ..operators import indicators as I
from ..operators import stats as S
from ..plans import picks as P
from ..shared import shared_dir
from ..sources import ingest
from ..sources.views import BARS, bars, sector_map, table
from ..streaming import jobs
from . import SQL, query
from .indicators import rounded
from .sqltext import W, ctes, rnds

AS_OF = "2001-06-01"

# --- cleaning --------------------------------------------------------------------------------

RAW = """raw AS (SELECT o_orderkey AS id, CASE o_orderkey % 8 WHEN 0 THEN '' WHEN 1 THEN '-' WHEN 2 THEN CAST(o_orderkey AS varchar) || '%' WHEN 3 THEN '1,234.5' WHEN 4 THEN 'N/A' WHEN 5 THEN '-12.5' WHEN 6 THEN 'abc' ELSE CAST(o_orderkey AS varchar) END AS s,
  CASE o_orderkey % 6 WHEN 0 THEN '263.53K' WHEN 1 THEN '1.5m' WHEN 2 THEN '2B' WHEN 3 THEN '1,250' WHEN 4 THEN 'x' ELSE CAST(o_orderkey AS varchar) END AS v,
  CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%m/%d/%Y') WHEN 2 THEN CAST(30000 + o_orderkey % 8000 AS varchar) WHEN 3 THEN '02/31/1999' ELSE '12' END AS d, o_orderdate FROM orders)"""


def raw_of(spark, d):
    o = table(spark, d, "orders")
    k, t = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    s = F.when(k % 8 == 0, "").when(k % 8 == 1, "-").when(k % 8 == 2, F.concat(t, F.lit("%"))).when(k % 8 == 3, "1,234.5").when(k % 8 == 4, "N/A").when(k % 8 == 5, "-12.5").when(k % 8 == 6, "abc").otherwise(t)
    v = F.when(k % 6 == 0, "263.53K").when(k % 6 == 1, "1.5m").when(k % 6 == 2, "2B").when(k % 6 == 3, "1,250").when(k % 6 == 4, "x").otherwise(t)
    day = F.when(k % 5 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k % 5 == 1, F.date_format("o_orderdate", "MM/dd/yyyy")).when(k % 5 == 2, (30000 + k % 8000).cast("string")).when(k % 5 == 3, "02/31/1999").otherwise("12")
    return o.select(k.alias("id"), s.alias("s"), v.alias("v"), day.alias("d"), "o_orderdate")


@query("B1_B2_B3_B8_B17_numbers", ctes(RAW) + """
, n AS (SELECT *, CASE WHEN lower(trim(replace(replace(s, ',', ''), '%', ''))) IN ('', '-', '--', 'nan', 'none', 'n/a') THEN NULL ELSE try_cast(trim(replace(replace(s, ',', ''), '%', '')) AS double) END AS x,
  regexp_extract(upper(replace(v, ',', '')), '^([0-9]*\\.?[0-9]+)([KMB]?)$', 1) AS m, regexp_extract(upper(replace(v, ',', '')), '^([0-9]*\\.?[0-9]+)([KMB]?)$', 2) AS u FROM raw)
SELECT id, x AS number, CASE WHEN x > 0 THEN x END AS price, greatest(coalesce(x, 0), 0) AS volume, coalesce(try_cast(s AS double), 7) AS defaulted,
coalesce(round_even(try_cast(m AS double) * CASE u WHEN 'K' THEN 1e3 WHEN 'M' THEN 1e6 WHEN 'B' THEN 1e9 ELSE 1 END, 0), 0) AS suffixed FROM n""")
def numbers(spark, d):
    return raw_of(spark, d).select("id", C.number("s").alias("number"), C.price("s").alias("price"), C.volume("s").alias("volume"), C.or_default("s", 7.0).alias("defaulted"), C.suffixed_volume("v").alias("suffixed"))


@query("B6_B7_B15_L2_dates", ctes(RAW) + f"""
SELECT id, CASE WHEN f <= DATE '{AS_OF}' + 2 THEN f END AS feed_date, us AS us_date, try_cast(strftime(o_orderdate, '%Y-%d-%m') AS date) AS swapped FROM (
SELECT *, CASE id % 5 WHEN 0 THEN CAST(o_orderdate AS date) WHEN 1 THEN CAST(o_orderdate AS date) WHEN 2 THEN CASE WHEN id % 8000 > 0 THEN DATE '1899-12-30' + CAST(30000 + id % 8000 AS integer) END END AS f,
  CASE WHEN id % 5 = 1 THEN CAST(o_orderdate AS date) END AS us FROM raw)""")
def dates(spark, d):
    return raw_of(spark, d).select("id", C.feed_date("d", AS_OF).alias("feed_date"), C.us_date("d").alias("us_date"), C.swap_day_month(F.to_date("o_orderdate")).alias("swapped"))


@query("B4_B5_ratings", """SELECT o_orderkey AS id, r AS rating, CASE WHEN r IS NULL AND o_orderkey % 3 = 0 THEN NULL ELSE round_even((coalesce(r, 0) + CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 END) / (CASE WHEN r IS NULL THEN 0 ELSE 1 END + CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 END), 3) END AS consensus
FROM (SELECT *, CASE o_orderpriority WHEN '1-URGENT' THEN 2 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 0 WHEN '4-NOT SPECIFIED' THEN -2 END AS r FROM orders)""")
def ratings(spark, d):
    p = F.col("o_orderpriority")
    text = F.when(p == "1-URGENT", " Strong Buy").when(p == "2-HIGH", "BUY").when(p == "3-MEDIUM", "neutral").when(p == "4-NOT SPECIFIED", "strong sell").otherwise("?")
    other = F.when(F.col("o_orderkey") % 3 == 0, "n/a").otherwise("buy")
    r, s = C.rating(text), C.rating(other)
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), r.alias("rating"), C.consensus(r, s).alias("consensus"))


@query("B10_B14_names", "SELECT p_partkey, CASE WHEN length(p_brand) <= 6 AND NOT contains(p_brand, '.') THEN upper(p_brand) || '.CA' ELSE upper(p_brand) END AS symbol, replace(lower(p_name), ' ', '_') || '_' || lower(p_type) AS pattern_key, lower(p_name) AS filename_key FROM part")
def names(spark, d):
    return table(spark, d, "part").select(
        "p_partkey", C.symbol("p_brand").alias("symbol"), C.pattern_key(F.concat("p_name", F.lit(" (x) "), "p_type")).alias("pattern_key"),
        C.filename_key(F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(" Stock Price History.csv"))).alias("filename_key"),
    )


def _sector_sql() -> str:
    hit = lambda w: " AND ".join(f"contains(t, '{p}')" for p in w.split("+"))
    return " ".join(f"WHEN {' OR '.join(f'({hit(w)})' for w in words)} THEN '{name}'" for words, name in C.SECTOR_RULES)


@query("B11_clean_sector_name", f"SELECT p_partkey, CASE {_sector_sql()} ELSE s END AS sector FROM (SELECT p_partkey, s, lower(s) AS t FROM (SELECT p_partkey, p_name || ' ' || p_type || CASE WHEN p_size > 25 THEN ' steel' ELSE '' END AS s FROM part))")
def b11(spark, d):
    s = F.concat_ws(" ", "p_name", "p_type", F.when(F.col("p_size") > 25, F.lit("steel")))
    return table(spark, d, "part").select("p_partkey", C.sector_name(s).alias("sector"))


@query("B9_sanitize", "SELECT p_partkey, '''=' || p_name || ' and ’' || p_type || '''' AS clean FROM part")
def b9(spark, d):
    t = F.concat(F.lit("\u0007<script>x</script>=<"), F.col("p_name"), F.lit("> & '"), F.col("p_type"), F.lit('"'))
    return table(spark, d, "part").select("p_partkey", C.sanitize(t).alias("clean"))


@query("B12_D2_fuzzy_name_match", """
WITH a AS (SELECT p_partkey AS k, list_distinct(string_split(lower(p_name || ' ' || p_type), ' ')) AS t FROM part), b AS (SELECT DISTINCT p_name AS k, list_distinct(string_split(lower(p_name), ' ')) AS t FROM part),
p AS (SELECT a.k AS left_key, b.k AS right_key, len(list_intersect(a.t, b.t)) * 1.0 / least(len(a.t), len(b.t)) AS ratio FROM a, b WHERE len(list_intersect(a.t, b.t)) > 0)
SELECT CAST(left_key AS varchar) AS left_key, right_key, ratio >= 0.5 AS matched, floor(ratio * 1e6 + 0.50001) / 1e6 AS ratio FROM p QUALIFY row_number() OVER (PARTITION BY left_key ORDER BY ratio DESC, right_key) = 1""")
def d2(spark, d):
    part = table(spark, d, "part")
    a = part.select(F.col("p_partkey").cast("string").alias("key"), F.concat_ws(" ", "p_name", "p_type").alias("name"))
    b = part.select(F.col("p_name").alias("key"), F.col("p_name").alias("name")).distinct()
    df = P.fuzzy_match(a, b)
    return df.select("left_key", "right_key", "matched", *rounded(df, 6, "ratio"))


# --- upserts and scans -----------------------------------------------------------------------


@query("A10_A22_L3_upsert_bars", ctes(BARS) + f"""
, n AS (SELECT *, row_number() OVER ({W}) AS i FROM bars),
s AS (SELECT date, ticker, close FROM n WHERE i % 2 = 0), v AS (SELECT date, ticker, close * 2 AS close FROM n WHERE i % 5 = 0)
SELECT * FROM v UNION ALL SELECT s.* FROM s ANTI JOIN v USING (ticker, date)""")
def a10(spark, d, incoming="i % 5 = 0"):
    n = bars(spark, d).withColumn("i", F.row_number().over(I.w()))
    stored = n.where("i % 2 = 0").select("date", "ticker", "close")
    new = n.where(incoming).select("date", "ticker", "close", F.explode(F.array(F.lit(1), F.lit(2))).alias("version"))
    return ingest.upsert(stored, new.withColumn("close", F.col("close") * F.col("version")), ["ticker", "date"], ["version"])


# stored and new bars together are all there are; the query above stays the sample that its SQL states
query("A10_A22_L3_upsert_bars_every_bar", SQL["A10_A22_L3_upsert_bars"].replace("WHERE i % 5 = 0", "WHERE i % 5 = 0 OR i % 2 = 1"))(partial(a10, incoming="i % 5 = 0 or i % 2 = 1"))


@query("A11_A12_F35_latest_enrichment", "SELECT o_custkey AS ticker, o_totalprice AS value FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def f35(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("ticker"), F.col("o_totalprice").alias("value"), "o_orderdate", "o_orderkey")
    return ingest.upsert(o.select("ticker", "value").limit(0), o, ["ticker"], ["o_orderdate", "o_orderkey"])


@query("A16_G13_chart_history", ctes(BARS) + """
SELECT ticker, list(date ORDER BY date) AS dates, list(open ORDER BY date) AS opens, list(high ORDER BY date) AS highs, list(low ORDER BY date) AS lows, list(close ORDER BY date) AS closes, list(volume ORDER BY date) AS volumes
FROM (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) <= 365) GROUP BY 1""")
def a16(spark, d):
    return ingest.chart_history(bars(spark, d))


@query("A17_A18_publishable", "SELECT o_orderkey AS ticker, CASE WHEN o_orderkey % 4 > 1 THEN o_totalprice END AS price FROM orders")
def a17(spark, d):
    k = F.col("o_orderkey")
    price = F.when(k % 4 == 0, F.lit(float("nan"))).when(k % 4 == 1, F.lit(float("inf"))).otherwise(F.col("o_totalprice"))
    return ingest.publishable(table(spark, d, "orders").select(k.alias("ticker"), price.alias("price"), F.lit(1).alias("shares")))


@query("G12_recent_trades", "SELECT o_orderkey AS id, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def g12(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(50).select(F.col("o_orderkey").alias("id"), "o_orderdate")


@query("B16_freshness", ctes(BARS) + f"SELECT ticker, max(date) AS last_date, DATE '{AS_OF}' - max(date) AS age, DATE '{AS_OF}' - max(date) <= 6 AS fresh FROM bars WHERE date <= DATE '{AS_OF}' GROUP BY 1")
def b16(spark, d):
    day = F.lit(AS_OF).cast("date")
    last = bars(spark, d).where(F.col("date") <= day).groupBy("ticker").agg(F.max("date").alias("last_date"))
    age = F.datediff(day, "last_date")
    return last.select("ticker", "last_date", age.cast("long").alias("age"), (age <= 6).alias("fresh"))


# --- picks and repairs -----------------------------------------------------------------------

PICKS = """picks AS (SELECT o_orderkey AS id, 'S' || (o_orderkey % 90) AS ticker, CASE o_orderkey % 3 WHEN 0 THEN 'short' WHEN 1 THEN 'medium' ELSE 'long' END AS horizon, CAST(o_orderdate AS date) AS pick_date,
  80 + o_orderkey % 50 * 1.0 AS ref_price, CASE WHEN o_orderstatus = 'F' THEN 'achieved' ELSE 'active' END AS status, CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS date) + CAST(o_orderkey % 20 - 2 AS integer) END AS achieved_date,
  CASE WHEN o_orderstatus = 'F' THEN o_orderkey % 13 * CAST(0.5 AS double) END AS achieved_pct FROM orders)"""


def picks_of(spark, d):
    k, done = F.col("o_orderkey"), F.col("o_orderstatus") == "F"
    return table(spark, d, "orders").select(
        k.alias("id"), F.concat(F.lit("S"), (k % 90).cast("string")).alias("ticker"), F.when(k % 3 == 0, "short").when(k % 3 == 1, "medium").otherwise("long").alias("horizon"), F.to_date("o_orderdate").alias("pick_date"),
        (80 + k % 50 * 1.0).alias("ref_price"), F.when(done, "achieved").otherwise("active").alias("status"), F.when(done, F.date_add(F.to_date("o_orderdate"), (k % 20 - 2).cast("int"))).alias("achieved_date"),
        F.lit(None).cast("double").alias("achieved_price"), F.when(done, k % 13 * 0.5).alias("achieved_pct"), F.lit("scan").alias("source"),
    )


def prices_of(spark, d):
    return I.latest(bars(spark, d)).select("ticker", F.col("close").alias("price"))


NOW = "nowp AS (SELECT ticker, arg_max(close, date) AS price FROM bars GROUP BY 1)"


@query("D11_I16_I17_K12_picks_to_matrix", ctes(BARS, NOW, PICKS) + f"""
SELECT id, pick_date + CASE horizon WHEN 'short' THEN 1 WHEN 'medium' THEN 14 ELSE 60 END AS expected_from, pick_date + CASE horizon WHEN 'short' THEN 3 WHEN 'medium' THEN 45 ELSE 180 END AS expected_to,
{rnds(6, '(price / ref_price - 1) * 100 AS pct_since', '(price / ref_price - 1) * 100 - 2 AS alpha')} FROM picks LEFT JOIN nowp USING (ticker) WHERE status = 'active'""")
def d11(spark, d):
    df = P.expected_window(P.with_prices(picks_of(spark, d).where("status = 'active'"), prices_of(spark, d)))
    df = P.alpha(df.withColumn("benchmark_pct", F.lit(2.0)))
    return df.select("id", "expected_from", "expected_to", *rounded(df, 6, "pct_since", "alpha"))


@query("K10_mark_achieved", ctes(BARS, NOW, PICKS) + f"""
, x AS (SELECT *, status = 'active' AND (price / ref_price - 1) * 100 >= CASE horizon WHEN 'short' THEN 3 WHEN 'medium' THEN 8 ELSE 15 END AS hit FROM picks LEFT JOIN nowp USING (ticker))
SELECT id, CASE WHEN hit THEN 'achieved' ELSE status END AS status, CASE WHEN hit THEN DATE '{AS_OF}' ELSE achieved_date END AS achieved_date, {rnds(6, 'CASE WHEN hit THEN (price / ref_price - 1) * 100 ELSE achieved_pct END AS achieved_pct')} FROM x""")
def k10(spark, d):
    df = P.mark_achieved(picks_of(spark, d), prices_of(spark, d), AS_OF)
    return df.select("id", "status", "achieved_date", *rounded(df, 6, "achieved_pct"))


@query("K10_D18_D19_refill")
def k10b(spark, d):
    p = picks_of(spark, d)
    active = p.where("status = 'active'")
    rows = prices_of(spark, d).join(sector_map(spark, d), "ticker")
    pools = rows.select("ticker", "sector", "price", F.rank().over(Window.orderBy(F.desc("price"))).alias("rank"), F.when(F.col("price") > 100, "scan").otherwise("pre_breakout").alias("source"), F.explode(F.array(*[F.lit(h) for h in P.SLOTS])).alias("horizon"))
    excluded = rows.where("price < 20").select("ticker", F.lit(AS_OF).cast("date").alias("excluded_date"))
    return P.refill(active, pools, excluded, rows.where("sector = 'NATION_3'"), AS_OF)


@query("E14_leaderboard", ctes(PICKS) + "SELECT ticker, count(*) AS hits, sum(achieved_pct) AS total_return_pct, max(achieved_date) AS last_achieved_date FROM picks WHERE status = 'achieved' GROUP BY 1 ORDER BY hits DESC, total_return_pct DESC, ticker LIMIT 10")
def e14(spark, d):
    return S.leaderboard(picks_of(spark, d)).select("ticker", "hits", "total_return_pct", "last_achieved_date")


@query("G6_recent_achievements", ctes(PICKS) + f"SELECT 'recent' AS kind, id FROM (SELECT id FROM picks WHERE status = 'achieved' ORDER BY achieved_date DESC, achieved_pct DESC, ticker, horizon LIMIT 1) UNION ALL SELECT 'week', id FROM picks WHERE status = 'achieved' AND achieved_date BETWEEN DATE '{AS_OF}' - 7 AND DATE '{AS_OF}'")
def g6(spark, d):
    p = picks_of(spark, d)
    return P.recent_achievements(p, 1).select(F.lit("recent").alias("kind"), "id").unionByName(P.achieved_within(p, AS_OF).select(F.lit("week").alias("kind"), "id"))


@query("G7_retain_newest", ctes(PICKS) + "SELECT id, status FROM picks QUALIFY status <> 'achieved' OR row_number() OVER (PARTITION BY status ORDER BY achieved_date DESC, id DESC) <= 500")
def g7(spark, d):
    return P.retain_newest(picks_of(spark, d)).select("id", "status")


@query("K16_revert_picks", ctes(PICKS) + "SELECT id, CASE WHEN ticker IN ('S1', 'S2') AND status = 'achieved' THEN 'active' ELSE status END AS status, CASE WHEN ticker = 'S2' AND status = 'achieved' THEN DATE '2000-01-01' ELSE pick_date END AS pick_date FROM picks WHERE NOT (ticker = 'S3' AND status = 'achieved')")
def k16(spark, d):
    targets = table(spark, d, "supplier").where("s_suppkey in (1, 2, 3)").select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("ticker"), F.when(F.col("s_suppkey") == 3, "delete").otherwise("revert").alias("action"),
        F.when(F.col("s_suppkey") == 2, F.lit("2000-01-01").cast("date")).alias("pick_date"),
    )
    return P.revert_picks(picks_of(spark, d), targets).select("id", "status", "pick_date")


@query("K17_D20_purge_and_diff", ctes(PICKS) + "SELECT ticker, count(*) AS n FROM picks WHERE status = 'achieved' AND ticker NOT IN ('S1', 'S2') GROUP BY 1")
def k17(spark, d):
    done = picks_of(spark, d).where("status = 'achieved'")
    targets = done.where("ticker in ('S1', 'S2')").select("ticker", F.lit(None).cast("date").alias("achieved_date")).distinct()
    return P.purge_rows(done.select("id", "ticker", "achieved_date"), targets).groupBy("ticker").agg(F.count("*").alias("n"))


@query("D20_store_vs_export_diff", ctes(BARS) + "SELECT ticker, 'only in first' AS fault FROM (SELECT DISTINCT ticker FROM bars) WHERE CAST(substr(ticker, 2) AS integer) % 7 = 0")
def d20(spark, d):
    t = bars(spark, d).select("ticker").distinct().withColumn("rank", F.substring("ticker", 2, 9).cast("int"))
    return P.list_diff(t.select("rank", "ticker"), t.where("rank % 7 <> 0").select("rank", "ticker"))


@query("E34_A23_first_seen_history", ctes(PICKS) + "SELECT ticker, horizon, min(CASE WHEN status = 'achieved' THEN id END) AS first_achieved, min(id) AS first_version, coalesce(min(achieved_date) < min(pick_date), false) AS disordered FROM picks GROUP BY 1, 2")
def e34(spark, d):
    df = P.first_seen(picks_of(spark, d).withColumn("version", F.col("id")))
    return df.select("ticker", "horizon", "first_achieved", "first_version", "disordered")


FUTURE = f"""
fut AS (SELECT *, try_cast(strftime(date, '%Y-%d-%m') AS date) AS swapped FROM bars WHERE date > DATE '{AS_OF}'),
fix AS (SELECT f.*, CASE WHEN f.swapped IS NULL OR f.swapped > DATE '{AS_OF}' THEN 'unfixable' WHEN b.ticker IS NOT NULL THEN 'collision' ELSE 'repaired' END AS outcome FROM fut f LEFT JOIN bars b ON b.ticker = f.ticker AND b.date = f.swapped)"""


@query("C10_D16_K13_repair_future_dates", ctes(BARS, FUTURE) + "SELECT ticker, date, swapped, outcome FROM fix")
def k13(spark, d):
    return P.repair_future(bars(spark, d), AS_OF).select("ticker", "date", "swapped", "outcome")


@query("K13_apply_repair", ctes(BARS, FUTURE) + "SELECT ticker, date, close FROM bars ANTI JOIN (SELECT ticker, date FROM fix WHERE outcome = 'repaired') USING (ticker, date) UNION ALL SELECT ticker, swapped, close FROM fix WHERE outcome = 'repaired'")
def k13b(spark, d):
    return P.apply_repair(bars(spark, d), AS_OF).select("ticker", "date", "close")


@query("K14_purge_collisions", ctes(BARS, FUTURE) + "SELECT ticker, date FROM bars ANTI JOIN (SELECT ticker, date FROM fix WHERE outcome = 'collision') USING (ticker, date)")
def k14(spark, d):
    return P.purge_collisions(bars(spark, d), AS_OF).select("ticker", "date")


@query("E30_collision_pairs", ctes(BARS, FUTURE) + "SELECT date, swapped, count(*) AS count, (SELECT count(*) FROM (SELECT DISTINCT date FROM fix WHERE outcome = 'collision')) = 1 AS single_incident FROM fix WHERE outcome = 'collision' GROUP BY 1, 2")
def e30(spark, d):
    return P.collision_pairs(bars(spark, d), AS_OF)


@query("E29_future_by_date", ctes(BARS) + f"SELECT date, count(*) AS rows, list(ticker ORDER BY ticker)[1:5] AS sample FROM bars WHERE date > DATE '{AS_OF}' GROUP BY 1")
def e29(spark, d):
    return P.future_by_date(bars(spark, d), AS_OF)


@query("D14_D15_price_match", ctes(BARS) + f"""
, w AS (SELECT DISTINCT ticker, 100.0 AS price, DATE '1999-01-01' AS anchor FROM bars),
m AS (SELECT ticker, date, anchor FROM bars JOIN w USING (ticker) WHERE date <= DATE '{AS_OF}' AND abs(close - price) <= greatest(price * 0.5 / 100, 1e-9))
SELECT ticker AS id, count(DISTINCT date) AS candidates, CASE WHEN count(DISTINCT date) = 1 THEN min(date) ELSE max(CASE WHEN date <= anchor THEN date END) END AS chosen FROM m GROUP BY 1""")
def d14(spark, d):
    b = bars(spark, d)
    wanted = b.select("ticker").distinct().select(F.col("ticker").alias("id"), "ticker", F.lit(100.0).alias("price"), F.lit("1999-01-01").cast("date").alias("anchor"))
    return P.choose_candidate(P.price_matches(b, wanted, AS_OF), True).select("id", "candidates", "chosen")


@query("K15_repair_pick_dates", ctes(BARS, PICKS) + f"""
, m AS (SELECT p.id, b.date, p.achieved_date AS anchor FROM bars b JOIN picks p USING (ticker) WHERE b.date <= DATE '{AS_OF}' AND abs(b.close - p.ref_price) <= greatest(p.ref_price * 0.5 / 100, 1e-9)),
c AS (SELECT id, CASE WHEN count(DISTINCT date) = 1 THEN min(date) ELSE max(date) FILTER (WHERE date <= anchor) END AS chosen FROM m GROUP BY 1)
SELECT id, ticker, pick_date, chosen AS repaired_date, chosen IS NULL AS review FROM picks LEFT JOIN c USING (id)""")
def k15(spark, d):
    return P.repair_pick_dates(picks_of(spark, d), bars(spark, d), AS_OF).select("id", "ticker", "pick_date", "repaired_date", "review")


def _alerts(spark, d):
    e = table(spark, d, "events")
    return e.select(F.concat_ws(":", "event_type", (F.col("user_id") % 20).cast("string")).alias("alert_key"), F.to_date("ts").alias("event_date"))


#: A key's dates in order; from each the first that lies three days or more behind it; the chain from the first.
ALERTS = """WITH RECURSIVE d AS (SELECT DISTINCT event_type || ':' || user_id % 20 AS alert_key, CAST(ts AS date) AS event_date FROM events),
n AS (SELECT a.alert_key, a.event_date, min(b.event_date) AS after FROM d a LEFT JOIN d b ON a.alert_key = b.alert_key AND b.event_date >= a.event_date + 3 GROUP BY 1, 2),
fired AS (SELECT * FROM n WHERE (alert_key, event_date) IN (SELECT (alert_key, min(event_date)) FROM n GROUP BY alert_key) UNION ALL SELECT n.* FROM fired f JOIN n ON n.alert_key = f.alert_key AND n.event_date = f.after)
SELECT alert_key, event_date FROM fired"""


@query("K18_L4_alert_dedup", ALERTS)
def l4(spark, d):
    return P.dedupe_alerts(_alerts(spark, d), 3)


# --- streams ---------------------------------------------------------------------------------

SAMPLED = "count(*) AS n, max(value) AS high, min(value) AS low"


@query("L5_streaming_bars", f"SELECT date_trunc('hour', ts) AS start, event_type, {SAMPLED}, arg_min(value, {{'t': ts, 'e': event_id}}) AS open, arg_max(value, {{'t': ts, 'e': event_id}}) AS close FROM events GROUP BY 1, 2")
def l5(spark, d):
    out = jobs.bars_by_window(jobs.events_stream(spark, f"{d}/[e]vents.parquet"), "event_type", "value")
    return jobs.collect_stream(out, shared_dir(spark, "l5"), "complete").select("start", "event_type", "n", "high", "low", "open", "close")


@query("L6_moving_window_stats", f"""SELECT date_trunc('hour', ts) - INTERVAL 1 HOUR * k.k AS start, event_type, {SAMPLED}, {rnds(6, 'avg(value) AS mean')} FROM events, range(0, 3) k(k) GROUP BY 1, 2""")
def l6(spark, d):
    out = jobs.bars_by_window(jobs.events_stream(spark, f"{d}/[e]vents.parquet"), "event_type", "value", "3 hours", slide="1 hour")
    df = jobs.collect_stream(out, shared_dir(spark, "l6"), "complete")
    return df.select("start", "event_type", "n", "high", "low", *rounded(df, 6, "mean"))


@query("L7_user_sessions", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS end, count(*) AS n FROM s GROUP BY user_id, k""")
def l7(spark, d):
    out = jobs.user_sessions(jobs.events_stream(spark, f"{d}/[e]vents.parquet"))
    return jobs.collect_stream(out, shared_dir(spark, "l7"), "complete")


@query("L4_alert_dedup_stream", ALERTS)
def l4s(spark, d):
    stream = jobs.events_stream(spark, f"{d}/[e]vents.parquet")
    keyed = stream.select(F.concat_ws(":", "event_type", (F.col("user_id") % 20).cast("string")).alias("alert_key"), F.to_date("ts").alias("event_date"))
    return jobs.collect_stream(jobs.dedupe_alerts_stream(keyed, 3), shared_dir(spark, "l4"), "complete")


@query("L8_target_reached_stream", "SELECT CAST(user_id AS varchar) AS ticker, min(ts) AS ts FROM events WHERE value >= 50 GROUP BY 1")
def l8(spark, d):
    stream = jobs.events_stream(spark, f"{d}/[e]vents.parquet").select(F.col("user_id").cast("string").alias("ticker"), "ts", F.col("value").alias("price"))
    picks = table(spark, d, "events").select(F.col("user_id").cast("string").alias("ticker")).distinct().withColumn("target", F.lit(50.0))
    return jobs.collect_stream(jobs.targets_reached_stream(stream, picks), shared_dir(spark, "l8"), "complete").select("ticker", "ts")
