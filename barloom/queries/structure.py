"""Queries of swings, levels and patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import structure as S
from ..plans import market as M
from ..sources.layout import stored
from ..sources.views import BARS, SECTOR_INDEX_BARS, SECTOR_MAP, bars, sector_index_bars, sector_map
from . import query
from .indicators import ATR_PERCENTILE_SQL, rounded
from .market import ANALOGS
from .sqltext import ACTIONS, ALL_INDICATORS, UNIVERSE, W, ctes, last, recursive, rnds

B, A = f"({W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)", f"({W} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)"


def _swings(name: str, source: str) -> str:
    return f"""
{name}0 AS (SELECT ticker, date, close AS price, row_number() OVER ({W}) - 1 AS idx, count(*) OVER (PARTITION BY ticker) AS n,
  CASE WHEN close > max(close) OVER {B} AND close > max(close) OVER {A} THEN 'P' WHEN close < min(close) OVER {B} AND close < min(close) OVER {A} THEN 'T' END AS kind FROM {source}),
{name} AS (SELECT * FROM {name}0 WHERE kind IS NOT NULL AND idx > 0 AND idx < n - 1)"""


ALTERNATING = """
run0 AS (SELECT *, CASE WHEN lag(kind) OVER (PARTITION BY ticker ORDER BY idx) = kind THEN 0 ELSE 1 END AS new FROM swings),
run1 AS (SELECT *, sum(new) OVER (PARTITION BY ticker ORDER BY idx) AS run FROM run0),
alt AS (SELECT ticker, date, idx, price, kind FROM run1 QUALIFY row_number() OVER (PARTITION BY ticker, run ORDER BY CASE WHEN kind = 'P' THEN -price ELSE price END, idx) = 1)"""
SWING_BASE = (BARS, _swings("swings", "bars"), ALTERNATING)


@query("F22_swing_points", ctes(*SWING_BASE) + "SELECT ticker, date, idx, price, kind FROM swings")
def f22(spark, d):
    return S.swings(bars(spark, d)).select("ticker", "date", "idx", "price", "kind")


@query("F24_alternating_swings", ctes(*SWING_BASE) + "SELECT * FROM alt")
def f24(spark, d):
    return S.alternating(S.swings(bars(spark, d))).select("ticker", "date", "idx", "price", "kind")


@query("F23_F25_peak_divergence", ctes(SECTOR_INDEX_BARS) + """
, p AS (SELECT a.date, a.close AS a, b.close AS b FROM sector_index_bars a JOIN sector_index_bars b USING (date) WHERE a.ticker = '.N1' AND b.ticker = '.N2'),
l AS (SELECT 'a' AS ticker, date, a AS close FROM p UNION ALL SELECT 'b', date, b FROM p),
k AS (SELECT *, close >= coalesce(max(close) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), close) AND close >= coalesce(max(close) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING), close) AS peak FROM l),
r AS (SELECT ticker, close, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS r FROM k WHERE peak),
s AS (SELECT ticker, sign(max(CASE WHEN r = 1 THEN close END) - max(CASE WHEN r = 2 THEN close END)) AS s FROM r WHERE r <= 2 GROUP BY 1),
t AS (SELECT max(CASE WHEN ticker = 'a' THEN s END) AS a, max(CASE WHEN ticker = 'b' THEN s END) AS b, (SELECT count(*) FROM p) AS shared FROM s)
SELECT shared, CASE WHEN shared < 60 THEN 'unavailable' WHEN a > 0 AND b < 0 THEN 'bearish' WHEN a < 0 AND b > 0 THEN 'bullish' ELSE 'none' END AS divergence FROM t""")
def f25(spark, d):
    s = sector_index_bars(spark, d)
    return S.peak_divergence(s.where("ticker = '.N1'"), s.where("ticker = '.N2'"))


ZONES = f"""
recent AS (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) <= 250),
{_swings('rs', 'recent')},
nowp AS (SELECT ticker, max(date) AS last_date, arg_max(close, date) AS price_now FROM recent GROUP BY 1 HAVING count(*) >= 20),
z0 AS (SELECT *, CASE WHEN (price - lag(price) OVER z) / lag(price) OVER z * 100 > 1.5 OR lag(price) OVER z IS NULL THEN 1 ELSE 0 END AS new FROM rs JOIN nowp USING (ticker) WINDOW z AS (PARTITION BY ticker, kind ORDER BY price, idx)),
z1 AS (SELECT *, sum(new) OVER (PARTITION BY ticker, kind ORDER BY price, idx ROWS UNBOUNDED PRECEDING) AS zone FROM z0),
z2 AS (SELECT ticker, kind, zone, price_now, avg(price) AS level, count(*) AS touches, sum(pow(0.5, greatest(last_date - date, 0) / 120.0)) AS strength, max(date) AS last_touch FROM z1 GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2),
z3 AS (SELECT *, CASE WHEN kind = 'P' AND level > price_now THEN 'resistance' WHEN kind = 'T' AND level < price_now THEN 'support' END AS side FROM z2),
zones AS (SELECT *, row_number() OVER (PARTITION BY ticker, side ORDER BY abs(level - price_now)) AS rank FROM z3 WHERE side IS NOT NULL QUALIFY rank <= 3)"""


@query("F26_support_resistance", ctes(BARS, ZONES) + f"SELECT ticker, side, rank, touches, last_touch, {rnds(5, 'level', 'strength')} FROM zones")
def f26(spark, d):
    df = S.support_resistance(bars(spark, d))
    return df.select("ticker", "side", "rank", "touches", "last_touch", *rounded(df, 5, "level", "strength"))


def _pd(a: str, b: str) -> str:
    return f"abs({a} - {b}) / ((abs({a}) + abs({b})) / 2)"


LEADS = ", ".join(f"lead(price, {i}) OVER o AS p{i}, lead(idx, {i}) OVER o AS i{i}" for i in range(1, 5))
REVERSALS = f"""
ld AS (SELECT ticker, kind, price AS p0, idx AS i0, {LEADS} FROM alt WINDOW o AS (PARTITION BY ticker ORDER BY idx)),
rev AS (
SELECT ticker, CASE kind WHEN 'P' THEN 'Head & Shoulders' ELSE 'Inverse Head & Shoulders' END AS pattern, CASE kind WHEN 'P' THEN 'bearish' ELSE 'bullish' END AS direction, i0 AS start_index, i4 AS end_index,
  greatest(0, 1 - ({_pd('p0', 'p4')} + {_pd('p1', 'p3')}) / 2 / 0.045) AS quality, MAP {{'left_shoulder': p0, 'head': p2, 'right_shoulder': p4, 'neckline': (p1 + p3) / 2, 'target': p1 + p3 - p2}} AS levels FROM ld
  WHERE i4 IS NOT NULL AND {_pd('p0', 'p4')} <= 0.03 AND {_pd('p1', 'p3')} <= 0.045 AND ((kind = 'P' AND p2 > p0 * 1.03 AND p2 > p4 * 1.03) OR (kind = 'T' AND p2 < p0 * 0.97 AND p2 < p4 * 0.97))
UNION ALL SELECT ticker, CASE kind WHEN 'P' THEN 'Double Top' ELSE 'Double Bottom' END, CASE kind WHEN 'P' THEN 'bearish' ELSE 'bullish' END, i0, i2, greatest(0, 1 - {_pd('p0', 'p2')} / 0.03),
  MAP {{'first_' || CASE kind WHEN 'P' THEN 'top' ELSE 'bottom' END: p0, 'second_' || CASE kind WHEN 'P' THEN 'top' ELSE 'bottom' END: p2, 'neckline': p1, 'target': 2 * p1 - (p0 + p2) / 2}} FROM ld
  WHERE i2 IS NOT NULL AND {_pd('p0', 'p2')} <= 0.03 AND abs((p0 + p2) / 2 - p1) / ((p0 + p2) / 2) >= 0.045)"""


def by_level(patterns):
    """One row per level of a pattern, to be compared."""
    rows = patterns.select("ticker", "pattern", "direction", "start_index", "end_index", "quality", F.explode("levels").alias("level", "price"))
    return rows.select("ticker", "pattern", "direction", "start_index", "end_index", "level", *rounded(rows, 2, "quality"), *rounded(rows, 3, "price"))


def by_level_sql(*tables: str) -> str:
    each = " UNION ALL ".join(f"SELECT ticker, pattern, direction, start_index, end_index, quality, unnest(map_entries(levels)) AS lv FROM {t}" for t in tables)
    return f", found AS ({each}) SELECT ticker, pattern, direction, start_index, end_index, lv.key AS level, {rnds(2, 'round_even(quality, 2) AS quality')}, {rnds(3, 'lv.value AS price')} FROM found"


@query("J1_J4_reversals", ctes(*SWING_BASE, REVERSALS) + by_level_sql("rev"))
def j1(spark, d):
    return by_level(S.reversals(S.alternating(S.swings(bars(spark, d)))))


SPANS = f"""
sq AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY idx) AS r FROM alt),
sp AS (SELECT a.ticker, a.r, k.k, min(b.idx) AS i0, max(b.idx) AS i1, avg(b.price) AS mean, avg(b.price) FILTER (WHERE b.kind = 'P') AS top, avg(b.price) FILTER (WHERE b.kind = 'T') AS low,
  regr_slope(b.price, b.idx) FILTER (WHERE b.kind = 'P') AS ps, regr_slope(b.price, b.idx) FILTER (WHERE b.kind = 'T') AS ts, regr_intercept(b.price, b.idx) FILTER (WHERE b.kind = 'P') AS pi, regr_intercept(b.price, b.idx) FILTER (WHERE b.kind = 'T') AS ti
  FROM sq a, range(4, 8) k(k), sq b WHERE b.ticker = a.ticker AND b.r BETWEEN a.r AND a.r + k.k - 1 GROUP BY 1, 2, 3
  HAVING count(*) = k.k AND count(*) FILTER (WHERE b.kind = 'P') >= 2 AND count(*) FILTER (WHERE b.kind = 'T') >= 2),
sf AS (SELECT s.*, avg({_pd('b.price', 'top')}) FILTER (WHERE b.kind = 'P') AS off_top, avg({_pd('b.price', 'low')}) FILTER (WHERE b.kind = 'T') AS off_low FROM sp s JOIN sq b ON b.ticker = s.ticker AND b.r BETWEEN s.r AND s.r + s.k - 1 GROUP BY ALL),
sc AS (SELECT *, CASE WHEN ps * (i1 - i0) / mean > 0.03 THEN 'rising' WHEN ps * (i1 - i0) / mean < -0.03 THEN 'falling' ELSE 'flat' END AS pc, CASE WHEN ts * (i1 - i0) / mean > 0.03 THEN 'rising' WHEN ts * (i1 - i0) / mean < -0.03 THEN 'falling' ELSE 'flat' END AS tc,
  CASE WHEN abs(ps - ts) >= 1e-9 THEN (ti - pi) / (ps - ts) END AS apex, ps * i0 + pi AS r0, ps * i1 + pi AS r1, ts * i0 + ti AS s0, ts * i1 + ti AS s1 FROM sf),
tri AS (SELECT ticker, 'Ascending Triangle' AS pattern, 'bullish' AS direction, i0 AS start_index, i1 AS end_index, greatest(0, 1 - off_top / 0.03) AS quality, MAP {{'resistance': top, 'support_start': s0, 'support_end': s1, 'apex_index': apex, 'apex_price': ps * apex + pi}} AS levels FROM sc WHERE pc = 'flat' AND tc = 'rising'
UNION ALL SELECT ticker, 'Descending Triangle', 'bearish', i0, i1, greatest(0, 1 - off_low / 0.03), MAP {{'support': low, 'resistance_start': r0, 'resistance_end': r1, 'apex_index': apex, 'apex_price': ps * apex + pi}} FROM sc WHERE pc = 'falling' AND tc = 'flat'
UNION ALL SELECT ticker, 'Symmetrical Triangle', 'neutral', i0, i1, 0.75, MAP {{'resistance_start': r0, 'resistance_end': r1, 'support_start': s0, 'support_end': s1, 'apex_index': apex, 'apex_price': ps * apex + pi}} FROM sc WHERE pc = 'falling' AND tc = 'rising' AND (apex IS NULL OR apex > i1)
UNION ALL SELECT ticker, 'Price Channel (' || upper(pc[1]) || pc[2:] || ')', CASE pc WHEN 'rising' THEN 'bullish' WHEN 'falling' THEN 'bearish' ELSE 'neutral' END, i0, i1, 0.85, MAP {{'resistance_start': r0, 'resistance_end': r1, 'support_start': s0, 'support_end': s1}} FROM sc
  WHERE pc = tc AND (pc = 'flat' OR abs(ps - ts) / (abs(ps) + abs(ts) + 1e-9) <= 0.12))"""


@query("J5_J8_triangles_and_channels", ctes(*SWING_BASE, SPANS) + by_level_sql("tri"))
def j5(spark, d):
    return by_level(S.triangles_and_channels(S.alternating(S.swings(bars(spark, d)))))


POLES = f"""
pb AS (SELECT ticker, close, row_number() OVER ({W}) - 1 AS idx, count(*) OVER (PARTITION BY ticker) AS n, lag(close) OVER ({W}) AS b1, lag(close, 2) OVER ({W}) AS b2, lead(close) OVER ({W}) AS a1, lead(close, 2) OVER ({W}) AS a2 FROM bars),
ps AS (SELECT *, count(*) FILTER (WHERE close >= b1) OVER (PARTITION BY ticker ORDER BY idx) AS ups, count(*) FILTER (WHERE close <= b1) OVER (PARTITION BY ticker ORDER BY idx) AS downs FROM pb),
px AS (SELECT s.ticker, s.idx AS i, any_value(s.close) AS ci, any_value(s.ups) AS ups, any_value(s.downs) AS downs, arg_max({{'i': t.idx, 'c': t.close, 's': t.ups}}, {{'c': t.close, 'i': -t.idx}}) AS t, arg_min({{'i': t.idx, 'c': t.close, 's': t.downs}}, {{'c': t.close, 'i': t.idx}}) AS l
  FROM ps s JOIN ps t ON s.ticker = t.ticker AND t.idx BETWEEN s.idx AND s.idx + 14 GROUP BY 1, 2),
pm AS (SELECT *, CASE WHEN t.i - i >= 3 AND t.c / ci - 1 >= 0.08 AND (t.s - ups) / (t.i - i) >= 0.75 THEN t.c / ci - 1 END AS up, CASE WHEN l.i - i >= 3 AND l.c / ci - 1 <= -0.08 AND (l.s - downs) / (l.i - i) >= 0.75 THEN 1 - l.c / ci END AS down FROM px),
pj AS (SELECT ticker, i, ci, coalesce(up >= down, up IS NOT NULL) AS rise, CASE WHEN rise THEN t.i ELSE l.i END AS j, CASE WHEN rise THEN t.c ELSE l.c END AS cj FROM pm WHERE up IS NOT NULL OR down IS NOT NULL),
pn AS (SELECT a.*, min(b.i) AS after FROM pj a LEFT JOIN pj b ON a.ticker = b.ticker AND b.i >= a.j GROUP BY ALL),
pole AS (SELECT * FROM pn WHERE (ticker, i) IN (SELECT (ticker, min(i)) FROM pn GROUP BY ticker) UNION ALL SELECT n.* FROM pole p JOIN pn n ON n.ticker = p.ticker AND n.i = p.after)"""
FLAGS = """
rest AS (SELECT p.ticker, p.i, p.j, p.ci, p.cj, p.rise, least(p.j + 20, b.n - 1) AS e, b.idx, b.close,
  b.idx > p.j AND b.idx < least(p.j + 20, b.n - 1) AND close > b1 AND close > a1 AND (idx - 2 < p.j OR close > b2) AND (idx + 2 > least(p.j + 20, b.n - 1) OR close > a2) AS top,
  b.idx > p.j AND b.idx < least(p.j + 20, b.n - 1) AND close < b1 AND close < a1 AND (idx - 2 < p.j OR close < b2) AND (idx + 2 > least(p.j + 20, b.n - 1) OR close < a2) AS low
  FROM pole p JOIN pb b ON b.ticker = p.ticker AND b.idx BETWEEN p.j AND least(p.j + 20, b.n - 1)),
line AS (SELECT ticker, i, j, e, ci, cj, rise, max(close) - min(close) AS range, avg(close) AS mean, abs(cj - ci) AS height, regr_slope(close, idx) FILTER (WHERE top) AS ts, regr_intercept(close, idx) FILTER (WHERE top) AS ti,
  regr_slope(close, idx) FILTER (WHERE low) AS ls, regr_intercept(close, idx) FILTER (WHERE low) AS li FROM rest GROUP BY ALL HAVING e - j >= 5 AND count(*) FILTER (WHERE top) >= 2 AND count(*) FILTER (WHERE low) >= 2),
ways AS (SELECT *, CASE WHEN ts * (e - j) / mean > 0.03 THEN 1 WHEN ts * (e - j) / mean < -0.03 THEN -1 ELSE 0 END AS tw, CASE WHEN ls * (e - j) / mean > 0.03 THEN 1 WHEN ls * (e - j) / mean < -0.03 THEN -1 ELSE 0 END AS lw FROM line WHERE height > 0 AND range <= 0.6 * height),
flag AS (SELECT ticker, CASE WHEN tw = -1 AND lw = 1 THEN 'Pennant' WHEN rise THEN 'Bull Flag' ELSE 'Bear Flag' END AS pattern, CASE WHEN rise THEN 'bullish' ELSE 'bearish' END AS direction, i AS start_index, e AS end_index, greatest(0, 1 - range / height) AS quality,
  CASE WHEN tw = -1 AND lw = 1 THEN '' ELSE 'flag_' END AS pre, MAP {'pole_start': ci, 'pole_end': cj, pre || 'resistance_end': ts * e + ti, pre || 'support_end': ls * e + li, 'measured_move_target': 2 * cj - ci} AS levels
  FROM ways WHERE (tw = lw AND tw <> CASE WHEN rise THEN 1 ELSE -1 END) OR (tw = -1 AND lw = 1))"""
CUPS = """
rims AS (SELECT a.ticker, a.idx AS l, b.idx AS r, a.price AS pl, b.price AS pr, b.idx - a.idx AS wide, abs(a.price - b.price) / ((abs(a.price) + abs(b.price)) / 2) AS differ FROM alt a JOIN alt b ON a.ticker = b.ticker AND a.kind = 'P' AND b.kind = 'P' AND b.idx - a.idx BETWEEN 20 AND 150),
bowl AS (SELECT c.ticker, l, r, pl, pr, wide, differ, any_value(n) AS n, min(close) AS bottom, (wide + 1.0) AS m, sum((pow(idx - (l + r) / 2.0, 2) - (m * m - 1) / 12) * close) / (m * (m * m - 1) * (m * m - 4) / 180) AS bend,
  sum((idx - (l + r) / 2.0) * close) / (m * (m * m - 1) / 12) AS tilt FROM rims c JOIN pb ON pb.ticker = c.ticker AND pb.idx BETWEEN l AND r WHERE differ <= 0.03 GROUP BY 1, 2, 3, 4, 5, 6, 7),
hand AS (SELECT b.*, (pl + pr) / 2 AS rim, least(r + greatest(5, wide // 4), b.n - 1) AS e, min(p.close) AS dip FROM bowl b JOIN pb p ON p.ticker = b.ticker AND p.idx BETWEEN r AND least(r + greatest(5, wide // 4), b.n - 1)
  WHERE bend > 0 AND (m - 1) / 2 - tilt / (2 * bend) BETWEEN 0.25 * m AND 0.75 * m GROUP BY ALL),
cup AS (SELECT ticker, 'Cup & Handle' AS pattern, 'bullish' AS direction, l AS start_index, e AS end_index, greatest(0, 1 - differ / 0.03) AS quality,
  MAP {'left_rim': pl, 'right_rim': pr, 'cup_bottom': bottom, 'handle_low': dip, 'breakout_level': greatest(pl, pr), 'target': greatest(pl, pr) + rim - bottom} AS levels
  FROM hand WHERE e - r >= 3 AND (rim - bottom) / rim >= 0.12 AND pr > dip AND pr - dip <= 0.5 * (rim - bottom) AND dip >= (rim + bottom) / 2)"""
SCANNED = (POLES, FLAGS, CUPS)


@query("J9_J13_M5_flags_and_cups", recursive(ctes(*SWING_BASE, *SCANNED) + by_level_sql("flag", "cup")))
def j9(spark, d):
    return by_level(S.scanned(bars(spark, d)))


def deduped(*tables: str) -> str:
    """H6 as a walk from row to row: the last kept match, and whether the row opened a new one."""
    each = " UNION ALL ".join(f"SELECT ticker, pattern, direction, start_index, end_index, round_even(quality, 2) AS quality, levels FROM {t}" for t in tables)
    return f"""
every AS (SELECT *, row_number() OVER (PARTITION BY ticker, pattern ORDER BY start_index, end_index) AS n FROM ({each})),
walk AS (SELECT ticker, pattern, n, n AS kept, start_index AS s, end_index AS e, quality AS q, true AS opened FROM every WHERE n = 1
  UNION ALL SELECT x.ticker, x.pattern, x.n, CASE WHEN x.start_index > w.e OR x.quality > w.q OR (x.quality = w.q AND x.end_index - x.start_index > w.e - w.s) THEN x.n ELSE w.kept END,
    CASE WHEN x.start_index > w.e OR x.quality > w.q OR (x.quality = w.q AND x.end_index - x.start_index > w.e - w.s) THEN x.start_index ELSE w.s END,
    CASE WHEN x.start_index > w.e OR x.quality > w.q OR (x.quality = w.q AND x.end_index - x.start_index > w.e - w.s) THEN x.end_index ELSE w.e END,
    CASE WHEN x.start_index > w.e OR x.quality > w.q OR (x.quality = w.q AND x.end_index - x.start_index > w.e - w.s) THEN x.quality ELSE w.q END, x.start_index > w.e
  FROM walk w JOIN every x ON x.ticker = w.ticker AND x.pattern = w.pattern AND x.n = w.n + 1),
shown AS (SELECT x.* FROM walk w LEFT JOIN walk v ON v.ticker = w.ticker AND v.pattern = w.pattern AND v.n = w.n + 1 JOIN every x ON x.ticker = w.ticker AND x.pattern = w.pattern AND x.n = w.kept WHERE v.n IS NULL OR v.opened)"""


DETECTED = recursive(ctes(*SWING_BASE, REVERSALS, SPANS, *SCANNED, deduped("rev", "tri", "flag", "cup")))


@query("J14_H6_M1_detect_all", DETECTED + by_level_sql("shown"))
def j14(spark, d):
    return by_level(S.detect_all(bars(spark, d)))


@query("H6_dedupe_overlaps", recursive(ctes(*SWING_BASE, REVERSALS, deduped("rev"))) + by_level_sql("shown"))
def h6(spark, d):
    b = bars(spark, d)
    return by_level(S.dedupe_overlaps(S.reversals(S.alternating(S.swings(b)))))


GOOD = ", good AS (SELECT * FROM shown WHERE quality >= 0.75 AND ticker IN (SELECT ticker FROM bars GROUP BY 1 HAVING count(*) >= 40))"


@query("J15_E31_pattern_summary", DETECTED + GOOD + " SELECT 'pattern' AS by, pattern AS name, count(*) AS matches FROM good GROUP BY ALL UNION ALL SELECT 'direction', direction, count(*) FROM good GROUP BY ALL")
def e31(spark, d):
    b = bars(spark, d)
    return S.pattern_summary(S.pattern_filter(S.detect_all(b), b))


@query("E31_reversal_summary", ctes(*SWING_BASE, REVERSALS) + "SELECT 'pattern' AS by, pattern AS name, count(*) AS matches FROM rev GROUP BY ALL UNION ALL SELECT 'direction', direction, count(*) FROM rev GROUP BY ALL")
def e31b(spark, d):
    return S.pattern_summary(S.reversals(S.alternating(S.swings(bars(spark, d)))))


@query("D12_best_pattern_per_ticker", DETECTED + f"""
, b AS (SELECT ticker, arg_max({{'p': pattern, 'd': direction, 'q': quality}}, {{'b': CAST(direction = 'bullish' AS integer), 'q': quality, 'e': end_index, 'p': pattern}}) AS b FROM shown GROUP BY 1)
SELECT ticker, b.p AS pattern, b.d AS direction, {rnds(2, 'b.q AS quality')} FROM b""")
def d12(spark, d):
    df = S.best_pattern(S.detect_all(bars(spark, d)))
    return df.select("ticker", "pattern", "direction", *rounded(df, 2, "quality"))


@query("J16_long_term_setup", DETECTED + """
, lows AS (SELECT ticker, price, row_number() OVER (PARTITION BY ticker ORDER BY idx DESC) AS r FROM alt WHERE kind = 'T'),
two AS (SELECT ticker, max(price) FILTER (WHERE r = 1) >= max(price) FILTER (WHERE r = 2) * 1.03 AS up FROM lows GROUP BY 1),
best AS (SELECT ticker, max(quality) >= 0.75 AS good, arg_max(pattern, {'q': quality, 'e': end_index, 'p': pattern}) AS pattern FROM shown WHERE direction = 'bullish' GROUP BY 1),
own AS (SELECT ticker, n, coalesce(up, false) AS up, coalesce(good, false) AS good, pattern FROM (SELECT ticker, count(*) AS n FROM bars GROUP BY 1) LEFT JOIN two USING (ticker) LEFT JOIN best USING (ticker))
SELECT ticker, n >= 40 AND up AND good AS confirmed, CASE WHEN up THEN 'Higher-low swing structure confirmed' ELSE 'No confirmed higher-low swing structure yet' END || '; ' || CASE WHEN good THEN pattern || ' match' ELSE 'No bullish pattern match at required quality' END AS reasons FROM own""")
def j16(spark, d):
    b = bars(spark, d)
    return S.long_term_setup(b, S.detect_all(b)).select("ticker", "confirmed", F.array_join("reasons", "; ").alias("reasons"))


@query("J17_G9_analog_match", ctes(BARS) + f"""
, x AS (SELECT *, row_number() OVER ({W}) - 1 AS idx, count(*) OVER (PARTITION BY ticker) AS n, avg(close) OVER a AS m, stddev_pop(close) OVER a AS s, count(*) OVER a AS k, lead(close, 5) OVER ({W}) AS f
  FROM bars WINDOW a AS ({W} ROWS BETWEEN 14 PRECEDING AND CURRENT ROW)),
cur AS (SELECT e.ticker, b.idx - e.idx AS off, (b.close - e.m) / (e.s + 1e-8) AS z FROM x e JOIN x b ON b.ticker = e.ticker AND b.idx BETWEEN e.idx - 14 AND e.idx WHERE e.idx = e.n - 1),
sims AS (SELECT e.ticker, e.idx, e.close, e.f, sum((b.close - e.m) / (e.s + 1e-8) * c.z) / 15 AS sim FROM x e JOIN x b ON b.ticker = e.ticker AND b.idx BETWEEN e.idx - 14 AND e.idx
  JOIN cur c ON c.ticker = e.ticker AND c.off = b.idx - e.idx WHERE e.k = 15 AND e.idx + 5 < e.n - 15 GROUP BY 1, 2, 3, 4),
top AS (SELECT *, (f - close) / close AS ret FROM sims QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY sim DESC, idx) <= 5),
g AS (SELECT ticker, avg(sim) AS a, avg(ret) AS r, stddev_pop(ret) AS d, count(*) AS sample_size, sqrt(avg(pow(least(ret, 0), 2))) AS ds FROM top WHERE sim >= 0.6 GROUP BY 1)
SELECT ticker, sample_size, {rnds(4, 'a * 100 * greatest(0, 1 - least(d * 5, 0.5)) * greatest(0.5, 1 - ds * 5) AS confidence', 'r * 100 AS projected_pct', 'd * 100 AS dispersion_pct')} FROM g""")
def j17(spark, d):
    df = S.analog_match(bars(spark, d))
    return df.select("ticker", "sample_size", *rounded(df, 4, "confidence", "projected_pct", "dispersion_pct"))


def _grade(v: str, soft_lo, lo, hi, soft_hi, points) -> str:
    return f"""CASE WHEN {v} BETWEEN {lo} AND {hi} THEN {points}.0 WHEN {v} > {soft_lo} AND {v} < {lo} THEN {points} * ({v} - {soft_lo}) / nullif({lo - soft_lo}, 0)
    WHEN {v} > {hi} AND {v} < {soft_hi} THEN {points} * ({soft_hi} - {v}) / nullif({soft_hi - hi}, 0) ELSE 0 END"""


WATCH_POINTS = {
    "squeeze": "CASE WHEN bb_kc_squeeze THEN 25.0 ELSE 0 END", "adx": f"({_grade('adx_14', 8, 15, 25, 34, 20)}) * CASE WHEN adx_rising THEN 1 ELSE 0.4 END", "rsi": _grade("rsi_14", 42, 50, 65, 73, 15),
    "volume": _grade("volume_build", 0.9, 1.25, 10, 10, 15), "range": _grade("range_pos", 62, 87, 100, 100, 15), "flow": "CASE WHEN cmf_20 > 0 THEN 10.0 ELSE 0 END", "weekly": "CASE WHEN weekly_aligned THEN 10.0 ELSE 0 END",
    "sector": _grade("(ret_5 - coalesce(sector_5d, 0))", 0, 6, 999, 999, 12), "index": _grade("(ret_5 - index_5d)", 0, 5, 999, 999, 10), "analog": "CASE WHEN projected_pct > 0 THEN least(12.0, confidence * 0.12) ELSE 0 END",
    "failed": "CASE WHEN high_10 >= resistance * 0.98 AND close <= resistance * 0.95 THEN -15.0 ELSE 0 END", "dry_up": _grade("dry_up", -1, -1, 0.75, 0.95, 12), "contraction": _grade("atr_percentile", -1, -1, 40, 65, 10),
    "up_down": _grade("up_down_volume", 0.9, 1.3, 999, 999, 10),
}
WATCH = f"""
wb0 AS (SELECT *, close >= lag(close) OVER ({W}) AS up FROM ind),
wb AS (SELECT *, CASE WHEN n_bars >= 10 THEN coalesce(avg(volume) OVER {last(5)} / nullif(avg(volume) OVER ({W} ROWS BETWEEN 9 PRECEDING AND 5 PRECEDING), 0), 0) ELSE 1 END AS volume_build,
  CASE WHEN n_bars >= 50 THEN avg(volume) OVER {last(10)} / nullif(avg(volume) OVER {last(50)}, 0) END AS dry_up, sum(CASE WHEN up THEN volume ELSE 0 END) OVER {last(15)} AS uv, sum(CASE WHEN NOT up THEN volume ELSE 0 END) OVER {last(15)} AS dv,
  i > 6 AND adx_14 > lag(adx_14, 5) OVER ({W}) AS adx_rising, coalesce((close - lag(close, 5) OVER ({W})) / lag(close, 5) OVER ({W}) * 100, 0) AS ret_5, max(high) OVER {last(10)} AS high_10 FROM wb0),
latest AS (SELECT *, CASE WHEN i >= 16 THEN CASE WHEN dv > 0 THEN uv / dv WHEN uv > 0 THEN 1.3 END END AS up_down_volume FROM wb WHERE i = n_bars)"""
WATCHED = f"""
near_zone AS (SELECT ticker, level FROM zones WHERE side = 'resistance' AND rank = 1),
sector_mean AS (SELECT sector, avg(ret_5) AS sector_5d FROM latest JOIN sector_map USING (ticker) WHERE n_bars >= 6 GROUP BY 1),
ix AS (SELECT ticker AS index_ticker, (close - lag(close, 5) OVER ({W})) / lag(close, 5) OVER ({W}) * 100 AS index_5d, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS r FROM sector_index_bars),
sector_ix AS (SELECT n_name AS sector, index_5d FROM nation JOIN ix ON index_ticker = '.N' || n_nationkey AND r = 1 WHERE n_nationkey % 2 = 0),
wj AS (SELECT c.*, sector, sector_5d, index_5d, atr_percentile, coalesce(level, range_high) AS resistance, confidence, projected_pct FROM conf c JOIN sector_map USING (ticker) LEFT JOIN sector_mean USING (sector) LEFT JOIN sector_ix USING (sector)
  LEFT JOIN atrp USING (ticker) LEFT JOIN near_zone USING (ticker) LEFT JOIN analogs USING (ticker) WHERE liquid AND n_bars >= 20),
wp AS (SELECT *, {", ".join(f"{v} AS p_{k}" for k, v in WATCH_POINTS.items())} FROM wj),
ws AS (SELECT *, greatest({" + ".join(f"p_{k}" for k in WATCH_POINTS)}, 0) AS breakout_score FROM wp WHERE NOT (raw_action = 'STRONG BUY' OR brk OR starts_with(raw_action, 'SELL'))),
wr AS (SELECT *, row_number() OVER (PARTITION BY breakout_score >= 65 ORDER BY breakout_score DESC, ticker) AS rank FROM ws WHERE breakout_score >= 35)"""


@query("K3_G3_watchlist", ctes(UNIVERSE, *ALL_INDICATORS[1:], SECTOR_MAP, SECTOR_INDEX_BARS, WATCH, ACTIONS, ATR_PERCENTILE_SQL, ZONES, ANALOGS.strip().removeprefix(","), WATCHED) + f"""
SELECT ticker, CASE WHEN breakout_score < 65 THEN 'Watching' WHEN breakout_score >= 78 THEN 'High Confidence' ELSE 'Confirmed' END AS tier, CAST(rank AS integer) AS rank,
{rnds(3, 'breakout_score', 'greatest((resistance - close) / close * 100, 0) AS dist_to_resistance_pct', *(f'p_{k}' for k in WATCH_POINTS))} FROM wr WHERE rank <= CASE WHEN breakout_score >= 65 THEN 25 ELSE 10 END""")
def k3(spark, d):
    from .market import _index_of

    b = stored(M.universe(bars(spark, d)), "universe")
    zones = S.support_resistance(b).where("side = 'resistance' and rank = 1").select("ticker", F.col("level").alias("resistance"))
    from ..operators import indicators as I

    ret = I.latest(sector_index_bars(spark, d).withColumn("index_5d", I.n_bar_return(5))).select(F.col("ticker").alias("index_ticker"), "index_5d")
    index_returns = _index_of(spark, d).join(ret, "index_ticker").select("sector", "index_5d")
    out = M.watchlist(b, sector_map(spark, d), zones, index_returns, analogs=S.analog_match(b), days=0, adapt=False)
    out = M.watchlist_tiers(out).withColumns({f"p_{k}": F.col(f"points.{k}") for k in WATCH_POINTS})
    return out.select("ticker", "tier", "rank", *rounded(out, 3, "breakout_score", "dist_to_resistance_pct", *(f"p_{k}" for k in WATCH_POINTS)))
