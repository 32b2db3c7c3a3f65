"""Hand-made fixtures: smoothing, edges, cleaning, ingest, picks, patterns, streams."""

import datetime as dt
import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions import clean as C
from barloom.functions import smoothing
from barloom.functions import rules as R
from barloom.operators import indicators as I
from barloom.operators import stats, structure
from barloom.plans import events, market, picks, portfolio
from barloom.sources import ingest
from barloom.streaming import jobs

BARS = "date date, ticker string, open double, high double, low double, close double, volume double"


def panel(spark, closes, ticker="A", start=dt.date(2020, 1, 1), days=None, volume=1000.0):
    days = days or [start + dt.timedelta(i) for i in range(len(closes))]
    rows = [(d, ticker, float(c), c * 1.01, c * 0.99, float(c), volume) for d, c in zip(days, closes)]
    return spark.createDataFrame(rows, BARS)


def walk(n, seed=1):
    return (100 * np.exp(np.cumsum(np.random.default_rng(seed).normal(0, 0.02, n)))).round(4).tolist()


def test_smoothing_recursion_and_short_history():
    for n in (3, 8, 40):
        c = walk(n)
        g = pd.DataFrame({"date": pd.date_range("2020-01-01", periods=n).date, "open": c, "high": [x + 1 for x in c], "low": [x - 1 for x in c], "close": c})
        out = smoothing.smoothed(g)
        y, a = c[0], 2 / (min(20, n) + 1)
        for x in c[1:]:
            y = a * x + (1 - a) * y
        assert math.isclose(out["ema_20"].iloc[-1], y, rel_tol=1e-12)
        assert out["rsi_14"].between(0, 100).all() and out["adx_14"].notna().all()
    flat = pd.DataFrame({"date": pd.date_range("2020-01-01", periods=20).date, "open": 5.0, "high": 5.0, "low": 5.0, "close": 5.0})
    out = smoothing.smoothed(flat)
    assert (out["rsi_14"] == 50).all() and (out["adx_14"] == 0).all()


def test_indicators_are_causal_and_ignore_row_order(spark):
    c = walk(120)
    full = I.indicators(panel(spark, c)).where("date <= date'2020-04-09'").orderBy("date")
    part = I.indicators(panel(spark, c[:100]).orderBy(F.desc("close"))).orderBy("date")
    names = ["sma_50", "ema_20", "rsi_14", "atr_14", "bb_upper", "cmf_20", "macd_histogram"]
    a, b = full.select(names).toPandas().to_numpy(), part.select(names).toPandas().to_numpy()
    assert a.shape == b.shape and np.allclose(a, b, rtol=1e-12, atol=1e-12)


def test_zero_range_and_zero_volume(spark):
    rows = [(dt.date(2020, 1, i + 1), "A", 5.0, 5.0, 5.0, 5.0, 0.0) for i in range(16)]
    r = I.latest(I.range_position(I.indicators(spark.createDataFrame(rows, BARS)))).head()
    assert (r["vwap_20"], r["cmf_20"], r["volume_ratio"], r["bb_percent_b"], r["range_pos"]) == (5.0, 0.0, 1.0, 0.5, 50.0)


@pytest.mark.parametrize(("gap", "after", "kept"), [(25, 20, 40), (26, 20, 20), (26, 15, 15), (26, 14, 34)])
def test_history_trim(spark, gap, after, kept):
    days = [dt.date(2020, 1, 1) + dt.timedelta(i) for i in range(20)]
    days += [days[-1] + dt.timedelta(gap + i) for i in range(after)]
    assert I.history_trim(panel(spark, [10.0] * len(days), days=days)).count() == kept


def test_swings_never_lie_on_edges_and_ties_do_not_count(spark):
    c = [9, 1, 5, 5, 1, 2, 7, 2, 1, 8]
    rows = structure.swings(panel(spark, c), 1).orderBy("idx").collect()
    assert [(r["idx"], r["kind"]) for r in rows] == [(1, "T"), (4, "T"), (6, "P"), (8, "T")]  # the equal closes at 2 and 3 are none
    alt = structure.alternating(structure.swings(panel(spark, c), 1)).orderBy("idx").collect()
    assert [r["kind"] for r in alt] == ["T", "P", "T"] and alt[0]["idx"] == 1  # the earlier of equal lows


def test_double_bottom_is_found(spark):
    legs = [np.linspace(a, b, 30, endpoint=False) for a, b in ((100, 80), (80, 92), (92, 79), (79, 105))]
    c = np.concatenate(legs).tolist()
    found = structure.detect_all(panel(spark, c)).where("pattern = 'Double Bottom'").collect()
    assert found and found[0]["direction"] == "bullish" and found[0]["quality"] > 0.5


def test_flags_and_cups(spark):
    pole = [100 + 2 * i for i in range(10)]
    rest = [118, 117.4, 116.6, 117.2, 116.5, 115.9, 116.6, 116.0, 115.3, 115.9, 115.2, 114.7, 115.4, 114.8, 114.2, 114.9, 114.3, 113.8, 114.5, 113.9, 113.5, 114.0]
    c = [100.0] * 5 + pole + rest
    found = structure.flags_and_pennants(structure.histories(panel(spark, c))).collect()
    assert [(r["pattern"], r["direction"], r["start_index"], r["end_index"]) for r in found] == [("Bull Flag", "bullish", 0, 34)]
    assert set(found[0]["levels"]) == {"pole_start", "pole_end", "flag_resistance_end", "flag_support_end", "measured_move_target"}
    x = np.arange(61)
    cup = 100 - 20 * (1 - ((x - 30) / 30.0) ** 2)
    c = np.concatenate([np.linspace(80, 99, 12), cup, np.linspace(99.5, 96, 8), np.linspace(96.5, 104, 12)]).tolist()
    b = panel(spark, c)
    found = structure.cups(structure.histories(b), structure.alternating(structure.swings(b))).collect()
    assert [(r["pattern"], r["levels"]["cup_bottom"]) for r in found] == [("Cup & Handle", 80.0)]


def test_poles_equal_a_scan_bar_by_bar(spark):
    """Random walks: from every free bar, the first that begins a pole."""
    r = np.random.default_rng(5)
    for k in range(4):
        c = np.round(100 * np.exp(np.cumsum(r.normal(0, 0.02, 160))), 3)
        row = structure.histories(panel(spark, c.tolist())).head()
        want, free = [], 0
        for i in range(len(c)):
            ahead = c[i : i + 15]
            ends = {s: i + int(np.argmax(s * ahead)) for s in (1, -1)}
            good = {s: abs(c[j] / c[i] - 1) for s, j in ends.items() if j - i >= 3 and s * (c[j] / c[i] - 1) >= 0.08 and np.mean(s * np.diff(c[i : j + 1]) >= 0) >= 0.75}
            if good and i >= free:
                free = ends[max(good, key=lambda s: (good[s], s))]
                want.append((i, free))
        assert [(p["i"], p["j"]) for p in row["poles"]] == want


def test_dedupe_keeps_the_better_of_overlaps(spark):
    rows = [("A", "X", "up", s, e, None, None, {"l": 1.0}, q) for s, e, q in ((0, 5, 0.5), (3, 9, 0.9), (8, 9, 0.9), (20, 22, 0.1), (21, 30, 0.1))]
    df = spark.createDataFrame(rows, "ticker string, pattern string, direction string, start_index int, end_index int, start_date date, end_date date, levels map<string,double>, quality double")
    assert sorted((r["start_index"], r["end_index"]) for r in structure.dedupe_overlaps(df).collect()) == [(3, 9), (21, 30)]


def test_event_walk_exits_in_order():
    n = 400
    g = pd.DataFrame({"ticker": "A", "date": pd.date_range("2020-01-01", periods=n).date, "open": 100.0, "high": 101.0, "low": 99.0, "close": 100.0, "signal": False, "stop": 95.0, "target": 105.0, "raw_action": "BUY ON DIP", "sector": "S"})
    g[["adx_14", "rsi_14", "gap_pct", "volume_ratio", "vol_z_score"]] = 1.0
    g.loc[[255, 262, 280], "signal"] = True
    g.loc[260, ["high", "low"]] = [106.0, 94.0]  # both barriers: the stop counts
    g.loc[270, "high"] = 106.0
    out = events.walk(g)
    assert out["exit_reason"].tolist() == ["stop_loss", "take_profit", "fold_end"]
    assert out["return_pct"].tolist() == [-5.7, 4.3, -0.7]
    assert out["holding_bars"].tolist() == [4, 7, 309 - 281]


def test_rules(spark):
    df = spark.range(1)
    lo, hi = R.wilson(F.lit(5), F.lit(10))
    row = df.select(
        R.graduated(F.lit(12.0), 8, 15, 25, 34, 20).alias("a"), R.graduated(F.lit(None).cast("double"), 8, 15, 25, 34, 20).alias("b"), lo.alias("lo"), hi.alias("hi"),
        R.kelly_fraction(F.lit(0.6), F.lit(2.0)).alias("k"), R.bucket(F.lit(20.0), *R.ADX).alias("adx"), R.breakeven_fields(F.lit(100.0), F.lit(10), F.lit(100.0))["breakeven_shares"].alias("n"),
    ).head()
    assert math.isclose(row["a"], 20 * 4 / 7) and row["b"] == 0
    assert round(row["lo"], 1) == 23.7 and round(row["hi"], 1) == 76.3
    assert math.isclose(row["k"], 0.2) and row["adx"] == "adx 20-25" and row["n"] == 0


def test_cleaning(spark):
    df = spark.createDataFrame([("=1+1<b>&\"x\"", "Food and Beverages", "1/2/2020"), (None, "", "13/2/2020"), ("a‮b", "oil, gas", "43831")], "t string, s string, d string")
    rows = df.select(C.sanitize("t").alias("t"), C.sector_name("s").alias("s"), C.feed_date("d", "2020-06-01").alias("d"), C.price(F.lit("-")).alias("p"), C.volume(F.lit(None).cast("string")).alias("v")).collect()
    assert [r["t"] for r in rows] == ["'=1+1band'x'", None, "ab"]
    assert [r["s"] for r in rows] == ["Food, Beverages & Tobacco", "General / Diversified", "Energy & Support Services"]
    assert [str(r["d"]) for r in rows] == ["2020-01-02", "2020-02-13", "2020-01-01"]
    assert rows[0]["p"] is None and rows[0]["v"] == 0


def test_feed_from_csv(spark, tmp_path):
    feed = tmp_path / "in"
    feed.mkdir()
    (feed / "a.csv").write_text("Date,Symbol,Last Price,Volume\n2020-01-02,abc,\"1,234.5\",10\n2020-01-03,abc,-,10\n2099-01-01,abc,5,1\n")
    (feed / "sector_list.csv").write_text("Date,Symbol\n")
    rows = ingest.read_feed(spark, [str(feed / "a.csv")], "2020-06-01")
    good, bad = ingest.split_valid(rows)
    assert [(r["ticker"], r["close"], r["open"], r["volume"]) for r in good.collect()] == [("ABC.CA", 1234.5, 1234.5, 10.0)]
    assert sorted(r["error_message"] for r in bad.collect()) == ["no valid close", "no valid date"]
    seen = ingest.discover(spark, str(feed), spark.createDataFrame([], "file_hash string"))
    assert [r["path"].rsplit("/", 1)[1] for r in seen.collect()] == ["a.csv"]
    assert ingest.discover(spark, str(feed), seen.select("file_hash")).count() == 0


def test_vendor_history_and_conflicts(spark):
    raw = spark.createDataFrame(
        [("1/2/2020", "5", "4", "6", "", "1.5K", "/x/Abc Bank Stock Price History.csv"), ("2/31/2020", "5", "4", "6", "3", "1", "/x/Abc Bank Stock Price History.csv"), ("1/2/2020", "5", "4", "6", "3", "1", "/x/one.csv"), ("1/2/2020", "5", "4", "6", "3", "1", "/x/two.csv")],
        "Date string, Price string, Open string, High string, Low string, `Vol.` string, _file string",
    )
    names = spark.createDataFrame([("abc bank", "ABC.CA"), ("one", "X.CA"), ("two", "X.CA")], "filename string, ticker string")
    rows = ingest.normalise_history(raw, names).collect()
    assert [(str(r["date"]), r["ticker"], r["low"], r["volume"]) for r in rows] == [("2020-01-02", "ABC.CA", 5.0, 1500.0)]


def test_enrichment(spark):
    raw = spark.createDataFrame([("A", "1,000", "Buy", "Sell"), ("B", "-", "?", None)], "ticker string, cap string, r1 string, r2 string")
    rows = ingest.enrichment(raw, ["cap"], ["r1", "r2"]).collect()
    assert [(r["ticker"], r["cap"], r["consensus"]) for r in rows] == [("A", 1000.0, 0.0)]


def test_upsert_is_idempotent(spark):
    stored = spark.createDataFrame([("A", 1, 1.0), ("B", 1, 1.0)], "k string, d int, v double")
    new = spark.createDataFrame([("A", 1, 2.0, 1), ("A", 1, 3.0, 2), ("C", 1, 4.0, 1)], "k string, d int, v double, t int")
    once = ingest.upsert(stored, new, ["k", "d"], ["t"])
    twice = ingest.upsert(once, new, ["k", "d"], ["t"])
    want = [("A", 1, 3.0), ("B", 1, 1.0), ("C", 1, 4.0)]
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == want


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("A", float("nan"), 1.0), ("B", 2.0, 3.0)], "ticker string, v double, cash double")
    ingest.write_topics({"matrix": df}, str(tmp_path))
    assert ingest.validate_topics(spark, str(tmp_path), {"matrix": ["ticker", "v"], "gone": []}) and not ingest.validate_topics(spark, str(tmp_path), {"matrix": ["ticker"]})
    assert "cash" not in spark.read.json(f"{tmp_path}/matrix").columns
    ingest.write_per_key(df, "ticker", str(tmp_path / "keys"))
    ingest.write_per_key(df.where("ticker = 'A'"), "ticker", str(tmp_path / "keys"))
    assert sorted(p.name for p in (tmp_path / "keys").glob("ticker=*")) == ["ticker=A"]
    closed = spark.createDataFrame([("A", 1.0, True), ("B", 2.0, False)], "ticker string, pnl double, is_demo boolean")
    ingest.write_ledger(closed, spark.createDataFrame([("TOTAL", 2.0)], "ticker string, pnl double"), str(tmp_path / "ledger"))
    assert spark.read.option("header", True).csv(str(tmp_path / "ledger")).count() == 2


def test_versions_and_runs(spark, tmp_path):
    for i, status in enumerate(("active", "achieved")):
        (tmp_path / f"v{i}.json").write_text(json.dumps({"short": [{"ticker": "A", "status": status, "pick_date": "2020-01-02", "achieved_date": "2020-01-01"}], "medium": [], "long": []}))
    rows = ingest.versioned(spark, str(tmp_path)).where("ticker is not null")
    r = picks.first_seen(rows).head()
    assert r["statuses"] == ["achieved", "active"] and r["disordered"]
    runs = spark.createDataFrame([(1, 1), (2, 5), (3, 3)], "id int, run_at int")
    assert [x["id"] for x in ingest.run_history(runs, 2).collect()] == [2, 3]


def test_alert_dedup_equals_a_loop(spark):
    r = np.random.default_rng(2)
    rows = [(f"k{int(r.integers(3))}", dt.date(2020, 1, 1) + dt.timedelta(int(r.integers(60)))) for _ in range(80)]
    want = []
    for k in sorted({k for k, _ in rows}):
        last = None
        for d in sorted({d for x, d in rows if x == k}):
            if last is None or (d - last).days >= 3:
                want.append((k, d))
                last = d
    got = picks.dedupe_alerts(spark.createDataFrame(rows, "alert_key string, event_date date"), 3).collect()
    assert sorted(map(tuple, got)) == want


def test_refill_fills_free_slots_once(spark):
    active = spark.createDataFrame([("A", "short", "active")], "ticker string, horizon string, status string")
    pools = spark.createDataFrame(
        [(h, t, "bad" if t == "D" else "ok", i, 10.0, "pre_breakout" if t in "EF" else "scan") for h in ("short", "medium", "long") for i, t in enumerate("ABCDEFGHIJKL")],
        "horizon string, ticker string, sector string, rank int, price double, source string",
    )
    out = picks.refill(active, pools, spark.createDataFrame([("B", dt.date(2020, 1, 1))], "ticker string, excluded_date date"), spark.createDataFrame([("bad",)], "sector string"), "2020-01-01", {"short": 2, "medium": 2, "long": 3})
    got = {}
    for r in out.orderBy("ticker").collect():
        got.setdefault(r["horizon"], []).append(r["ticker"])
    assert got == {"short": ["C"], "medium": ["E", "G"], "long": ["D", "F", "H"]}


def test_fuzzy_match_and_review(spark):
    left = spark.createDataFrame([("1", "Alpha Steel Co"), ("2", "Omega")], "key string, name string")
    right = spark.createDataFrame([("A", "Alpha Steel Industries"), ("B", "Alpha Foods")], "key string, name string")
    m = picks.fuzzy_match(left, right)
    ok, review = picks.review_split(left, m)
    assert [r["right_key"] for r in ok.collect()] == ["A"] and [r["key"] for r in review.collect()] == ["2"]


def test_quintiles_use_ceil_chunks(spark):
    rows = spark.createDataFrame([("A", i, float(i), i % 2 == 0, 1.0) for i in range(11)], "ticker string, session_date int, score double, hit boolean, best_gain_pct double")
    assert [r["n"] for r in stats.score_quintiles(rows).orderBy("quintile").collect()] == [3, 3, 3, 2]


def test_total_loss_ends_equity(spark):
    t = spark.createDataFrame([("A", i, r) for i, r in enumerate((10.0, -100.0, 50.0))], "ticker string, i int, return_pct double")
    assert [round(r["equity"], 6) for r in stats.equity(t, ["ticker"], ["i"]).orderBy("i").collect()] == [1.1, 0.0, 0.0]


def test_exits_without_data(spark):
    b = panel(spark, walk(60), "A", volume=1e6)
    own = spark.createDataFrame([("A", 100.0, 10, dt.date(2020, 1, 10)), ("Z", 50.0, 1, dt.date(2020, 1, 10))], "ticker string, buy_price double, shares int, purchase_date date")
    m = market.matrix(b, spark.createDataFrame([("A", "x")], "ticker string, sector string"))
    rows = {r["ticker"]: r for r in portfolio.exits(own, b, m, "2020-03-01").collect()}
    assert rows["Z"]["price"] == 50.0 and rows["Z"]["action"] == "HOLD" and rows["A"]["peak"] >= rows["A"]["price"]


def test_screens_and_search(spark):
    df = spark.createDataFrame([("A1", "x")], "ticker string, n string")
    assert market.text_search(df, " ", "n").count() == 1 and market.text_search(df, "Q", "n").count() == 0
    assert market.prefix_screen(spark.createDataFrame([("1A",), ("B",)], "ticker string"), "#").collect()[0]["ticker"] == "1A"


def test_ingest_stream_equals_batch(spark, tmp_path):
    feed = tmp_path / "in"
    feed.mkdir()
    header = ["Date", "Ticker", "Open", "High", "Low", "Close", "Volume"]
    (feed / "a.csv").write_text(",".join(header) + "\n2020-01-02,ABC,1,2,1,2,5\n2020-01-02,ABC,1,2,1,,5\n")
    args = (spark, str(feed), header, "2020-06-01", f"{tmp_path}/out", f"{tmp_path}/ck")
    jobs.start_ingest(*args).awaitTermination()
    (feed / "b.csv").write_text(",".join(header) + "\n2020-01-02,ABC,1,2,1,3,5\n2020-01-03,ABC,1,2,1,4,5\n")
    jobs.start_ingest(*args).awaitTermination()
    rows = spark.read.parquet(f"{tmp_path}/out/bars").orderBy("date").collect()
    assert [(str(r["date"]), r["close"]) for r in rows] == [("2020-01-02", 3.0), ("2020-01-03", 4.0)]
    assert spark.read.parquet(f"{tmp_path}/out/quarantine").count() == 1


def test_channels_are_isolated(spark):
    got = []

    def good(rows):
        got.append(len(rows))

    def broken(rows):
        raise ValueError("no")

    faults = jobs.notify(spark.range(2), [broken, good, good])
    assert got == [2] and faults == ["broken: no"]
