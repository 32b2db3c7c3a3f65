"""Edge cases of account reports, the tracker and repairs."""

import datetime as dt

from barloom.operators import stats
from barloom.plans import picks
from barloom.sources import ingest

HELD = "ticker string, sector string, value double"


def test_exposure_warns_of_the_largest_only(spark):
    rows = [("A", "X", 60.0), ("B", "X", 10.0), ("C", "Y", 26.0)]
    got = {(r["kind"], r["name"]): r for r in stats.risk_allocations(spark.createDataFrame(rows, HELD), 4.0).collect()}
    assert sorted(k for k, r in got.items() if r["warning"]) == [("cash", "cash"), ("position", "A"), ("sector", "X")]
    assert got["position", "C"]["risk_multiple"] == 26.0 and got["cash", "cash"]["pct_of_equity"] == 4.0
    alone = stats.risk_allocations(spark.createDataFrame(rows[:1], HELD), 40.0).collect()
    assert not any(r["warning"] for r in alone)
    empty = stats.risk_allocations(spark.createDataFrame([], HELD), 0.0).collect()
    assert [(r["kind"], r["pct_of_equity"]) for r in empty] == [("cash", 0.0)]


def test_account_total_of_nothing(spark):
    held = spark.createDataFrame([], "ticker string, shares long, cost double, value double, days_held int")
    closed = spark.createDataFrame([("A", 2.0, 3.0, 10)], "ticker string, buy_price double, sell_price double, shares int")
    r = stats.account_total(held, closed).head()
    assert r["positions"] == 0 and r["driver"] is None and r["total_pnl"] == 10.0


def test_usage_without_stats_and_without_end(spark):
    t = dt.datetime(2020, 1, 1)
    rows = [("u", None, "web", t, t + dt.timedelta(seconds=5)), ("u", None, "web", t, None), (None, "e", "desktop", t, t)]
    used = spark.createDataFrame(rows, "uid string, email string, source string, start timestamp, last_seen timestamp")
    kept = spark.createDataFrame([("u", 1, 2.0, 3.0), ("u", 2, 2.0, 3.0)], "uid string, trade_count long, trade_value double, portfolio_value double")
    got = [(r["user"], r["sessions"], r["total_seconds"], r["trade_count"], r["trade_value"]) for r in stats.usage_report(used, kept).collect()]
    assert got == [("u", 1, 5, 3, 4.0), ("e", 1, 0, 0, 0.0)]


def test_tracker_takes_the_changed_file(spark):
    t = [dt.datetime(2020, 1, d) for d in (1, 2)]
    found = spark.createDataFrame([("file:/a", t[1], "h2"), ("file:/b", t[1], "h3"), ("file:/c", t[1], "h4")], "path string, modificationTime timestamp, file_hash string")
    rows = spark.createDataFrame([("file:///a", True), ("file:///a", False), ("file:///b", False)], "_file string, valid boolean")
    good, failed = ingest.file_outcomes(found, rows)
    old = spark.createDataFrame([("file:/a", t[0], "h1")], "file_path string, last_modified timestamp, file_hash string")
    assert [(r["file_path"], r["file_hash"]) for r in ingest.track(old, good).collect()] == [("file:/a", "h2")]
    assert {(r["file_path"], r["error_message"]) for r in failed.collect()} == {("file:/b", "no valid row"), ("file:/c", "no rows")}


def test_achieved_date_follows_the_repaired_pick(spark):
    d = lambda n: dt.date(2020, 1, n)
    late = dt.date(2021, 1, 1)
    bars = spark.createDataFrame([("A", d(2), 10.0), ("A", d(1), 20.0), ("A", d(5), 20.0), ("A", d(9), 20.0)], "ticker string, date date, close double")
    rows = [(1, "A", late, 10.0, late, 20.0), (2, "A", d(3), 10.0, late, 99.0), (3, "A", d(3), 10.0, None, None)]
    p = spark.createDataFrame(rows, "id int, ticker string, pick_date date, ref_price double, achieved_date date, achieved_price double")
    got = {r["id"]: (r["pick_date"], r["achieved_date"], r["pick_action"], r["achieved_action"]) for r in picks.repair_future_picks(p, bars, "2020-06-01").collect()}
    assert got[1] == (d(2), d(5), "repaired", "repaired")
    assert got[2] == (d(3), late, "kept", "review") and got[3] == (d(3), None, "kept", "kept")
