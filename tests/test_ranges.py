"""Ordered measures over ranges: the same rows as one sort, and no window without a key over all of them."""

import contextlib
import datetime as dt
import io
import math

import duckdb
import pandas as pd
import pytest

from barloom.operators import stats
from barloom.plans import picks
from barloom.queries import stats as Q


@pytest.fixture
def small_ranges(spark):
    """Adaptive execution would join ranges this small."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.unset(key)


def test_equity_over_ranges_equals_a_fold(spark, small_ranges):
    returns = [((i * 37) % 23) - 11.0 for i in range(400)]
    trades = spark.createDataFrame([("A", i, r) for i, r in enumerate(returns)], "ticker string, i int, return_pct double").repartition(4)
    assert stats.placed(trades, ["i"]).select("_p").distinct().count() > 2
    out = stats.equity(trades, [], ["i"]).orderBy("i").collect()
    log, peak = 0.0, 0.0
    for i, (r, row) in enumerate(zip(returns, out, strict=True)):
        log += math.log1p(r / 100)
        peak = max(peak, math.exp(log))
        assert row["seq"] == i and math.isclose(row["log_equity"], log, abs_tol=1e-9) and math.isclose(row["peak"], peak, rel_tol=1e-9)


def test_quintiles_over_ranges(spark, small_ranges):
    rows = spark.createDataFrame([("A", i, float(i * 7 % 401), i % 2 == 0, 1.0) for i in range(401)], "ticker string, session_date int, score double, hit boolean, best_gain_pct double")
    got = stats.score_quintiles(rows).orderBy("quintile").collect()
    assert [(r["low"], r["high"], r["n"]) for r in got] == [(0, 80, 81), (81, 161, 81), (162, 242, 81), (243, 323, 81), (324, 400, 77)]


def test_retain_newest_sorts_no_status_in_one_task(spark):
    rows = [(i, "achieved" if i % 2 else "active", dt.date(2020, 1, 1 + i % 5)) for i in range(40)]
    df = picks.retain_newest(spark.createDataFrame(rows, "id int, status string, achieved_date date"), 3)
    newest = sorted((r for r in rows if r[1] == "achieved"), key=lambda r: (r[2], r[0]), reverse=True)[:3]
    assert sorted(r["id"] for r in df.collect()) == sorted([r[0] for r in newest] + [r[0] for r in rows if r[1] == "active"])
    with contextlib.redirect_stdout(io.StringIO()) as text:
        df.explain()
    assert "Window" not in text.getvalue()


def test_curve_below_the_least_double(spark, monkeypatch):
    rows = [("A", dt.date(2000, 1, 1) + dt.timedelta(i), -90.0 if i % 2 else -17.3) for i in range(700)]
    monkeypatch.setattr(Q, "trades_of", lambda *_: spark.createDataFrame(rows, "ticker string, exit_date date, return_pct double"))
    c = duckdb.connect()
    c.register("given", pd.DataFrame(rows, columns=["ticker", "exit_date", "return_pct"]))
    name = "G10_K9_equity_curve"
    want = c.execute("WITH xt AS (SELECT * REPLACE (CAST(exit_date AS date) AS exit_date) FROM given)" + Q.SQL[name].removeprefix(Q.TRADE_BASE) + " ORDER BY seq").fetchall()
    got = Q.g10(spark, "").orderBy("seq").collect()
    assert [tuple(r) for r in got] == want and want[-1][2] == -math.inf and -math.inf < min(r[2] for r in want if r[2] > -math.inf) < -708
    assert all(math.isfinite(r["log_equity"]) for r in Q.g10(spark, "", 1).collect())
