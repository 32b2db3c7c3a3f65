"""Queries that take all of their input, counted against it."""

import datetime as dt

from pyspark.sql import functions as F

from barloom import registry
from barloom.queries import jobs as Q
from barloom.sources.views import bars

SF = "/root/testdata/sf0.001"


def test_every_bar_is_a_trade_and_a_snapshot(spark):
    per = bars(spark, SF).groupBy("ticker").count()
    trades, snaps = per.select(F.sum(F.greatest(F.col("count") - 6, F.lit(0))), F.sum(F.col("count") - 1)).head()
    run = registry.queries()
    assert run["E12_action_breakdown_every_bar"](spark, SF).agg(F.sum("trade_count")).head()[0] == trades
    assert run["D13_E13_K8_score_validation_every_bar"](spark, SF).agg(F.sum("n")).head()[0] == snaps


def test_every_bar_is_stored_or_new(spark):
    b = bars(spark, SF).select("ticker", "date")
    out = registry.queries()["A10_A22_L3_upsert_bars_every_bar"](spark, SF).select("ticker", "date")
    assert b.exceptAll(out).isEmpty() and out.exceptAll(b).isEmpty()


def test_refill_counts_every_active_pick(spark, monkeypatch):
    rows = [("X1", "short", 1, "active")] * 2 + [("X1", "long", 2, "active"), ("X2", "short", 3, "active"), ("X3", "long", 9, "active"), ("X4", "medium", 9, "achieved")]
    picks = spark.createDataFrame([(t, h, dt.date(2001, 1, d), s) for t, h, d, s in rows], "ticker string, horizon string, pick_date date, status string")
    monkeypatch.setattr(Q, "picks_of", lambda *_: picks)
    got = {r["horizon"]: r["count"] for r in Q.k10b(spark, SF).groupBy("horizon").count().collect()}
    assert got == {"short": 2, "medium": 3, "long": 1}
