"""The target watch: calls to the store, and odd rows."""

import math
import random

from pyspark.sql import Row
from test_stream_state import at, feed, held, rocksdb  # noqa: F401

from barloom.streaming import stateful as T


def test_a_watch_calls_the_store_a_few_times_a_ticker():
    """a ticker's picks are read and written by one call each, and it has one timer, however many its picks."""
    calls = []

    class Store:
        rows: list = []

        def __getattr__(self, name):
            def call(*args):
                calls.append(name)
                if name == "get":
                    return iter(self.rows)
                self.rows = {"appendList": lambda: self.rows + args[0], "put": lambda: args[0], "clear": list}.get(name, lambda: self.rows)()

            return call

        def getListState(self, *_):
            return self

    class Times:
        def getCurrentWatermarkInMs(self):
            return 6

    watch, key = T.TargetWatch(), ("A",)
    watch.init(Store())
    watch.handleInitialState(key, Row(open=[{"pick_id": i, "target": float(i)} for i in range(50)]), None)
    watch.handleInputRows(key, iter([("A", None, 99.0, 7000), ("A", None, 30.0, 5000), ("A", None, 45.0, 6000)]), None)
    assert calls == ["appendList", "put", "registerTimer"]
    calls.clear()
    watch.handleInputRows(key, iter([("A", None, 20.0, 4000), ("A", None, 98.0, 9000)]), None)
    assert calls == ["get", "put", "registerTimer", "deleteTimer"]
    calls.clear()
    out = list(watch.handleExpiredTimer(key, Times(), None))
    assert calls == ["get", "put", "registerTimer"] and len(out) == 46
    assert {r.pick_id: r.at for r in out} == {i: 4000 if i <= 20 else 5000 if i <= 30 else 6000 for i in range(46)}
    watch.handleInputRows(key, iter([]), None)
    calls.clear()
    Times.getCurrentWatermarkInMs = lambda self: 7
    assert {(r.pick_id, r.at, r.price) for r in watch.handleExpiredTimer(key, Times(), None)} == {(i, 7000, 99.0) for i in range(46, 50)}
    assert calls == ["get", "clear"]


def test_first_hits_are_those_of_all_rows():
    rng = random.Random(24)
    rows = [(at, T.rank(price), price) for at, price in ((rng.randrange(40), rng.choice([1.0, 2.0, 3.0, 4.0, math.nan])) for _ in range(200))]
    for size in (1, 7, 1000):
        kept = T.first_hits(iter(rows), size)
        for target in (0.5, 1.0, 2.5, 4.0, 5.0):
            assert next((r[:2] for r in kept if r[1] >= target), None) == min((r[:2] for r in rows if r[1] >= target), default=None)
    assert T.first_hits([(1, 2.0, 2.0), (2, 1.0, 1.0), (1, 2.0, 2.0)], 2) == [(1, 2.0, 2.0)]


def test_target_watch_of_odd_rows(spark, tmp_path, rocksdb, monkeypatch):  # noqa: F811
    """Nulls are left out, NaN is above all prices, as in SQL, and a ticker's picks come in several rows."""
    monkeypatch.setattr(T, "TAKEN", 2)
    n = math.nan
    picks = [("A", i, 10.0 * i) for i in range(1, 6)] + [("A", None, 1.0), ("A", 9, None), (None, 8, 1.0), ("B", 7, 5.0)]
    prices = [("A", at(2), 30.0), ("A", at(1), None), ("A", at(3), n), ("A", None, 99.0), (None, at(1), 99.0), ("B", at(2), 4.0), ("Z", at(9), 1.0)]
    stream = feed(spark, f"{tmp_path}/in", prices, "ticker string, ts timestamp, price double")
    out = T.watch_targets(stream, spark.createDataFrame(picks, "ticker string, pick_id long, target double"), "2 days")
    T.run_append(out, str(tmp_path))
    got = sorted((r["pick_id"], r["ts"], str(r["price"])) for r in T.appended(spark, str(tmp_path), out.schema).collect())
    assert got == [(i, at(2), "30.0") for i in (1, 2, 3)] + [(i, at(3), "nan") for i in (4, 5)]
    assert [r["key"]["ticker"] for r in held(spark, str(tmp_path), "picks").collect()] == ["B"]
