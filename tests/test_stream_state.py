"""State that ends, results that leave once, restarts, and channels that fail."""

import datetime
import json

import pytest
from pyspark.errors import StreamingQueryException

from barloom.streaming import jobs
from barloom.streaming import stateful as T


@pytest.fixture
def rocksdb(spark):
    back = T.with_rocksdb(spark)
    yield
    back()


def at(day, hour=0):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(days=day, hours=hour)


def feed(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).parquet(folder)


def held(spark, folder, name):
    return spark.read.format("statestore").option("stateVarName", name).load(f"{folder}/checkpoint")


def test_target_watch_over_restarts(spark, tmp_path, rocksdb):
    """An earlier hit that comes late within the watermark counts; one behind it does not; a pick leaves once and its key goes."""
    schema = "ticker string, ts timestamp, price double"
    picks = spark.createDataFrame([("A", 1, 10.0), ("A", 2, 20.0), ("B", 3, 10.0), ("C", 4, 99.0)], "ticker string, pick_id long, target double")
    parts = [
        [("A", at(3), 12.0), ("B", at(3), 9.0), ("D", at(3), 50.0)],
        [("A", at(2), 11.0), ("B", at(4), 10.0), ("C", at(4), 1.0)],  # at(2) is earlier, and within two days of at(3)
        [("C", at(9), 1.0)],
        [("A", at(1), 25.0), ("A", at(10), 20.0), ("A", at(10), 21.0), ("B", at(10), 77.0)],  # at(1) is too late
        [("C", at(20), 1.0)],
    ]
    folder, runs, seen = str(tmp_path), [], []
    for rows in parts:
        out = T.watch_targets(feed(spark, f"{folder}/in", rows, schema), picks, "2 days")
        runs.append(T.run_append(out, folder))
        got = T.appended(spark, folder, out.schema).orderBy("batch", "pick_id").collect()
        seen.append([(r["ticker"], r["pick_id"], r["ts"], r["price"]) for r in got])
    assert seen[:2] == [[], [("A", 1, at(2), 11.0)]]  # the watermark has reached at(2)
    assert sorted(seen[2]) == seen[3] == [("A", 1, at(2), 11.0), ("B", 3, at(4), 10.0)]
    assert seen[4] == [*seen[3], ("A", 2, at(10), 20.0)]
    assert [r.dropped for r in runs] == [0, 0, 0, 1, 0] and sum(r.read for r in runs) == sum(map(len, parts))
    assert [r["key"]["ticker"] for r in held(spark, folder, "picks").collect()] == ["C"]


def test_alert_gate_ends_its_state(spark, tmp_path, rocksdb):
    schema = "alert_key string, ts timestamp"
    parts = [
        [("k", at(5, 3)), ("k", at(5, 4)), ("k", at(7)), ("q", at(6))],
        [("k", at(4, 1)), ("k", at(9))],  # 4 is within three days of 7: it fires, and 5 and 7 follow it too soon, if days is 4
        [("z", at(14))],
        [("k", at(2)), ("z", at(30))],  # 2 is behind the watermark
    ]
    folder, runs = str(tmp_path), []
    for rows in parts:
        out = T.gate_alerts(feed(spark, f"{folder}/in", rows, schema), 4, "3 days")
        runs.append(T.run_append(out, folder))
    got = sorted((r["alert_key"], r["event_date"].day - 1) for r in T.appended(spark, folder, out.schema).collect())
    assert got == [("k", 4), ("k", 9), ("q", 6), ("z", 14)]
    assert sum(r.dropped for r in runs) == 1
    assert {r["key"]["alert_key"] for r in held(spark, folder, "last").collect()} <= {"z"}
    assert [(r["key"]["alert_key"], r["user_map_key"]["day"] - 19723) for r in held(spark, folder, "pending").collect()] == [("z", 30)]


def test_channels_get_each_batch_once(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "alert_key string, n int").repartition(3)
    calls = []

    def broken(df, n):
        calls.append(n)
        if calls.count(n) < 3:
            raise OSError("down")

    files = T.file_channel(f"{tmp_path}/files")
    counted = lambda df, n: (files(df, n), calls.append(("files", n)))
    sink = T.fan_out({"broken": broken, "files": counted}, f"{tmp_path}/ledger")
    for _ in range(2):
        with pytest.raises(T.ChannelFault, match="broken: down"):
            sink(rows, 7)
    sink(rows, 7)
    sink(rows, 7)
    assert calls == [7, ("files", 7), 7, 7]
    assert sorted(r["alert_key"] for r in spark.read.json(f"{tmp_path}/files").collect()) == ["a", "b", "c"]
    assert {(r["batch"], r["channel"]) for r in spark.read.parquet(f"{tmp_path}/ledger").collect()} == {(7, "broken"), (7, "files")}


def test_worker_channel_sends_in_the_tasks(spark, tmp_path):
    def send(part):
        with open(f"{tmp_path}/{part[0]['id']}.json", "w") as f:
            json.dump([r["id"] for r in part], f)

    T.worker_channel(send, 4)(spark.range(10).repartition(2), 0)
    sent = [json.loads(p.read_text()) for p in tmp_path.glob("*.json")]
    assert sorted(x for part in sent for x in part) == list(range(10)) and max(map(len, sent)) <= 4


def test_a_failed_channel_stops_the_stream_and_a_restart_ends_it(spark, tmp_path):
    schema, tries = "event_id long, ts timestamp", []

    def channel(df, n):
        tries.append(df.count())
        if len(tries) == 1:
            raise OSError("down")

    stream = feed(spark, f"{tmp_path}/in", [(1, at(1)), (2, at(2))], schema)
    sink = T.fan_out({"mail": channel}, f"{tmp_path}/ledger")
    with pytest.raises(StreamingQueryException, match="mail: down"):
        T.run_append(stream, str(tmp_path), sink)
    T.run_append(stream, str(tmp_path), sink)
    assert tries == [2, 2] and T.appended(spark, str(tmp_path), stream.schema).count() == 2


def test_sessions_are_extended_and_late_rows_left_out(spark, tmp_path):
    schema = "user_id long, ts timestamp"
    parts = [[(1, at(1, 1)), (2, at(1, 1))], [(1, at(1, 2)), (2, at(4))], [(1, at(1, 3)), (2, at(9))]]  # the last 1 is late: the watermark stands at day 3
    for rows in parts:
        out = jobs.user_sessions(feed(spark, f"{tmp_path}/in", rows, schema), "90 minutes", "1 day")
        T.run_append(out, str(tmp_path))
    got = sorted((r["user_id"], r["start"], r["n"]) for r in T.appended(spark, str(tmp_path), out.schema).collect())
    assert got == [(1, at(1, 1), 2), (2, at(1, 1), 1), (2, at(4), 1)]
    assert spark.read.format("statestore").load(f"{tmp_path}/checkpoint").count() == 1  # the session of day 9


def test_the_store_is_put_back(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    T.with_rocksdb(spark)()
    assert spark.conf.get(name, None) == before
