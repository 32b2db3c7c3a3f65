"""Streams over files that do not come in the order of time."""

import datetime as dt
import os

from barloom.plans import picks
from barloom.streaming import jobs

SCHEMA = "event_id long, user_id long, ts timestamp, value double"


def late_files(spark, folder):
    """Three files, one a batch, the latest times first."""
    t = dt.datetime(2020, 1, 10, 12)
    files = [[(1, 7, t, 60.0), (2, 8, t, 70.0)], [(3, 7, t - dt.timedelta(days=4), 80.0)], [(4, 7, t - dt.timedelta(days=8), 40.0), (5, 7, t - dt.timedelta(days=2), 90.0)]]
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/w{i}")
        os.makedirs(f"{folder}/in", exist_ok=True)
        name = next(x for x in os.listdir(f"{folder}/w{i}") if x.endswith(".parquet"))
        os.rename(f"{folder}/w{i}/{name}", f"{folder}/in/{i}.parquet")
        os.utime(f"{folder}/in/{i}.parquet", (1_600_000_000 + i * 60,) * 2)
    return jobs.events_stream(spark, f"{folder}/in", per_trigger=1)


def test_target_takes_the_earliest_hit_of_all_batches(spark, tmp_path):
    stream = late_files(spark, tmp_path).selectExpr("cast(user_id as string) as ticker", "ts", "value as price")
    open_picks = spark.createDataFrame([("7", 50.0), ("8", 70.0), ("9", 1.0)], "ticker string, target double")
    out = jobs.collect_stream(jobs.targets_reached_stream(stream, open_picks), str(tmp_path / "l8"), "complete")
    assert sorted((r["ticker"], r["ts"].day, r["price"]) for r in out.collect()) == [("7", 6, 80.0), ("8", 10, 70.0)]


def test_late_dates_fire_as_in_the_batch_twin(spark, tmp_path):
    stream = late_files(spark, tmp_path)
    keyed = stream.selectExpr("cast(user_id as string) as alert_key", "to_date(ts) as event_date")
    out = jobs.collect_stream(jobs.dedupe_alerts_stream(keyed, 3), str(tmp_path / "l4"), "complete")
    rows = spark.read.parquet(f"{tmp_path}/in").selectExpr("cast(user_id as string) as alert_key", "to_date(ts) as event_date")
    want = sorted(map(tuple, picks.dedupe_alerts(rows, 3).collect()))
    assert sorted(map(tuple, out.collect())) == want
    assert [d.day for k, d in want if k == "7"] == [2, 6, 10]
