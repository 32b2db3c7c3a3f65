"""Queries of the streams in append mode: events come in five parts, out of order, some of them too late.

An event's slot is the eight days it lies in. Every tenth event comes one part
late, which the watermark of eight days allows; every tenth of the first slot
comes last, behind it. After each part the stream runs over what there is and
stops; the next run goes on from the checkpoint.
"""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from ..shared import shared_dir
from ..sources.views import table
from ..streaming import jobs
from ..streaming import stateful as T
from . import query
from .indicators import rounded
from .sqltext import rnds

DELAY = "8 days"
#: Slots of events, those that come too late, and where the watermark stands in the end.
ARRIVED = """ev AS (SELECT *, event_id % 10 = 7 AND day(ts) <= 8 AS late FROM events), wm AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 8 DAY AS wm FROM events),
ok AS (SELECT * FROM ev WHERE NOT late)"""


def in_parts(spark, d, label, build, sink=None):
    """Feed the events part by part; (folder, schema, runs). ``build`` makes the result from the stream.

    A run that fails is started again, as a scheduler would do.
    """
    folder = shared_dir(spark, label)
    slot = F.floor((F.dayofmonth("ts") - 1) / 8)
    late = (F.col("event_id") % 10 == 7) & (slot == 0)
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    events = events.withColumn("part", F.when(late, 4).when(F.col("event_id") % 10 == 3, slot + 1).otherwise(slot).cast("int"))
    runs, schema, back = [], None, T.with_rocksdb(spark)
    try:
        for part in range(5):
            events.where(F.col("part") == part).drop("part").write.mode("append").parquet(f"{folder}/in")
            out = build(jobs.events_stream(spark, f"{folder}/in"))
            schema = out.schema
            while True:
                try:
                    runs.append(T.run_append(out, folder, sink))
                    break
                except StreamingQueryException as e:
                    if "ChannelFault" not in str(e):
                        raise
                    out = build(jobs.events_stream(spark, f"{folder}/in"))
    finally:
        back()
    return folder, schema, runs


def given(spark, d, label, build):
    folder, schema, _ = in_parts(spark, d, label, build)
    return T.appended(spark, folder, schema)


@query("L5_bars_append", f"""WITH {ARRIVED} SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, max(value) AS high, min(value) AS low, arg_min(value, {{'t': ts, 'e': event_id}}) AS open, arg_max(value, {{'t': ts, 'e': event_id}}) AS close
FROM ok, wm WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= wm GROUP BY 1, 2""")
def l5(spark, d):
    df = given(spark, d, "l5a", lambda s: jobs.bars_by_window(s, "event_type", "value", delay=DELAY))
    return df.select("start", "event_type", "n", "high", "low", "open", "close")


@query("L6_moving_windows_append", f"""WITH {ARRIVED}, x AS (SELECT *, date_trunc('hour', ts) - INTERVAL 1 HOUR * k.k AS start FROM ok, range(0, 3) k(k))
SELECT start, event_type, count(*) AS n, max(value) AS high, min(value) AS low, {rnds(6, 'avg(value) AS mean')} FROM x, wm WHERE start + INTERVAL 3 HOUR <= wm GROUP BY 1, 2""")
def l6(spark, d):
    df = given(spark, d, "l6a", lambda s: jobs.bars_by_window(s, "event_type", "value", "3 hours", DELAY, "1 hour"))
    return df.select("start", "event_type", "n", "high", "low", *rounded(df, 6, "mean"))


@query("L7_sessions_append", f"""WITH {ARRIVED},
g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM ok),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS end, count(*) AS n FROM s, wm GROUP BY user_id, k, wm HAVING max(ts) + INTERVAL 6 HOUR <= wm""")
def l7(spark, d):
    """A gap of six hours, so that rows that come a part late extend sessions of the part before."""
    return given(spark, d, "l7a", lambda s: jobs.user_sessions(s, "6 hours", DELAY)).select("user_id", "start", "end", "n")


@query("L5_late_events", f"""WITH {ARRIVED} SELECT (SELECT count(*) FROM events) AS read, (SELECT count(*) FROM ok, wm WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= wm) AS closed,
(SELECT count(*) FROM ok, wm WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR > wm) AS open, (SELECT count(*) FROM ev WHERE late) AS dropped""")
def l5x(spark, d):
    """Of the events of L5: read, in closed bars, in bars that the state still holds, and left out behind the watermark."""
    folder, schema, runs = in_parts(spark, d, "l5b", lambda s: jobs.bars_by_window(s, "event_type", "value", delay=DELAY))
    closed = T.appended(spark, folder, schema).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("closed"))
    held = T.open_state(spark, folder).agg(F.coalesce(F.sum("count_0"), F.lit(0)).alias("open"))
    read = sum(r.read for r in runs)
    return closed.crossJoin(held).select(F.lit(read).cast("long").alias("read"), "closed", "open", (F.lit(read) - F.col("closed") - F.col("open")).cast("long").alias("dropped"))


#: A key's dates, of which those that begin before the watermark are judged; the chain from the first.
GATED = f"""WITH RECURSIVE {ARRIVED},
d AS (SELECT DISTINCT event_type || ':' || user_id % 20 AS alert_key, CAST(ts AS date) AS event_date FROM ok),
n AS (SELECT a.alert_key, a.event_date, min(b.event_date) AS after FROM d a LEFT JOIN d b ON a.alert_key = b.alert_key AND b.event_date >= a.event_date + 3 GROUP BY 1, 2),
fired AS (SELECT * FROM n WHERE (alert_key, event_date) IN (SELECT (alert_key, min(event_date)) FROM n GROUP BY alert_key) UNION ALL SELECT n.* FROM fired f JOIN n ON n.alert_key = f.alert_key AND n.event_date = f.after),
gated AS (SELECT alert_key, event_date FROM fired, wm WHERE event_date <= wm)"""


def gate(stream):
    keyed = stream.select(F.concat_ws(":", "event_type", (F.col("user_id") % 20).cast("string")).alias("alert_key"), "ts")
    return T.gate_alerts(keyed, 3, DELAY)


@query("L4_alert_gate_append", GATED + " SELECT alert_key, event_date, (SELECT count(*) FROM ev WHERE late) AS dropped FROM gated")
def l4(spark, d):
    folder, schema, runs = in_parts(spark, d, "l4a", gate)
    return T.appended(spark, folder, schema).select("alert_key", "event_date", F.lit(sum(r.dropped for r in runs)).cast("long").alias("dropped"))


@query("L8_target_watch_append", f"""WITH {ARRIVED}, p AS (SELECT DISTINCT user_id, k.k, user_id * 2 + k.k AS pick_id, 50.0 + 40 * k.k AS target FROM events, range(0, 2) k(k)),
h AS (SELECT CAST(ok.user_id AS varchar) AS ticker, pick_id, arg_min(value, {{'t': ts, 'v': value}}) AS price, min(ts) AS ts FROM ok JOIN p ON p.user_id = ok.user_id AND value >= target GROUP BY 1, 2)
SELECT ticker, pick_id, h.ts, price FROM h, wm WHERE date_trunc('millisecond', h.ts) <= wm""")
def l8(spark, d):
    """Two picks a ticker; each leaves once, in whichever of the five runs the watermark passes its hit."""
    k = F.col("user_id")
    users = table(spark, d, "events").select("user_id").distinct()
    picks = users.select(k.cast("string").alias("ticker"), F.explode(F.array(F.struct((k * 2).alias("id"), F.lit(50.0).alias("t")), F.struct((k * 2 + 1).alias("id"), F.lit(90.0).alias("t")))).alias("p"))
    picks = picks.select("ticker", F.col("p.id").alias("pick_id"), F.col("p.t").alias("target"))
    df = given(spark, d, "l8a", lambda s: T.watch_targets(s.select(k.cast("string").alias("ticker"), "ts", F.col("value").alias("price")), picks, DELAY))
    return df.select("ticker", "pick_id", "ts", "price")


@query("M4_L4_alert_channels", GATED + " SELECT channel, alert_key, event_date, 1 AS copies FROM gated, (VALUES ('archive'), ('chat'), ('mail')) c(channel)")
def m4(spark, d):
    """Every gated alert reaches three channels once, although the second one fails on the first three batches it gets, and these are run again."""
    folder = shared_dir(spark, "m4")
    failed = []

    def flaky(rows, n):
        send = T.file_channel(f"{folder}/out/channel=chat")
        if n not in failed and len(failed) < 3:
            failed.append(n)
            send(rows.limit(1), n)
            raise OSError("no answer behind the first alert")
        send(rows, n)

    channels = {"archive": T.file_channel(f"{folder}/out/channel=archive"), "chat": flaky, "mail": T.file_channel(f"{folder}/out/channel=mail")}
    in_parts(spark, d, "m4", gate, T.fan_out(channels, f"{folder}/ledger"))
    rows = spark.read.schema("alert_key string, event_date date, channel string").json(f"{folder}/out")
    return rows.groupBy("channel", "alert_key", "event_date").agg(F.count("*").cast("int").alias("copies"))
