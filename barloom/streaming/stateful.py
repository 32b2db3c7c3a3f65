"""Stateful stream operators: results leave once, and state ends at the watermark.

Both processors are keyed and run on event time (``transformWithStateInPandas``,
which needs the RocksDB store). They hold what a late row within the watermark
could still change, and give it out from an event-time timer once the watermark
has passed it; so the result does not depend on the order of the files, and a
row is never taken back. Rows behind the watermark are left out by Spark, which
counts them (``Run.dropped``).
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import batched

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000


def rank(price: float) -> float:
    """A price in the order of Spark and SQL, where NaN is above all."""
    return math.inf if math.isnan(price) else price


def first_hits(rows: Iterable[tuple], size: int = 10_000) -> list[tuple]:
    """Of (at, rank, price), those that are the first hit of any target: in order, each ranked above all before it.

    The rows are taken ``size`` at a time, so that a ticker's rows are not sorted as a whole.
    """
    kept: list[tuple] = []
    for part in batched(rows, size):
        rising: list[tuple] = []
        for row in sorted([*kept, *part]):
            if not rising or row[1] > rising[-1][1]:
                rising.append(row)
        kept = rising
    return kept


class TargetWatch(StatefulProcessor):
    """A ticker's open picks, each with the earliest hit so far; a pick leaves when no earlier hit can come any more.

    Tickers are many and their rows few, so what a ticker costs is its calls to the store and its frames: rows are
    handed over instead of frames, a ticker's picks are read and written by one call each, and it has one timer, that
    of its earliest hit.
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.picks = handle.getListState("picks", "pick_id long, target double, at long, price double")
        self.taken: tuple = (None, {})

    def _held(self) -> dict:
        return {pick: (target, at, price) for pick, target, at, price in self.picks.get()}

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        new = {p["pick_id"]: (p["target"], None, None) for p in initialState.open}
        self.picks.appendList([(pick, *v) for pick, v in new.items()])
        self.taken = key, (self.taken[1] | new if self.taken[0] == key else new)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.taken[1] if self.taken[0] == key else self._held()  # the first rows follow on the initial state
        self.taken = None, {}
        if not held:
            return iter(())
        least, changed = min(rank(target) for target, _, _ in held.values()), {}
        hits = first_hits((at, rank(price), price) for _, _, price, at in rows if not price < least)
        ranks = [r for _, r, _ in hits]
        for pick, (target, at, price) in held.items():
            i = bisect_left(ranks, rank(target))
            if i < len(hits) and (at is None or hits[i][:2] < (at, rank(price))):
                changed[pick] = (target, hits[i][0], hits[i][2])
        if changed:
            before, held = self._next(held), held | changed
            after = self._next(held)
            self.picks.put([(pick, *v) for pick, v in held.items()])
            if after != before:
                self.handle.registerTimer(after)
                if before is not None:
                    self.handle.deleteTimer(before)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        held = self._held()
        rest = {pick: v for pick, v in held.items() if v[1] is None or v[1] // 1000 > now}
        if not rest:
            self.picks.clear()  # a ticker without picks has no state
        elif len(rest) < len(held):
            self.picks.put([(pick, *v) for pick, v in rest.items()])
        after = self._next(rest)
        if after is not None:
            self.handle.registerTimer(after)
        for pick, (_, at, price) in held.items():
            if pick not in rest:
                yield Row(ticker=key[0], pick_id=pick, at=at, price=price)

    @staticmethod
    def _next(held: dict) -> int | None:
        """When the earliest of the hits can leave."""
        return min((at // 1000 for _, at, _ in held.values() if at is not None), default=None)

    def close(self) -> None:
        pass


#: Picks of a ticker that are handed over as one row when a watch begins, at most.
TAKEN = 1000


def watch_targets(prices: DataFrame, picks: DataFrame, delay: str) -> DataFrame:
    """Each pick once, with the earliest price at or above its target (of prices at that time, the least).

    ``prices`` (a stream): ticker, ts, price. ``picks``: ticker, pick_id, target; they are taken in when the stream
    begins. A pick leaves as soon as the watermark, ``delay`` behind the latest price, has passed its hit. Rows with a
    null are left out.
    """
    rows = prices.select("ticker", "ts", "price", F.unix_micros("ts").alias("at")).withWatermark("ts", delay).where("ticker IS NOT NULL AND ts IS NOT NULL AND price IS NOT NULL")
    part = F.floor((F.row_number().over(Window.partitionBy("ticker").orderBy("pick_id")) - 1) / TAKEN)
    held = picks.select("ticker", "pick_id", "target").dropna().withColumn("part", part)
    held = held.groupBy("ticker", "part").agg(F.collect_list(F.struct("pick_id", "target")).alias("open")).select("ticker", "open")
    out = rows.groupBy("ticker").transformWithState(TargetWatch(), "ticker string, pick_id long, at long, price double", "Append", "EventTime", initialState=held.groupBy("ticker"))
    return out.select("ticker", "pick_id", F.timestamp_micros("at").alias("ts"), "price")


class AlertGate(StatefulProcessor):
    """L4: per key the dates that are still to be judged, and the last that fired.

    A date is judged when the watermark has passed its beginning, as all earlier dates are known then. The last date
    goes when it can hold nothing back any more.
    """

    def __init__(self, days: int) -> None:
        self.days = days

    def init(self, handle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "day int", "start long")
        self.last = handle.getValueState("last", "day int, start long")

    def _ends(self, start: int) -> int:
        return start + (self.days + 1) * DAY_MS

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get() if self.last.exists() else None
        days = {(int(d), int(s)) for b in rows for d, s in zip(b["day"], b["start"])}
        for day, start in sorted(days):
            if last is None or day - last[0] >= self.days:
                self.pending.updateValue((day,), (start,))
                self.handle.registerTimer(start)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        last = self.last.get() if self.last.exists() else None
        fired = []
        for (day,), (start,) in sorted(self.pending.iterator()):
            if start <= now:
                self.pending.removeKey((day,))
                if last is None or day - last[0] >= self.days:
                    last = (day, start)
                    fired.append(day)
        if fired:
            self.last.update(last)
            self.handle.registerTimer(self._ends(last[1]))
            yield pd.DataFrame({"alert_key": key[0], "day": fired})
        elif last is not None and self._ends(last[1]) <= now:
            self.last.clear()

    def close(self) -> None:
        pass


def gate_alerts(events: DataFrame, days: int, delay: str) -> DataFrame:
    """L4: an event's date fires if its key has not fired for ``days``; each date leaves once, in append mode.

    ``events`` (a stream): alert_key, ts. A key's state ends about ``days`` behind the watermark.
    """
    day = F.to_date("ts")
    rows = events.select("alert_key", "ts", F.unix_date(day).alias("day"), F.unix_millis(day.cast("timestamp")).alias("start")).withWatermark("ts", delay)
    out = rows.groupBy("alert_key").transformWithStateInPandas(AlertGate(days), "alert_key string, day int", "Append", "EventTime")
    return out.select("alert_key", F.date_from_unix_date("day").alias("event_date"))


# --- runs ------------------------------------------------------------------------------------


@dataclass
class Run:
    """What a run over what there was has read and left out behind the watermark."""

    read: int = 0
    dropped: int = 0
    batches: int = 0

    def add(self, progress: Iterable[dict]) -> None:
        for p in progress:
            self.read += p["numInputRows"]
            self.dropped += sum(s["numRowsDroppedByWatermark"] for s in p["stateOperators"])
            self.batches += 1


def run_append(out: DataFrame, folder: str, sink: Callable[[DataFrame, int], None] | None = None) -> Run:
    """Run ``out`` over what there is, from where the checkpoint in ``folder`` stands.

    A batch is written to a folder of its own below ``folder``/data, which a rerun of the batch overwrites; ``sink``, if
    given, gets the batch read back from there.
    """
    spark = out.sparkSession

    def write(batch: DataFrame, n: int) -> None:
        at = f"{folder}/data/batch={n}"
        batch.write.mode("overwrite").parquet(at)
        if sink:
            sink(spark.read.schema(batch.schema).parquet(at), n)

    q = out.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    run = Run()
    run.add(q.recentProgress)
    return run


def appended(spark: SparkSession, folder: str, schema) -> DataFrame:
    """All rows that the runs in ``folder`` have given out, with the number of their batch."""
    return spark.read.schema(schema).option("basePath", f"{folder}/data").parquet(f"{folder}/data").select("*", F.col("_metadata.file_path").alias("_path")).withColumn(
        "batch", F.regexp_extract("_path", r"batch=(\d+)", 1).cast("long")
    ).drop("_path")


def open_state(spark: SparkSession, folder: str) -> DataFrame:
    """What the aggregate of a run in ``folder`` still holds: its keys, and its buffers as name_number, as names repeat."""
    state = spark.read.format("statestore").load(f"{folder}/checkpoint")
    fields, names = state.schema["value"].dataType.fields, []
    for f in fields:
        names.append(f"{f.name}_{sum(n.rsplit('_', 1)[0] == f.name for n in names)}")
    kind = ", ".join(f"`{n}`: {f.dataType.simpleString()}" for n, f in zip(names, fields))
    return state.select("key.*", F.col("value").cast(f"struct<{kind}>").alias("v")).select("*", "v.*").drop("v")


def with_rocksdb(spark: SparkSession) -> Callable[[], None]:
    """Set the state store that keyed processors need; the returned function puts back what was set before."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    return lambda: spark.conf.unset(name) if before is None else spark.conf.set(name, before)


# --- channels --------------------------------------------------------------------------------

LEDGER = "batch long, channel string, at timestamp"


def file_channel(folder: str) -> Callable[[DataFrame, int], None]:
    """A channel of JSON files: a batch's folder is overwritten by a rerun."""
    return lambda rows, n: rows.write.mode("overwrite").json(f"{folder}/batch={n}")


def worker_channel(send: Callable[[list[dict]], None], size: int = 100) -> Callable[[DataFrame, int], None]:
    """A channel that the tasks call with at most ``size`` alerts at a time; the driver sees none of them."""

    def deliver(rows: Iterator) -> None:
        part: list[dict] = []
        for r in rows:
            part.append(r.asDict())
            if len(part) == size:
                send(part)
                part = []
        if part:
            send(part)

    return lambda rows, n: rows.foreachPartition(deliver)


class ChannelFault(Exception):
    """Channels that failed; the batch has to be run again."""


def fan_out(channels: dict[str, Callable[[DataFrame, int], None]], ledger: str) -> Callable[[DataFrame, int], None]:
    """M4: a sink that hands each batch to every channel, and to no channel twice.

    ``ledger`` holds a row per batch and channel, written when the channel has taken the batch. A channel that raises
    leaves the others; when all have had their turn the batch fails, and its rerun goes to the channels without a row.
    A file channel's folder is overwritten, so its alerts exist once whenever it failed; what a worker channel had sent
    before it failed is sent again.
    """

    def sink(rows: DataFrame, n: int) -> None:
        spark = rows.sparkSession
        spark.createDataFrame([], LEDGER).write.mode("append").parquet(ledger)
        taken = {r[0] for r in spark.read.schema(LEDGER).parquet(ledger).where(F.col("batch") == n).select("channel").collect()}  # one name a channel
        faults = []
        for name, send in channels.items():
            if name in taken:
                continue
            try:
                send(rows, n)
            except Exception as e:
                faults.append(f"{name}: {e}")
                continue
            spark.range(1).select(F.lit(n).cast("long").alias("batch"), F.lit(name).alias("channel"), F.current_timestamp().alias("at")).coalesce(1).write.mode("append").parquet(ledger)
        if faults:
            raise ChannelFault("; ".join(faults))

    return sink
