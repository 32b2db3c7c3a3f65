"""The incremental jobs as Structured Streaming queries.

Each ``start_*`` returns a running query; with ``trigger(availableNow=True)`` it
reads what there is and stops, which is how the batch twins are checked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.picks import fired_dates
from ..sources import ingest


#: Tasks, and so files, that a month of the bars table is written by, at most.
MONTH_PARTS = 8


def events_stream(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    """A file stream with the schema of the files there are; at most so many files a batch.

    A single file has to be named by a pattern, as the file source wants a folder otherwise.
    """
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", per_trigger).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def bars_by_window(stream: DataFrame, key: str, value: str, length: str = "1 hour", delay: str = "1 hour", slide: str | None = None) -> DataFrame:
    """L5 (tumbling) and L6 (sliding, with ``slide``): bars of event-time windows; later events than ``delay`` are left out."""
    over = F.window("ts", length, slide) if slide else F.window("ts", length)
    grouped = stream.withWatermark("ts", delay).groupBy(over.alias("w"), key).agg(
        F.min_by(value, F.struct("ts", "event_id")).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"),
        F.max_by(value, F.struct("ts", "event_id")).alias("close"), F.count("*").alias("n"), F.avg(value).alias("mean"),
    )
    return grouped.select(F.col("w.start").alias("start"), key, "open", "high", "low", "close", "n", "mean")


def user_sessions(stream: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions that end after a gap."""
    s = F.session_window("ts", gap)
    out = stream.withWatermark("ts", delay).groupBy("user_id", s.alias("s")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def collect_stream(out: DataFrame, folder: str, mode: str = "append"):
    """Run ``out`` over what there is; the result lies in ``folder``. In complete mode the last batch's result stays."""

    def sink(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{folder}/data")

    q = out.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return out.sparkSession.read.schema(out.schema).parquet(f"{folder}/data")


def start_ingest(spark: SparkSession, folder: str, header: list[str], as_of: str, target: str, checkpoint: str, per_trigger: int = 1000):
    """L1 to L3: new CSV files become bars; impossible rows go to quarantine; the latest file wins per (ticker, date).

    The table lies in ``target``/bars by month. A batch merges and rewrites only the months that it touches: the merged
    rows are written to ``target``/merged/batch=<n> first, and a rerun that finds them whole goes on from there. They go
    when the next batch begins.
    """
    columns = ingest.resolve(header)
    raw = spark.readStream.schema(", ".join(f"`{h}` string" for h in header)).option("header", True).option("maxFilesPerTrigger", per_trigger).csv(folder)
    raw = raw.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_modification_time").alias("_file_time"))
    rows = ingest.clean_bars(raw, columns, as_of)
    schema = "date date, ticker string, open double, high double, low double, close double, volume double, _file_time timestamp, month string"
    month = F.date_format("date", "yyyy-MM")

    def at(path: str):
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p

    def exists(path: str) -> bool:
        fs, p = at(path)
        return fs.exists(p)

    def sink(batch: DataFrame, n: int) -> None:
        fs, before = at(f"{target}/merged/batch={n - 1}")
        fs.delete(before, True)
        merged = f"{target}/merged/batch={n}"
        if not exists(f"{merged}/_SUCCESS"):
            batch.persist()  # the files are read once
            good, bad = ingest.split_valid(batch)
            bad.write.mode("overwrite").parquet(f"{target}/quarantine/batch={n}")
            good = good.withColumn("month", month)
            stored = spark.read.schema(schema).parquet(f"{target}/bars") if exists(f"{target}/bars") else spark.createDataFrame([], schema)
            touched = [r[0] for r in good.select("month").distinct().collect()]  # one short text a month
            stored = stored.where(F.col("month").isin(touched))
            ingest.upsert(stored, good, ["ticker", "date"], ["_file_time", "_file"]).write.mode("overwrite").parquet(merged)
            batch.unpersist()
        # a month is spread over a few tasks, by ticker
        out = spark.read.schema(schema).parquet(merged).repartition("month", F.pmod(F.xxhash64("ticker"), F.lit(MONTH_PARTS)))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(f"{target}/bars")

    return rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dedupe_alerts_stream(stream: DataFrame, days: int) -> DataFrame:
    """L4: an event fires if its key has not fired for ``days``; the state is the key's distinct dates.

    ``stream``: alert_key string, event_date date. For complete mode: a late date is put in its place, which may move
    later ones, so that the result is that of the batch twin for any order of files.
    """
    dates = stream.groupBy("alert_key").agg(F.array_sort(F.collect_set("event_date")).alias("d"))
    return dates.select("alert_key", F.explode(fired_dates("d", days)).alias("event_date"))


def targets_reached_stream(prices: DataFrame, picks: DataFrame) -> DataFrame:
    """Per pick, the earliest price of the stream at or above its target (of prices at that time, the least).

    ``prices``: ticker, ts, price. ``picks``: ticker, target; of a ticker's targets the least counts. For complete mode:
    a later batch may hold an earlier hit. Hits are reduced in each task before the shuffle.
    """
    open_picks = picks.groupBy("ticker").agg(F.min("target").alias("target"))
    hits = prices.join(open_picks, "ticker").where("price >= target")
    first = hits.groupBy("ticker").agg(F.min(F.struct("ts", "price")).alias("first"))
    return first.select("ticker", "first.ts", "first.price")


def notify(batch: DataFrame, channels: list) -> list[str]:
    """M4: hand a small batch of alerts to every channel once; a channel's failure is reported and leaves the others."""
    rows, faults = [r.asDict() for r in batch.collect()], []
    for send in dict.fromkeys(channels):
        try:
            send(rows)
        except Exception as e:
            faults.append(f"{getattr(send, '__name__', send)}: {e}")
    return faults
