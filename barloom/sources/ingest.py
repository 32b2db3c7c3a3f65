"""Feeds in, results out.

Readers resolve a feed's columns from its header once, on the driver, and read
all files of one header layout together. Upserts keep the latest version of a
key and never touch rows that have no new version.
"""

from __future__ import annotations

import io
import re
import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import groupby
from operator import itemgetter

import pandas as pd
import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import clean as C
from ..shared import written

#: A1: exact names, then words, then words that rule a header out.
FIELDS = {
    "date": (("date", "timestamp"), ("date",), ("update",)),
    "ticker": (("ticker", "symbol", "code"), ("ticker", "symbol"), ()),
    "open": (("open",), ("open",), ("interest",)),
    "high": (("high",), ("high",), ("52", "week")),
    "low": (("low",), ("low",), ("52", "week")),
    "close": (("close", "price", "last"), ("close", "price"), ("prev", "target", "change")),
    "volume": (("volume", "vol.", "vol"), ("volume",), ("average", "avg")),
}


def resolve(header: list[str], saved: dict[str, str] | None = None) -> dict[str, str]:
    """Field to header name: a saved map first, then exact names, then words."""
    out = dict(saved or {})
    low = {h.strip().lower(): h for h in header}
    for field, (exact, words, never) in FIELDS.items():
        if field in out:
            continue
        hit = next((low[x] for x in exact if x in low), None)
        if hit is None:
            for name, h in low.items():
                parts = re.split(r"[^a-z0-9.]+", name)
                if any(w in parts for w in words) and not any(n in name for n in never):
                    hit = h
                    break
        if hit is not None:
            out[field] = hit
    return out


def clean_bars(raw: DataFrame, columns: dict[str, str], as_of: str) -> DataFrame:
    """A1: typed bars; ``valid`` is false where date, ticker or close are missing."""
    get = lambda f: F.col(f"`{columns[f]}`") if f in columns else F.lit(None).cast("string")
    files = [c for c in raw.columns if c.startswith("_file")]
    # in steps, so that Spark reads each cell once however often its value is used
    read = raw.select(
        C.feed_date(get("date"), as_of).alias("date"), C.sanitize(get("ticker"), 20).alias("ticker"),
        *[C.number(get(f)).alias(f) for f in ("open", "high", "low", "close")], C.volume(get("volume")).alias("volume"), *files,
    )
    close = C.positive("close")
    df = read.select("date", C.symbol("ticker").alias("ticker"), *[F.coalesce(C.positive(f), close).alias(f) for f in ("open", "high", "low")], close.alias("close"), "volume", *files)
    return df.withColumn("valid", F.coalesce(F.col("date").isNotNull() & (F.length("ticker") > 0) & F.col("close").isNotNull(), F.lit(False)))


def read_feed(spark: SparkSession, paths: list[str], as_of: str, saved: dict[str, str] | None = None) -> DataFrame:
    """A1: all files of one header layout, with the file's name and time."""
    raw = spark.read.option("header", True).csv(paths)
    columns = resolve(raw.columns, saved)
    raw = raw.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_modification_time").alias("_file_time"))
    return clean_bars(raw, columns, as_of)


def discover(spark: SparkSession, folder: str, tracker: DataFrame) -> DataFrame:
    """A4: files whose path, time and size are new; names with ``sector`` are no feeds."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(folder)
    files = files.select("path", "modificationTime", "length").where(~F.lower("path").contains("sector"))
    key = F.sha2(F.concat_ws("|", "path", F.col("modificationTime").cast("string"), F.col("length").cast("string")), 256)
    return files.withColumn("file_hash", key).join(tracker.select("file_hash"), "file_hash", "left_anti")


def split_valid(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the rejected ones with a message."""
    bad = rows.where(~F.col("valid")).withColumn("error_message", F.concat_ws("; ", F.when(F.col("date").isNull(), "no valid date"), F.when(F.col("close").isNull(), "no valid close")))
    return rows.where("valid").drop("valid"), bad.drop("valid")


def _file_key(path: str) -> Column:
    """A path with one slash behind its scheme, as the two readers write it differently."""
    return F.regexp_replace(path, "^([a-z0-9]+:)/+", "$1/")


def file_outcomes(found: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tracker rows of the discovered files that gave a valid row, and the other files with a message."""
    # one row a file, for which all files are read once
    seen = written(rows.groupBy(_file_key("_file").alias("file_path")).agg(F.count_if("valid").alias("valid_rows")), "outcomes")
    df = found.withColumn("file_path", _file_key("path")).join(seen, "file_path", "left")
    read = F.coalesce(F.col("valid_rows") > 0, F.lit(False))
    good = df.where(read).select("file_path", F.col("modificationTime").alias("last_modified"), "file_hash")
    why = F.when(F.col("valid_rows").isNull(), "no rows").otherwise("no valid row")
    return good, df.where(~read).select("file_path", why.alias("error_message"))


def track(tracker: DataFrame, read: DataFrame) -> DataFrame:
    """The tracker with the files just read; a file that changed takes the place of its older self."""
    return upsert(tracker, read, ["file_path"], ["last_modified", "file_hash"])


STORED = "date date, ticker string, open double, high double, low double, close double, volume double, _file string, _file_time timestamp, file_id string"
TRACKED = "file_path string, last_modified timestamp, file_hash string"


def ingest_changed(spark: SparkSession, folder: str, as_of: str, store: str) -> list[str]:
    """A4 with L1: read the files below ``folder`` that are new or were edited since the last run; their paths.

    ``store``/rows keeps a partition a file, which an edited file overwrites: what it no longer holds is gone.
    ``store``/tracker has a version a run, written last, so a run that was cut off is done again whole.
    """
    spark.createDataFrame([], TRACKED).write.mode("append").parquet(f"{store}/tracker/run=0")
    runs = spark.read.schema(f"{TRACKED}, run int").parquet(f"{store}/tracker")
    n = runs.agg(F.coalesce(F.max("run"), F.lit(0))).head()[0]
    tracker = runs.where(F.col("run") == n).drop("run")
    found = discover(spark, folder, tracker)
    found = found.select(_file_key("path").alias("file_path"), F.col("modificationTime").alias("last_modified"), "file_hash", "path")
    paths = sorted(r[0] for r in found.select("path").collect())  # Spark lists them on the driver, too
    if not paths:
        return []
    rows, _ = split_valid(read_feed(spark, paths, as_of))
    rows = rows.withColumn("file_id", F.sha2(_file_key("_file"), 256))
    # a file without a valid row overwrites its partition with none: the rows it had go by the tracker's time
    # a large file is split over several tasks
    rows.select(*[c.split()[0] for c in STORED.split(", ")]).hint("rebalance", "file_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("file_id").parquet(f"{store}/rows")
    track(tracker, found.drop("path")).write.mode("overwrite").parquet(f"{store}/tracker/run={n + 1}")
    return paths


def changed_bars(spark: SparkSession, store: str) -> DataFrame:
    """The bars of all files as they were read last; of a (ticker, date) in several files that of the newest one."""
    runs = spark.read.schema(f"{TRACKED}, run int").parquet(f"{store}/tracker")
    now = runs.join(F.broadcast(runs.agg(F.max("run").alias("run"))), "run").select(F.sha2("file_path", 256).alias("file_id"), F.col("last_modified").alias("_file_time"))
    # rows of a version that the tracker does not name any more are left out
    rows = spark.read.schema(STORED).parquet(f"{store}/rows").join(now, ["file_id", "_file_time"], "left_semi")
    newest = F.row_number().over(Window.partitionBy("ticker", "date").orderBy(F.desc("_file_time"), F.desc("_file")))
    return rows.withColumn("_r", newest).where("_r = 1").select("ticker", "date", "open", "high", "low", "close", "volume")


def enrichment(raw: DataFrame, numbers: list[str], ratings: list[str]) -> DataFrame:
    """A3: numbers and ratings of a watchlist, with the consensus; rows without any value are dropped."""
    cols = {c: C.number(c) for c in numbers}
    scores = [C.rating(c) for c in ratings]
    df = raw.select("ticker", *[v.alias(k) for k, v in cols.items()], *[F.trim(c).alias(c) for c in ratings], C.consensus(*scores).alias("consensus"))
    return df.where(F.coalesce(*[F.col(c).cast("string") for c in [*numbers, "consensus"]]).isNotNull())


def normalise_history(raw: DataFrame, names: DataFrame) -> DataFrame:
    """Vendor history (Date, Price, Open, High, Low, Vol., _file) as bars; tickers that two files claim are left out."""
    key = C.filename_key(F.regexp_extract("_file", r"([^/]+)$", 1))
    # names are looked up and compared for each file once; of the rows only this asks for no more than their file
    files = raw.select("_file").distinct().withColumn("filename", key).join(names.select("filename", "ticker"), "filename")
    claims = Window.partitionBy("ticker")
    clear = files.withColumns({"_a": F.min("filename").over(claims), "_b": F.max("filename").over(claims)}).where("_a = _b and ticker is not null")
    fields = ("Open", "High", "Low")
    rows = raw.select("_file", C.us_date("Date").alias("date"), C.price("Price").alias("close"), *[C.price(c).alias(c.lower()) for c in fields], C.suffixed_volume("`Vol.`").alias("volume"))
    rows = rows.where("date is not null and close is not null").join(clear.select("_file", "ticker").hint("shuffle_hash"), "_file")
    return rows.select("date", "ticker", *[F.coalesce(c.lower(), "close").alias(c.lower()) for c in fields], "close", "volume")


def upsert(stored: DataFrame, new: DataFrame, keys: list[str], version: list[str | Column]) -> DataFrame:
    """The newest version of each new key, and the stored rows without one."""
    order = [F.desc(v) if isinstance(v, str) else v for v in version]
    latest = new.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").select(*stored.columns)
    return stored.join(latest.select(*keys), keys, "left_anti").unionByName(latest)


def run_history(runs: DataFrame, n: int) -> DataFrame:
    """The newest n runs."""
    return runs.orderBy(F.desc("run_at"), F.desc("id")).limit(n)


def save_run(run: DataFrame, trades: DataFrame, run_id: int, folder: str) -> None:
    """A run's summary (one row) and its trades, each in a partition of its own; saving a run again replaces it."""
    trades.write.mode("overwrite").parquet(f"{folder}/trades/run_id={run_id}")
    run.write.mode("overwrite").parquet(f"{folder}/runs/run_id={run_id}")


def saved_runs(spark: SparkSession, folder: str, n: int = 25) -> DataFrame:
    """The summaries of the newest n runs, without trades."""
    return run_history(spark.read.parquet(f"{folder}/runs").withColumnRenamed("run_id", "id"), n)


def saved_run(spark: SparkSession, folder: str, run_id: int) -> DataFrame:
    """The trades of one run; no other run's files are read. Empty where there is no such run."""
    return spark.read.parquet(f"{folder}/trades").where(F.col("run_id") == run_id)


def snapshots_since(log: DataFrame, min_date: str | None = None) -> DataFrame:
    """The logged scores in order of session and ticker, from a date on where one is given."""
    rows = log if min_date is None else log.where(F.col("session_date") >= F.lit(min_date).cast("date"))
    return rows.orderBy("session_date", "ticker")


def recent(rows: DataFrame, date: str, n: int | None = None) -> DataFrame:
    """Newest first, on one day the highest id first; the first n where a limit is given."""
    out = rows.orderBy(F.desc(date), F.desc("id"))
    return out if n is None else out.limit(n)


def versioned(spark: SparkSession, folder: str, lines: bool = False) -> DataFrame:
    """Every version of a JSON document of picks; one row per version, horizon and pick. ``lines``: many documents a file, each a line."""
    docs = spark.read.option("multiLine", not lines).json(folder).select("*", F.col("_metadata.file_modification_time").alias("version"))
    out = None
    for horizon in ("short", "medium", "long"):
        # a list that is empty in every version has no struct to read
        if horizon in docs.columns and "struct" in docs.schema[horizon].dataType.simpleString():
            rows = docs.select("version", F.lit(horizon).alias("horizon"), F.explode(horizon).alias("p")).select("version", "horizon", "p.*")
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


# --- sinks -----------------------------------------------------------------------------------

PRIVATE = ("shares", "cost", "cash", "position_size")


def publishable(df: DataFrame, private=PRIVATE) -> DataFrame:
    """Without account columns, NaN and infinities as null."""
    df = df.drop(*private)
    return df.withColumns({f.name: C.sane(f.name) for f in df.schema.fields if f.dataType.typeName() in ("double", "float")})


def write_topics(topics: dict[str, DataFrame], folder: str) -> None:
    """A JSON folder per topic, and ``manifest``: the topics' columns and rows, written last.

    Topics are not nested into one document, as that would pass all of them through one task.
    """
    counted = []
    for name, df in topics.items():
        publishable(df).write.mode("overwrite").json(f"{folder}/{name}")
        spark = df.sparkSession
        schema = publishable(df).schema
        counted.append(spark.read.schema(schema).json(f"{folder}/{name}").agg(F.lit(name).alias("topic"), F.lit(",".join(schema.names)).alias("columns"), F.count("*").alias("rows")))
    reduce(DataFrame.unionByName, counted).write.mode("overwrite").json(f"{folder}/manifest")


def _located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _removed(folder: str) -> None:
    system, at = _located(folder)
    if system.get_file_info(at).type != fs.FileType.NotFound:
        system.delete_dir(at)


def _opened(path: str, write: bool):
    """A stream on a file in the shared folder, in a task."""
    system, at = _located(path)
    if write:
        system.create_dir(at.rsplit("/", 1)[0], recursive=True)
        return system.open_output_stream(at, compression=None)
    return system.open_input_stream(at, compression=None)


def write_named(df: DataFrame, name: str, folder: str) -> int:
    """One CSV file for each value of ``name``, which is its file name; the number of files.

    A file is written by one task, in place, batch by batch: the rows come as lines, sorted by file, so nobody holds a file.
    """
    columns = [c for c in df.columns if c != name]
    header = pd.DataFrame(columns=columns).to_csv(index=False).encode()
    # quotes are doubled and blanks kept, as other writers of CSV do
    line = F.to_csv(F.struct(*columns), {"escape": '"', "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"})

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = out = None
        try:
            for b in batches:
                for file, lines in b.groupby("file", sort=False)["line"]:
                    if file != now:
                        if out is not None:
                            out.close()
                        now, out = file, _opened(f"{folder}/{file}", True)
                        out.write(header)
                        yield pd.DataFrame({"file": [file]})
                    out.write(("\n".join(lines) + "\n").encode())
        finally:
            if out is not None:
                out.close()

    rows = df.select(F.col(name).alias("file"), line.alias("line")).repartition("file").sortWithinPartitions("file")
    return rows.mapInPandas(put, "file string").count()


def write_document(topics: dict[str, DataFrame], folder: str, chunk: int = 1 << 20) -> str:
    """All topics as one nested JSON document, an array of rows each; its path.

    The rows are written in parts by many tasks. One task then copies the parts into the document, ``chunk`` bytes at a
    time, with commas for the ends of lines, so nobody holds a topic. It is renamed when it is whole. Each row, and each
    bracket, has a line of its own, which lets ``read_document`` read it in splits.
    """
    spark = next(iter(topics.values())).sparkSession
    parts = []
    for name, df in topics.items():
        publishable(df).write.mode("overwrite").json(f"{folder}/parts/{name}")
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(f"{folder}/parts/{name}").where("length > 0")
        parts.append(files.select(F.lit(name).alias("topic"), "path"))
    listed = reduce(DataFrame.unionByName, parts).withColumn("k", F.lit(0))
    target, names = f"{folder}/document.json", list(topics)

    def lines(paths: list[str]) -> Iterator[bytes]:
        first = True
        for p in paths:
            with _opened(re.sub("^file:/+", "file:///", p), False) as part:
                end = b"" if first else b",\n"
                while data := part.read(chunk):
                    # the line end of a row is written when the next row begins
                    body = data.rstrip(b"\n")
                    if body:
                        yield end + body.replace(b"\n", b",\n")
                        end = b""
                    if len(body) < len(data):
                        end = b",\n"
                first = False

    def copy(g: pd.DataFrame) -> pd.DataFrame:
        by = g.sort_values("path").groupby("topic")["path"].apply(list)
        with _opened(f"{target}.new", True) as out:
            for i, name in enumerate(names):
                out.write((("{\n" if i == 0 else ",\n") + f'"{name}": [\n').encode())
                for piece in lines(by.get(name, [])):
                    out.write(piece)
                out.write(b"\n]")
            out.write(b"\n}\n")
        system, at = fs.FileSystem.from_uri(target) if "://" in target else (fs.LocalFileSystem(), target)
        system.move(f"{at}.new", at)
        return pd.DataFrame({"bytes": [system.get_file_info(at).size]})

    listed.groupBy("k").applyInPandas(copy, "bytes long").collect()
    return target


def read_document(spark: SparkSession, path: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """Topics of a document that ``write_document`` wrote, as (``at``, ``row``): the place of a row and the row in the topic's schema.

    The file is read in splits by lines. A line's topic is that of the last head before it; heads are one row a topic.
    """
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.option("lineSep", "\n").text(path).select("value", place.alias("at"))
    head = F.regexp_extract("value", r'^"(.*)": \[$', 1)
    heads = sorted((tuple(r["at"]), r["topic"]) for r in lines.select("at", head.alias("topic")).where("topic <> ''").collect())

    def after(at: tuple) -> Column:
        return (F.col("at.block") > at[0]) | ((F.col("at.block") == at[0]) & (F.col("at.line") > at[1]))

    out = {}
    for (at, topic), following in zip(heads, [h[0] for h in heads[1:]] + [None]):
        if topic in schemas:
            rows = lines.where(after(at) & F.col("value").startswith("{"))
            rows = rows.where(~after(following)) if following else rows
            out[topic] = rows.select("at", F.from_json(F.rtrim("value", F.lit(",")), schemas[topic]).alias("row"))
    return out


#: What Spark's readers expect escaped in the name of a key's folder.
_ESCAPED = str.maketrans({c: f"%{ord(c):02X}" for c in [*map(chr, range(1, 32)), *"\"#%'*/:=?\\\x7f{[]^"]})
_KEY_LINE = pa.schema([("key", pa.string()), ("line", pa.string())])
_KEY_FILE = pa.schema([("key", pa.string()), ("file", pa.string())])


def write_per_key(df: DataFrame, key: str, folder: str) -> None:
    """A JSON file per key, in a folder named as Spark's writers name it; overwriting removes those of keys that are gone.

    Tasks write the files, row by row, and ``_manifest`` has their keys and paths. Spark's own writer and reader keep
    some kilobytes a file on the driver. The folder takes its name when it is whole.
    """
    df, new = publishable(df), f"{folder}.new"
    rows = df.withColumn(key, F.nullif(F.col(key).cast("string"), F.lit(""))).repartition(key).sortWithinPartitions(key)
    rows = rows.select(F.col(key).alias("key"), F.to_json(F.struct(*[c for c in df.columns if c != key])).alias("line"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = _located(new)
        pairs = (x for b in batches for x in zip(b["key"].to_pylist(), b["line"].to_pylist()))
        keys, files = [], []
        for k, of in groupby(pairs, itemgetter(0)):
            place = f"{key}={'__HIVE_DEFAULT_PARTITION__' if k is None else k.translate(_ESCAPED)}"
            part = f"{at}/{place}/.{uuid.uuid4().hex}"  # another attempt of the task has a file of its own
            system.create_dir(f"{at}/{place}", recursive=True)
            with system.open_output_stream(part, compression=None) as out:
                for _, line in of:
                    out.write(line.encode() + b"\n")
            system.move(part, f"{at}/{place}/shard.json")
            keys.append(k)
            files.append(f"{place}/shard.json")
            if len(keys) == 1000:
                yield pa.RecordBatch.from_arrays([keys, files], schema=_KEY_FILE)
                keys, files = [], []
        if keys:
            yield pa.RecordBatch.from_arrays([keys, files], schema=_KEY_FILE)

    _removed(new)
    rows.mapInArrow(put, "key string, file string").write.parquet(f"{new}/_manifest")
    _removed(folder)
    system, at = _located(new)
    system.move(at, _located(folder)[1])


def read_per_key(spark: SparkSession, folder: str, key: str, schema: str) -> DataFrame:
    """The rows of the files that ``write_per_key`` wrote, with their key as text. Tasks open the files that the
    manifest names, so that nobody lists them; a file that is missing or cut off is an error."""
    names = spark.read.schema("key string, file string").parquet(f"{folder}/_manifest")

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = _located(folder)
        keys, lines, held = [], [], 0
        for k, file in (x for b in batches for x in zip(b["key"].to_pylist(), b["file"].to_pylist())):
            with system.open_input_stream(f"{at}/{file}", compression=None) as f, io.BufferedReader(f) as text:
                for line in text:
                    keys.append(k)
                    lines.append(line.decode())
                    held += len(line)
                    if held >= 1 << 22:
                        yield pa.RecordBatch.from_arrays([keys, lines], schema=_KEY_LINE)
                        keys, lines, held = [], [], 0
        if keys:
            yield pa.RecordBatch.from_arrays([keys, lines], schema=_KEY_LINE)

    # names are small, so Spark would read all of them in a few tasks
    rows = names.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(get, "key string, line string")
    return rows.select(F.col("key").alias(key), F.from_json("line", schema, {"mode": "FAILFAST"}).alias("row")).select(key, "row.*")


def write_ledger(closed: DataFrame, summary: DataFrame, folder: str) -> None:
    """Trades that are not demos, and the summary rows below: parts are numbered in that order."""
    rows = closed.where(~F.coalesce(F.col("is_demo"), F.lit(False))) if "is_demo" in closed.columns else closed
    rows.unionByName(summary, allowMissingColumns=True).write.mode("overwrite").option("header", True).csv(folder)


def read_ledger(spark: SparkSession, folder: str, schema) -> DataFrame:
    """A ledger as it was written; a summary row has no ticker."""
    return spark.read.option("header", True).schema(schema).csv(folder)


def validate_topics(spark: SparkSession, folder: str, required: dict[str, list[str]]) -> list[str]:
    """What is missing or empty; an empty list means that all is well."""
    faults = []
    for name, columns in required.items():
        try:
            df = spark.read.json(f"{folder}/{name}")
        except Exception as e:
            faults.append(f"{name}: {type(e).__name__}")
            continue
        faults += [f"{name}: no column {c}" for c in columns if c not in df.columns]
        if df.isEmpty():
            faults.append(f"{name}: no rows")
    return faults


def chart_history(bars: DataFrame, n: int = 365) -> DataFrame:
    """Parallel arrays of a ticker's last n bars."""
    recent = bars.withColumn("_r", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date")))).where(F.col("_r") <= n)
    rows = recent.groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("date", "open", "high", "low", "close", "volume"))).alias("_b"))
    return rows.select("ticker", *[F.col(f"_b.{c}").alias(f"{c}s") for c in ("date", "open", "high", "low", "close", "volume")])
