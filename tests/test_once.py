"""Work that several parts of a result need is done once."""

import datetime as dt

from pyspark.sql import functions as F

from barloom.functions import clean as C
from barloom.plans import market
from barloom.sources import ingest


def made_once(df, label):
    """The rows come from the folder that they were written to."""
    return df.inputFiles() and all(f"barloom-{label}-" in f for f in df.inputFiles())


def test_a_listing_scans_once(spark):
    rows = spark.createDataFrame([(f"T{i}", "BUY ON DIP" if i % 3 else "ACCUMULATE", float(i)) for i in range(40)], "ticker string, raw_action string, score double")
    out = market.action_listing(rows, "BUY")
    assert made_once(out, "listing") and [(r["ticker"], r["remaining"]) for r in out.orderBy(F.desc("score")).limit(1).collect()] == [("T38", 16)]
    flags = market.rotation_flags(rows, rows.where("score < 3").select("ticker"))
    assert made_once(flags, "rotation") and sorted((r["held"], r["candidate"]) for r in flags.collect()) == [("T0", "T39"), ("T1", "T38"), ("T2", "T38")]


def test_outcomes_read_the_files_once(spark):
    found = spark.createDataFrame([(f"file:/in/{n}.csv", dt.datetime(2024, 1, 1), n) for n in "abc"], "path string, modificationTime timestamp, file_hash string")
    rows = spark.createDataFrame([("file:///in/a.csv", True), ("file:///in/a.csv", False), ("file:///in/b.csv", False)], "_file string, valid boolean")
    good, failed = ingest.file_outcomes(found, rows)
    assert made_once(good, "outcomes") and [r["file_hash"] for r in good.collect()] == ["a"]
    assert sorted(r["error_message"] for r in failed.collect()) == ["no rows", "no valid row"]


def test_odd_cells(spark):
    cells = ["", "--", "NaN", "none", " 5 ", "1,234.5", "12%", "-3", "1.0E7", "5%,", None]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, x string").orderBy("i")
    assert [r[0] for r in df.select(C.number("x")).collect()] == [None, None, None, None, 5.0, 1234.5, 12.0, -3.0, 1e7, 5.0, None]
    assert [r[0] for r in df.select(C.price("x")).collect()][7] is None and [r[0] for r in df.select(C.volume("x")).collect()][7] == 0.0
    days = ["1996-01-01", "36000", "1/2/1996", "13/2/1996", "2031-01-01", "1996-02-30", "5", None]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(days)], "i int, x string").orderBy("i")
    assert [str(r[0]) for r in df.select(C.feed_date("x", "2010-01-01")).collect()] == ["1996-01-01", "1998-07-24", "1996-01-02", "1996-02-13", "None", "None", "None", "None"]
