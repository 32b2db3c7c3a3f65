"""Stored bars, edited files, documents, faults by ticker, detectors of users, and slots."""

import datetime
import json
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions import isolation
from barloom.operators import detectors, indicators, structure
from barloom.plans import picks
from barloom.queries.user_detector import KeyReversal
from barloom.sources import ingest, layout

BAR = "ticker string, date date, open double, high double, low double, close double, volume double"


def panel(spark, tickers=6, days=200):
    start = datetime.date(2024, 1, 1)
    rows = []
    for t in range(tickers):
        for i in range(days):
            c = 100 + (i * (7 + t)) % 23 - (i % (5 + t)) * 1.5
            rows.append((f"T{t}", start + datetime.timedelta(days=i), c, c + 1.0, c - 1.0, c + (i % 3) * 0.4, 1000.0))
    return spark.createDataFrame(rows, BAR)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return len(re.findall(r"Exchange hashpartitioning\(ticker", df._jdf.queryExecution().executedPlan().toString()))


@pytest.fixture
def table(spark, tmp_path):
    layout.create_bars(panel(spark), "test_bars", 4, f"{tmp_path}/bars")
    yield "test_bars"
    spark.sql("DROP TABLE test_bars")


def test_lookups_prune(spark, table):
    one = layout.stored_ticker(spark, table, "T3")
    assert one.count() == 200
    assert re.search(r"SelectedBucketsCount: 1 out of 4", one._jdf.queryExecution().toString())
    back = layout.stored_lookback(spark, table, 20)
    assert back.count() == 6 * 21 and back.agg(F.max("date")).head()[0] == layout.latest_date(spark, table)
    assert re.search(r"PartitionFilters: \[.*month.*>= 2024-06", back._jdf.queryExecution().toString())


def test_grouping_by_ticker_shuffles_no_bar(spark, table):
    df = spark.table(table)
    assert shuffles(indicators.history_trim(df)) == 0
    assert shuffles(structure.swings(df)) == 0
    kept = layout.stored(panel(spark), "x", 4)
    assert shuffles(structure.histories(kept)) == 0 and kept.count() == 1200
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("barloom_")]


def test_upsert_rewrites_touched_months(spark, table, tmp_path):
    def files():
        return {str(p.relative_to(tmp_path)) for p in (tmp_path / "bars").rglob("*.parquet")}

    before = files()
    new = panel(spark).where("date >= '2024-03-05' and date < '2024-03-09' and ticker = 'T1'").withColumn("close", F.lit(7.0))
    new = new.withColumn("v", F.lit(2)).unionByName(new.withColumns({"v": F.lit(1), "close": F.lit(8.0)}))
    assert layout.upsert_stored(new, table, ["v"]) == ["2024-03"]
    gone = before - files()
    assert gone and all("month=2024-03" in f for f in gone)
    df = spark.table(table)
    assert df.count() == 1200 and df.where("close = 7").count() == 4 and df.where("close = 8").count() == 0
    assert layout.upsert_stored(new.limit(0), table, ["v"]) == []


HEADER = ["Date", "Ticker", "Close"]


def write_csv(path, rows):
    path.write_text("\n".join([",".join(HEADER), *(",".join(map(str, r)) for r in rows)]) + "\n")


def test_edited_file_replaces_its_rows(spark, tmp_path):
    feed, store = tmp_path / "feed", f"{tmp_path}/store"
    feed.mkdir()
    write_csv(feed / "a.csv", [("2024-01-01", "AAA", 1), ("2024-01-02", "AAA", 2)])
    write_csv(feed / "b.csv", [("2024-01-02", "AAA", 20), ("2024-01-02", "BBB", 3)])
    write_csv(feed / "sectors.csv", [("2024-01-01", "ZZZ", 9)])
    run = lambda: sorted(p.rsplit("/", 1)[1] for p in ingest.ingest_changed(spark, str(feed), "2025-01-01", store))
    bars = lambda: {(r["ticker"], r["date"].day): r["close"] for r in ingest.changed_bars(spark, store).collect()}
    assert run() == ["a.csv", "b.csv"] and run() == []
    assert bars() == {("AAA.CA", 1): 1.0, ("AAA.CA", 2): 20.0, ("BBB.CA", 2): 3.0}
    write_csv(feed / "a.csv", [("2024-01-02", "AAA", 5), ("2024-01-09", "CCC", 6)])  # edited in place: the first of January is gone, and it is the newer file now
    assert run() == ["a.csv"]
    assert bars() == {("AAA.CA", 2): 5.0, ("BBB.CA", 2): 3.0, ("CCC.CA", 9): 6.0}
    write_csv(feed / "a.csv", [("never", "AAA", "-")])  # no valid row: what it had is gone
    assert run() == ["a.csv"] and run() == []
    assert bars() == {("AAA.CA", 2): 20.0, ("BBB.CA", 2): 3.0}


@pytest.mark.parametrize("chunk", [1, 7, 1 << 20])
def test_document_parses(spark, tmp_path, chunk):
    df = spark.range(40).select(F.concat(F.lit('q"\n,}'), F.col("id").cast("string")).alias("text"), F.when(F.col("id") % 2 == 0, float("nan")).otherwise(1.5).alias("x"))
    path = ingest.write_document({"rows": df.repartition(5), "none": df.limit(0), "one": df.limit(1)}, f"{tmp_path}/doc", chunk)
    doc = json.loads(open(path).read())
    assert list(doc) == ["rows", "none", "one"] and doc["none"] == [] and len(doc["one"]) == 1
    assert sorted(r["text"] for r in doc["rows"]) == sorted(f'q"\n,}}{i}' for i in range(40)) and sum("x" in r for r in doc["rows"]) == 20


def test_a_fault_is_a_row(spark):
    def f(g):
        if g["ticker"].iloc[0] == "T2":
            raise KeyError("gone")
        return pd.DataFrame({"ticker": g["ticker"].iloc[:1], "n": len(g)})

    good, bad = isolation.faults(isolation.per_ticker(panel(spark, 4, 20), f, "ticker string, n long"))
    assert sorted(map(tuple, good.collect())) == [("T0", 20), ("T1", 20), ("T3", 20)]
    assert [tuple(r) for r in bad.collect()] == [("T2", "KeyError: 'gone'")]


def test_smoothing_goes_on_without_the_bad_ticker(spark):
    b = panel(spark, 3, 60)
    twice = b.where("ticker = 'T1'").orderBy("date").limit(1)
    rows = indicators.smoothed_or_error(b.unionByName(twice))
    good, bad = isolation.faults(rows)
    assert [tuple(r) for r in bad.collect()] == [("T1", "ValueError: two bars on 2024-01-01")]
    whole = indicators.with_smoothed(b.where("ticker <> 'T1'"))
    assert sorted(map(str, good.collect())) == sorted(map(str, whole.select(*good.columns).collect()))


def test_a_users_detector_joins_detect_all(spark):
    turns = [("T0", datetime.date(2025, 1, 1 + i), 10.0, 10.5 + i % 2 * 3, 9.5 - i % 2, 10.0 + i % 2 * 3, 1.0) for i in range(6)]
    b = panel(spark, 4, 120).unionByName(spark.createDataFrame(turns, BAR))
    alone = {tuple(r)[:5] for r in detectors.matches(b, KeyReversal).collect()}
    assert alone == {("T0", "Key Reversal", "bullish", 120 + i, 121 + i) for i in (0, 2, 4)}
    detectors.register("mine", KeyReversal)
    try:
        with pytest.raises(ValueError):
            detectors.register("mine", KeyReversal)
        found = {tuple(r)[:5] for r in structure.detect_all(b, dedupe=False).select("ticker", "pattern", "direction", "start_index", "end_index").collect()}
    finally:
        detectors.unregister("mine")
    assert alone <= found and "mine" not in structure.DETECTORS
    assert detectors.matches(b.limit(0), KeyReversal).count() == 0


def test_overlaps_equal_a_plain_walk(spark):
    """More matches than any former limit would matter for lie in stretches; ties, nesting and equal starts."""
    import random

    r = random.Random(4)
    rows = [("A", "P", "up", s, s + r.randrange(1, 9), None, None, {"x": 1.0}, r.choice([0.5, 0.7, 0.9])) for s in (r.randrange(400) for _ in range(300))]
    df = spark.createDataFrame(rows, "ticker string, pattern string, direction string, start_index int, end_index int, start_date date, end_date date, levels map<string,double>, quality double")
    kept = []
    for x in sorted(rows, key=lambda x: (x[3], x[4])):
        if kept and x[3] <= kept[-1][4]:
            if (x[8], x[4] - x[3]) > (kept[-1][8], kept[-1][4] - kept[-1][3]):
                kept[-1] = x
        else:
            kept.append(x)
    got = sorted((r["start_index"], r["end_index"], r["quality"]) for r in structure.dedupe_overlaps(df).collect())
    assert got == [(x[3], x[4], x[8]) for x in kept]


POOL = "horizon string, ticker string, sector string, score double, price double, source string"


def refill(spark, live, pool, excluded=(), distressed=()):
    out = picks.refill_slots(
        spark.createDataFrame(list(live), "ticker string, horizon string"), spark.createDataFrame(list(pool), POOL),
        spark.createDataFrame(list(excluded), "ticker string, horizon string, excluded_date date"), spark.createDataFrame([(s,) for s in distressed], "sector string"), "2024-02-02",
    )
    return sorted((r["horizon"], r["ticker"], r["source"]) for r in out.collect())


def test_slots_equal_a_plain_walk(spark):
    import random

    for seed in range(6):
        r = random.Random(seed)
        pool = [(h, f"S{r.randrange(25)}", r.choice("xyz"), float(r.randrange(12)), 1.0, r.choice(["scan", "pre_breakout"]) if h == "short" else "scan") for h in ("short", "medium", "long") for _ in range(r.randrange(40))]
        best = {}
        for p in pool:
            k = (p[0], p[1])
            best[k] = max(best.get(k, p), p, key=lambda x: (x[3], x[4], x[2], x[5]))
        live = [(f"S{r.randrange(25)}", h) for h in ("short", "medium") for _ in range(r.randrange(4))]
        today, other = datetime.date(2024, 2, 2), datetime.date(2024, 2, 1)
        excluded = [(f"S{r.randrange(25)}", r.choice(["short", "long"]), r.choice([today, other])) for _ in range(8)]
        out, taken = [], {t for t, _ in live}
        for h, n in picks.SLOTS.items():
            need, pre = n - sum(x == h for _, x in live), 0
            for p in sorted((p for p in best.values() if p[0] == h), key=lambda p: (p[5] == "pre_breakout", -p[3], p[1])):
                if need <= 0:
                    break
                if p[1] in taken or (p[1], h, today) in excluded or (h == "medium" and p[2] == "z"):
                    continue
                if p[5] == "pre_breakout":
                    if pre:
                        continue
                    pre = 1
                taken.add(p[1])
                out.append((h, p[1], p[5]))
                need -= 1
        assert refill(spark, live, pool, excluded, ["z"]) == sorted(out)
    assert refill(spark, [], []) == []


def test_names_equal_all_pairs(spark):
    """Tokens that most names hold are compared by classes; results are those of all pairs, ties included."""
    import random

    from barloom.functions import clean

    r = random.Random(1)
    words = ["alpha", "beta", "gamma"] + [f"w{i}" for i in range(60)]
    name = lambda: " ".join({*r.sample(words[:3], r.randrange(4)), *r.sample(words[3:], r.randrange(1, 5))})
    left, right = [(f"l{i}", name()) for i in range(150)], [(f"r{i:03}", name()) for i in range(150)]
    left += [("lx", "alpha"), ("ly", "alpha beta gamma"), ("lz", ""), ("lq", "nowhere")]
    df = [spark.createDataFrame(x, "key string, name string") for x in (left, right)]
    sets = [{k: set(t) for k, t in x.select("key", clean.name_tokens("name")).collect()} for x in df]
    want = {}
    for k, a in sets[0].items():
        all_ = [(-len(a & b) / min(len(a), len(b)), key) for key, b in sets[1].items() if a & b]
        if all_:
            back, key = min(all_)
            want[k] = (key, -back, -back >= 0.5)
    for common in (5, 40, 10_000):
        got = {x["left_key"]: (x["right_key"], x["ratio"], x["matched"]) for x in picks.fuzzy_match(*df, common=common).collect()}
        assert got == want
    # nobody pairs the names of a common token
    many = [spark.range(3000).select(F.concat(F.lit(p), F.col("id").cast("string")).alias("key"), F.concat(F.lit("alpha "), F.lit(p), F.col("id").cast("string")).alias("name")) for p in "lr"]
    out = picks.fuzzy_match(*many, common=100)
    assert [tuple(x) for x in out.groupBy("right_key", "ratio", "matched").count().collect()] == [("r0", 0.5, True, 3000)]


def test_document_is_read_in_splits(spark, tmp_path):
    df = spark.range(300).select(F.concat(F.lit('{"\n],'), F.col("id").cast("string")).alias("text"), "id")
    path = ingest.write_document({"none": df.limit(0), "rows": df.repartition(5), "one": df.limit(1)}, f"{tmp_path}/doc")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    try:
        doc = ingest.read_document(spark, path, {"none": "id bigint", "rows": "text string, id bigint", "one": "map<string, string>"})
        assert doc["rows"].rdd.getNumPartitions() > 1
        assert sorted((r["row"]["id"], r["row"]["text"]) for r in doc["rows"].collect()) == [(i, f'{{"\n],{i}') for i in range(300)]
        assert doc["none"].isEmpty() and [list(r["row"]) for r in doc["one"].collect()] == [["text", "id"]]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_named_files_are_written_row_by_row(spark, tmp_path):
    rows = [("a.csv", "x,y", 1.5), ("a.csv", ' "q"', None), ("b.csv", None, 2.0)]
    df = spark.createDataFrame(rows, "file string, Text string, N double").repartition(3)
    assert ingest.write_named(df, "file", str(tmp_path)) == 2
    read = pd.read_csv(tmp_path / "a.csv").sort_values("Text")
    assert list(read.columns) == ["Text", "N"] and list(read["Text"]) == [' "q"', "x,y"]
    assert (tmp_path / "b.csv").read_text().splitlines() == ["Text,N", ",2.0"]


def test_named_files_hold_no_file_in_a_worker(spark, tmp_path, monkeypatch):
    """A file of more rows than an Arrow batch is written whole, and no group is handed to a worker."""
    from pyspark.sql.group import GroupedData

    def never(*_, **__):
        raise AssertionError("a file was gathered")

    monkeypatch.setattr(GroupedData, "applyInPandas", never)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        df = spark.range(1000).select(F.concat(F.lit("f"), (F.col("id") % 3).cast("string")).alias("file"), "id")
        assert ingest.write_named(df, "file", str(tmp_path)) == 3
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(i for k in range(3) for i in pd.read_csv(tmp_path / f"f{k}")["id"]) == list(range(1000))
