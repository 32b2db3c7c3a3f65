"""What grows with the tables: documents a file, tickers a batch, passes over the bars."""

import datetime as dt
import json

import numpy as np
import pandas as pd
import pyarrow as pa

from barloom.functions import batches, smoothing
from barloom.plans import events, picks
from barloom.sources import ingest


def test_documents_are_lines_of_a_versions_files(spark, tmp_path):
    for v, status in enumerate(("active", "achieved")):
        docs = [json.dumps({"short": [{"ticker": f"T{i}", "status": status, "pick_date": "2020-01-02", "achieved_date": "2020-01-01"}], "medium": []}) for i in range(3)]
        (tmp_path / f"v{v}.json").write_text("\n".join(docs))
    rows = picks.first_seen(ingest.versioned(spark, str(tmp_path), lines=True)).collect()
    assert sorted((r["ticker"], r["statuses"], r["disordered"]) for r in rows) == [(f"T{i}", ["achieved", "active"], True) for i in range(3)]


def test_batches_of_tickers_equal_single_ones():
    r = np.random.default_rng(5)
    rows = []
    for i, n in enumerate((1, 2, 13, 25, 26, 27, 60, 75, 76, 90, 400, 30, 530)):
        days = np.sort(r.choice(np.arange(int(n * r.uniform(1, 4)) + 1), n, replace=False))
        c = np.round(100 * np.exp(np.cumsum(r.normal(0, 0.02, n))), 2)
        c[3:6] = c[3:4]
        rows.append(pd.DataFrame({"ticker": f"T{i:02}", "date": [dt.date(2020, 1, 1) + dt.timedelta(int(d)) for d in days], "open": c, "high": c + r.uniform(0, 1, n).round(2), "low": c - 1, "close": c, "volume": 1.0}))
    whole_ = pa.Table.from_pandas(pd.concat(rows), preserve_index=False)
    for adapt in (True, False):
        for size in (1, 7, 100, 10_000):
            out = pa.concat_tables([smoothing.smoothed_batch(t.combine_chunks(), adapt) for t in batches.whole(whole_.to_batches(max_chunksize=size))]).to_pandas()
            assert len(out) == whole_.num_rows
            for g in rows:
                have = out[out["ticker"] == g["ticker"].iloc[0]].reset_index(drop=True)
                pd.testing.assert_frame_equal(have, smoothing.smoothed(g, adapt), check_exact=True)


def test_bars_are_dealt_out_once(spark):
    from barloom.operators.structure import numbered
    from barloom.sources.views import bars

    plan = numbered(bars(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_walk_takes_tickers_in_batches_and_keeps_faults_apart(spark):
    n = 330
    d = [dt.date(2020, 1, 1) + dt.timedelta(i) for i in range(n)]
    t = {"date": d, "open": 10.0, "high": 10.1, "low": 9.9, "close": 10.0, "stop": 9.0, "target": 12.0, "signal": [i % 9 == 0 for i in range(n)], "raw_action": "ACCUMULATE", "sector": "A"} | {m: 1.0 for m in events.MEASURES}
    one = [pd.DataFrame({"ticker": k} | t) for k in ("A", "B")]
    one[1].loc[n - 1, "close"] = -1.0
    table = pa.Table.from_pandas(pd.concat(one), preserve_index=False)
    args = (events.TRAIN, events.TEST, events.STEP, events.HOLD)
    have, want = events._walked(table, args, False).to_pandas(), pd.concat([events.walk(g) for g in one], ignore_index=True)
    assert len(want) == 2
    pd.testing.assert_frame_equal(have.drop(columns="error"), want.drop(columns="sector"), check_dtype=False, check_exact=True)
    rows = events._walked(table, args, True).to_pandas()
    assert rows.loc[rows["ticker"] == "B", "error"].tolist() == ["ValueError: 1 closes that are no prices"] and (rows["ticker"] == "A").sum() == (want["ticker"] == "A").sum()


def test_analogs_read_the_bars_once(spark):
    from barloom.operators.structure import analog_match
    from barloom.sources.views import bars

    assert plan_of(analog_match(bars(spark, "/root/testdata/sf0.001"))).count("FileScan") == 1


def test_vendor_rows_meet_their_names_by_file_once(spark):
    raw = spark.createDataFrame([("1/2/2020", "5", "4", "6", "", "1.5K", "/x/a.csv")] * 2, "Date string, Price string, Open string, High string, Low string, `Vol.` string, _file string")
    names = spark.createDataFrame([("a", "A")], "filename string, ticker string")
    out = ingest.normalise_history(raw, names)
    assert out.count() == 2
    joins = [x for x in plan_of(out).splitlines() if "Join" in x]
    assert len(joins) == 2 and sum("_file" in x for x in joins) == 1  # files by name, rows by file


def test_charts_store_the_bars_once(spark, monkeypatch):
    from barloom.operators import structure
    from barloom.plans import charts
    from barloom.sources.views import bars

    labels = []
    kept = structure.stored
    monkeypatch.setattr(structure, "stored", lambda df, label: labels.append(label) or kept(df, label))
    out = charts.stock_charts(bars(spark, "/root/testdata/sf0.001"))
    assert sorted(labels) == ["bars", "histories", "swings"] and "lineitem" not in plan_of(out)
