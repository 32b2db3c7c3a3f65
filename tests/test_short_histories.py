"""Histories shorter than the spans: operators adapt to them, the matrix queries take fixed spans as their SQL does."""

import datetime as dt

import duckdb
import numpy as np
import pandas as pd
import pytest
from test_oracles import SF, TABLES, _rows

from barloom import registry
from barloom.functions.smoothing import smoothed


@pytest.fixture(scope="module")
def young(tmp_path_factory):
    """The smallest tables, but of a ticker only the last 70 to 160 days are left."""
    folder, c = tmp_path_factory.mktemp("young"), duckdb.connect()
    for t in TABLES:
        keep = "WHERE l_shipdate >= (SELECT max(l_shipdate) FROM src) - to_days(CAST(70 + l_suppkey * 10 AS integer))" if t == "lineitem" else ""
        c.execute(f"CREATE OR REPLACE VIEW src AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
        c.execute(f"COPY (SELECT * FROM src {keep}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return str(folder), c


@pytest.mark.parametrize("name", ["K2_C2_C13_C14_I12_matrix", "K2_I11_I12_C5_matrix_with_analogs", "I14_I15_notes", "A15_ticker_shards", "C4_C5_C6_screens"])
def test_matrix_queries_equal_their_sql(spark, young, name):
    folder, duck = young
    df = registry.queries()[name](spark, folder)
    r = duck.execute(registry.oracle_sql()[name])
    columns, want = [x[0] for x in r.description], r.fetchall()
    got = [tuple(x) for x in df.collect()]
    assert want and _rows(df.columns, got) == _rows(columns, want)


def test_spans_adapt_or_are_fixed():
    n = 18
    c = 100 + np.arange(n) % 5 * 1.0
    g = pd.DataFrame({"date": [dt.date(2020, 1, 1) + dt.timedelta(4 * i) for i in range(n)], "open": c, "high": c + 1, "low": c - 1, "close": c})
    for adapt, k in ((True, n), (False, 20)):
        y = c[0]
        for x in c[1:]:
            y += 2 / (k + 1) * (x - y)
        assert abs(smoothed(g, adapt)["ema_20"].iloc[-1] - y) < 1e-9
    some = smoothed(g.head(12), False)["w_rsi"]  # 44 days, so less than ten weeks
    assert some.notna().any() and smoothed(g.head(12))["w_rsi"].isna().all()
