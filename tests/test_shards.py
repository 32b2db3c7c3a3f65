"""A file per key: written and read by tasks, so that the driver holds no list of them."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F
from test_oracles import SF

from barloom import registry
from barloom.operators import structure
from barloom.sources import ingest
from barloom.sources.views import bars

SCHEMA = "name string, v struct<x: array<double>>"


def test_files_of_odd_keys(spark, tmp_path):
    keys = ["A", "a b", "x/y=z%", "é^[1]", "", None]
    rows = [(k, f"n{i}\n", {"x": [float(i), None]}) for i, k in enumerate(keys)] + [("A", None, None)]
    df = spark.createDataFrame(rows, f"ticker string, {SCHEMA}")
    for folder in (f"file://{tmp_path}/uri", f"{tmp_path}/path"):
        ingest.write_per_key(df, "ticker", folder)
        got = ingest.read_per_key(spark, folder, "ticker", SCHEMA)
        assert got.schema == df.schema
        want = sorted(((k or None, n, v and tuple(v["x"])) for k, n, v in rows), key=str)
        assert sorted(((r["ticker"], r["name"], r["v"] and tuple(r["v"]["x"])) for r in got.collect()), key=str) == want
        # Spark's reader finds the same keys
        assert {r[0] for r in spark.read.json(folder).select("ticker").collect()} == {k or None for k in keys}
    assert len(list(tmp_path.glob("path/ticker=*/*.json"))) == 5 and not list(tmp_path.glob("*.new"))
    (tmp_path / "path" / "ticker=A" / "shard.json").write_text('{"name": "n')
    with pytest.raises(Exception, match="(?i)malformed"):
        ingest.read_per_key(spark, f"{tmp_path}/path", "ticker", SCHEMA).collect()
    (tmp_path / "path" / "ticker=A" / "shard.json").unlink()
    with pytest.raises(Exception, match="shard.json"):
        ingest.read_per_key(spark, f"{tmp_path}/path", "ticker", SCHEMA).collect()


def test_files_written_again(spark, tmp_path):
    folder, df = str(tmp_path / "keys"), spark.range(3000).select(F.col("id").cast("string").alias("ticker"), "id")
    ingest.write_per_key(df, "ticker", folder)
    again = ingest.read_per_key(spark, folder, "ticker", "id long")
    ingest.write_per_key(again.where("id % 2 = 0").withColumn("id", -F.col("id")), "ticker", folder)
    assert sorted(ingest.read_per_key(spark, folder, "ticker", "id long").collect()) == sorted((str(i), -i) for i in range(0, 3000, 2))
    ingest.write_per_key(df.where("false"), "ticker", folder)
    assert ingest.read_per_key(spark, folder, "ticker", "id long").isEmpty()


@pytest.mark.parametrize("name", ["A15_shard_arrays", "A15_ticker_shards"])
def test_shards_are_not_listed(spark, monkeypatch, name):
    folders, kept = [], ingest.write_per_key
    monkeypatch.setattr(ingest, "write_per_key", lambda df, key, folder: folders.append(folder) or kept(df, key, folder))
    files = registry.queries()[name](spark, SF).inputFiles()
    shards = [f for f in files if folders[0].rsplit("/", 1)[1] in f]
    assert shards and all("/_manifest/" in f for f in shards)


def test_stored_swings_are_not_broadcast(spark):
    prepared = structure.Prepared(bars(spark, SF))
    with contextlib.redirect_stdout(io.StringIO()) as text:
        structure.cups(prepared.history, prepared.swing).explain()
    rims = [x for x in text.getvalue().splitlines() if "Join [ticker" in x and "_b" in x]
    assert len(rims) == 1 and "SortMergeJoin" in rims[0]
