"""Neighbours, classifier, language model, similarity join, pipeline: brute force and edge cases."""

import collections
import math
import random
import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from barloom.llm import jaccard, neighbors, ppm, quality


def test_chi_square_quantile():
    assert abs(neighbors.chi_square(neighbors.quantile(0.9)) - 0.9) < 1e-9
    assert abs(neighbors.quantile(0.95) - 15.507) < 1e-3  # tabled value for 8 degrees of freedom


def test_neighbours_against_brute_force(spark):
    r = np.random.default_rng(3)
    x = r.standard_normal((700, 16)).astype("float32")
    x[300:340] = x[5]  # one vector many times
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    rows += [(1000, None), (1050, [0.0] * 16), (1100, [float("nan")] * 16), (1150, [1.0] * 15 + [None]), (1200, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as id", "2 as v")
    x = x.astype(float)
    unit = x / np.sqrt((x**2).sum(1, keepdims=True))
    for p, cell, least in ((0.95, 64, 0.9), (1 - 1e-12, 10_000, 1.0)):
        got = neighbors.nearest(df, F.col("id") % 50 == 0, p=p, cell=cell).toPandas()
        assert sorted(got["query_id"].unique()) == list(range(0, 700, 50))
        hit = 0
        for q, rows_ in got.groupby("query_id"):
            s = np.round(unit @ unit[q], 12)
            s[q] = -9
            best = np.lexsort((np.arange(700), -s))[:5]
            rows_ = rows_.sort_values("rank")
            assert rows_["rank"].tolist() == [1, 2, 3, 4, 5]
            assert np.allclose(rows_["score"], (unit @ unit[q])[rows_["vec_id"]], atol=1e-12)
            hit += len(set(best) & set(rows_["vec_id"]))
            if q == 300:  # ties of equal vectors go to the smaller ids
                assert rows_["vec_id"].tolist() == [5, 301, 302, 303, 304]
        assert hit >= least * 5 * 14
    few = neighbors.nearest(df.where("vec_id < 3"), F.col("id") == 0).collect()
    assert sorted(r["vec_id"] for r in few) == [1, 2]
    assert neighbors.nearest(df.limit(0), F.col("id") == 0).count() == 0


def test_neighbours_of_any_size(spark):
    """The least and the greatest doubles lie beside their like: what they point at is found, and they are."""
    r = np.random.default_rng(7)
    centres = r.standard_normal((40, 16))
    x = centres[r.integers(0, 40, 1600)] + 0.3 * r.standard_normal((1600, 16))
    for every, size in ((401, 1e-200), (397, 1e200), (211, 1e-308), (307, 1e150)):
        x[3::every] *= size
    x[7], x[8] = x[8] * 2.0**-600, x[8]
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    big = np.abs(x).max(1, keepdims=True)
    unit = x / big
    unit = unit / np.sqrt((unit**2).sum(1, keepdims=True))
    got = neighbors.nearest(df, (F.col("id") % 50 == 0) | (F.col("id") % 401 == 3) | F.col("id").isin(7, 8), cell=256).toPandas()
    hits, queries = 0, got.groupby("query_id")
    assert {3, 7, 8, 404, 805} <= set(queries.groups)
    for q, own in queries:
        s = np.round(unit @ unit[q], 12)
        s[q] = -9
        best = np.lexsort((np.arange(len(x)), -s))[:5]
        assert len(own) == 5 and np.allclose(own["score"], s[own["vec_id"]], atol=1e-9)
        hits += len(set(best) & set(own["vec_id"]))
    assert hits >= 0.95 * 5 * len(queries)
    assert got[(got["query_id"] == 7) & (got["rank"] == 1)]["vec_id"].tolist() == [8]


def _brute_ppm(train, text, order):
    seq = lambda t: [0xFE] * order + list(t.encode()) + [0xFF]
    ctx = collections.defaultdict(collections.Counter)
    for t in train:
        b = seq(t)
        for j in range(order, len(b)):
            for k in range(order + 1):
                ctx[bytes(b[j - k : j])][b[j]] += 1
    b, total = seq(text), 0.0
    for j in range(order, len(b)):
        gone = set()
        for k in range(order, -1, -1):
            live = {s: n for s, n in ctx.get(bytes(b[j - k : j]), {}).items() if s not in gone}
            if not live:
                continue
            n = sum(live.values())
            if b[j] in live:
                total += math.log10((live[b[j]] - 0.5) / n)
                break
            total += math.log10(0.5 * len(live) / n)
            gone |= set(live)
        else:
            total -= math.log10(255 - len(gone))
    return total


def test_ppm_equals_brute_force(spark):
    r = random.Random(4)
    texts = ["".join(r.choice("ab cé\n") for _ in range(r.randint(0, 80))) for _ in range(40)] + [None, "", "abab", "abab", "ZZ zz Ω"]
    rows = [(i, t, i % 3 != 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, tr boolean").selectExpr("*", "1 as gram", "'x' as word", "2 as block")
    for block in (10**9, 500):
        out = {x["doc_id"]: x for x in ppm.ppm_scores(df, F.col("tr"), order=3, block_bytes=block).collect()}
        train = [t or "" for _, t, x in rows if x]
        count = collections.Counter(w for t in train for w in ppm.tokens(t))
        n, v = sum(count.values()), len(count)
        for i, t, _ in rows:
            words = ppm.tokens(t or "")
            assert (out[i]["n_tokens"], out[i]["n_known"], out[i]["train_tokens"]) == (len(words), sum(count[w] > 0 for w in words), n)
            base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
            assert math.isclose(out[i]["base_score"], base, rel_tol=1e-9)
            assert math.isclose(out[i]["score"], _brute_ppm(train, t or "", 3), rel_tol=1e-9)


def test_ppm_without_training(spark):
    df = spark.createDataFrame([(1, "ab")], "doc_id long, text string")
    out = ppm.ppm_scores(df, F.lit(False)).collect()
    assert math.isclose(out[0]["score"], -3 * math.log10(255)) and out[0]["n_known"] == 0
    assert ppm.ppm_scores(df.limit(0), F.lit(True)).count() == 0


def _classes(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and sets[b]:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_jaccard_components_equal_brute_force(spark):
    r = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    line = " ".join(r.choice(words) for _ in range(12))
    rows = [(1000, None), (1001, ""), (1002, "one"), (1003, "ONE"), (1004, "a b c"), (1005, "a b c"), (1006, " \n ")]
    for base in range(4):
        text = [r.choice(words) for _ in range(60)]
        for _ in range(40):
            own = list(text)
            for _ in range(r.randint(0, 4)):
                own[r.randrange(len(own))] = r.choice(words)
            if r.random() < 0.3:
                own = own[: r.randint(50, 60)]
            rows.append((len(rows), " ".join(own)))
    rows += [(len(rows) + i, line + " " + " ".join(r.choice(words) for _ in range(r.randint(2, 30)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "'t' as token")
    for n, percent in ((4, 85), (5, 80), (2, 60)):
        want = _classes(rows, n, percent)
        for chunk in (10**6, 300):
            got = jaccard.jaccard_components(df, n, percent, chunk_tokens=chunk).collect()
            assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in got} == want
    assert jaccard.jaccard_components(df.limit(0), 4, 85).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.range(300).selectExpr("id as a", "id + 1 as b").unionByName(spark.createDataFrame([(900, 901), (901, 900)], "a long, b long"))
    got = {x["id"]: x["component"] for x in jaccard.components(edges).collect()}
    assert got == {**{i: 0 for i in range(301)}, 900: 900, 901: 900}


def test_quality_on_labelled_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet").where("doc_id % 2 = 0"))
    odd = docs.withColumn("keep", F.lit("clash"))
    out = quality.judge(odd, model, F.col("source"), F.col("lang")).select("doc_id", "_judged.*").toPandas()
    labels = pd.read_parquet(f"{sf}/labels.parquet").query("doc_id % 2 == 1").merge(out, on="doc_id")
    good = (labels["quality"] == 1) & (labels["toxic"] == 0)
    assert labels[good]["keep"].mean() > 0.97
    assert labels[labels["quality"] == 0]["keep"].mean() < 0.1


def test_quality_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, None), (2, "", "h"), (3, "some words here", None), (3, "some words here", None)], "doc_id long, text string, h string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = quality.judge(docs, quality.fit(docs, labels), F.col("h"), F.lit(None)).select("doc_id", "_judged.keep").collect()
    assert sorted((r["doc_id"], r["keep"]) for r in out) == [(1, False), (2, False), (3, True), (3, True)]
    assert quality.judge(docs.limit(0), quality.fit(docs, labels), F.col("h"), F.lit("p")).count() == 0


def test_sparse_sites_shrink_toward_the_global_rate(spark):
    rows = [("a", "x", 1.0)] * 50 + [("a", "y", 1.0)] + [("b", "x", 0.0)] * 50 + [("c", "z", 0.0)]
    sites, mean, prior = quality.site_rates(spark.createDataFrame(rows, "host string, path string, vote double"))
    got = {r["host"]: r["host_rate"] for r in sites.collect()}
    assert got["b"] < got["c"] < mean < got["a"] and prior >= 2


def test_pipeline(spark):
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = docs.withColumns({"extra": F.lit(1), "_id": F.lit("x")})
    stage = extra.unionByName(extra.limit(3))
    for name, f in cp.STAGES[:-1]:
        stage = f(spark, stage, sf)
        assert stage.columns == extra.columns, name
    ids = [r["doc_id"] for r in stage.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and 0 < len(ids) < docs.count()
    packed = cp.run(spark, sf)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(ids)


def test_similar_texts_of_repeated_ids(spark):
    """An id with two texts leads two classes; copies of either are linked to it, in groups and in chunks of groups."""
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(1, a + " x"), (1, b + " y"), (2, a), (3, b), (3, b), (4, "c d e f g"), (4, "c d e f g"), (5, None), (5, a)]
    for n in range(30):
        rows.append((10 + n, f"{b} z{n}"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for chunk in (jaccard.CHUNK_TOKENS, 50):
        out = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in jaccard.jaccard_components(df, 4, 85, chunk_tokens=chunk).collect()}
        assert out == {(1, 38): 1, (2, 37): 1, (3, 37): 1, (4, 2): 4, (5, 0): 5, (5, 37): 1} | {(10 + n, 38): 1 for n in range(30)}
