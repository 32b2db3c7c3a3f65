"""The registered corpus queries over whole tables of sf0.001, each against a plain computation of its contract."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.llm import packing, quality
from barloom.llm.registry import queries

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs():
    d = pd.read_parquet(f"{SF}/documents.parquet")
    return {int(i): t or "" for i, t in zip(d["doc_id"], d["text"])}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))


def test_op1_base_findings(spark, docs):
    out = {r["doc_id"]: r for r in queries()["op1_secret_scan"](spark, SF).collect()}
    assert set(out) == set(docs)
    for i, t in docs.items():
        assign = re.finditer(r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t)
        found = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in assign if len(m[2]) >= 6]
        found += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        found += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        joined = ",".join(x[2] for x in sorted(found))
        assert out[i]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [out[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(x[1] == k for x in found) for k in range(3)]
        assert set(filter(None, joined.split(","))) <= set(out[i]["spans"].split(","))


def test_op3_base_score(spark, docs):
    out = {r["doc_id"]: r for r in queries()["op3_ppm_score"](spark, SF).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in docs}
    count = collections.Counter(w for i, t in docs.items() if not held[i] for w in [*words(t), None])
    n, v = sum(count.values()), len(count)
    assert set(out) == set(docs)
    for i, t in docs.items():
        own = [*words(t), None]
        assert (out[i]["held_out"], out[i]["n_tokens"], out[i]["n_known"], out[i]["train_tokens"]) == (held[i], len(own), sum(count[w] > 0 for w in own), n)
        assert math.isclose(out[i]["base_score"], sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own), rel_tol=1e-9)
    kept = [i for i in docs if held[i] and len(docs[i]) > 100]
    assert sum(out[i]["score"] for i in kept) > sum(-math.log10(257) * (len(docs[i].encode()) + 1) for i in kept)


def test_op4_payloads(spark):
    pages = pd.read_parquet(f"{SF}/pages.parquet")
    body = {int(i): (h or "").encode() for i, h in zip(pages["page_id"], pages["html"])}
    newest = {b: i for i, b in sorted(body.items())}
    out = {r["page_id"]: r for r in queries()["op4_warc_chunks"](spark, SF).collect()}
    assert set(out) == set(body)
    for i, b in body.items():
        r = out[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if newest[b] == i else ("revisit", newest[b]))


def test_op5_recall(spark):
    e = pd.read_parquet(f"{SF}/embeddings.parquet")
    x = np.array(e.iloc[:, 1].tolist(), float)
    ids, unit = e["vec_id"].to_numpy(), x / np.sqrt((x**2).sum(1, keepdims=True))
    out = queries()["op5_srs_neighbors"](spark, SF).toPandas()
    hits = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        s = unit @ unit[q]
        s[q] = -9
        best = ids[np.lexsort((ids, -s))[:5]]
        own = out[out["query_id"] == ids[q]]
        hits, total = hits + len(set(best) & set(own["vec_id"])), total + 5
    assert hits >= 0.9 * total


def test_op9_classes(spark, docs):
    sets = {}
    for i, t in docs.items():
        w = words(t)
        sets[i] = frozenset(tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))) if w else frozenset()
    name = {i: i for i in docs}
    for a in sorted(docs):
        for b in sorted(docs):
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) and name[a] != name[b]:
                lo, hi = sorted((name[a], name[b]))
                name = {i: lo if x == hi else x for i, x in name.items()}
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries()["op9_group_jaccard"](spark, SF).collect()}
    assert out == {i: (len(sets[i]), name[i]) for i in docs}


def test_op10_pieces(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.vocabulary())
    out = queries()["op10_tier_packing"](spark, SF).toPandas()
    for i, own in out.sort_values("start").groupby("doc_id"):
        ids = np.array([*t.encode(docs[i], add_special_tokens=False).ids, 1], "<u4")
        assert own["start"].tolist() == np.cumsum([0, *own["length"][:-1]]).tolist() and own["length"].sum() == len(ids)
        assert own["ids_crc32"].tolist() == [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(own["start"], own["length"])]
    assert set(out["doc_id"]) == set(docs)


def _strength(sites, mean):
    n = sum(s["n"] for s in sites)
    within = max(sum(s["squares"] - s["votes"] ** 2 / s["n"] for s in sites) / n, 1e-9)
    extra = (sum(s["n"] * (s["votes"] / s["n"] - mean) ** 2 for s in sites) - within * (len(sites) - 1)) / n
    return min(max(within / extra, 2.0), 1e6) if extra > 0 else 1e6


def test_op6_verdicts_equal_a_plain_empirical_bayes(spark):
    """Sparse and large sites: grouped votes, priors from the spread, shrinking path to host to all, without the own vote."""
    r = random.Random(12)
    weights = [12.0 if f == "digits" else 0.0 for f in quality.FEATURES]
    model = quality.Classifier(spark, weights, -6.0, {}, 0.5)
    rows = []
    for host, share, n in (("big", 0.9, 120), ("bad", 0.1, 120), ("mixed", 0.5, 60), ("one", 1.0, 1), ("two", 0.0, 2), (None, 0.5, 4)):
        for _ in range(n):
            k = sum(r.random() < share for _ in range(10))
            rows.append((len(rows), host, r.choice(["en", "de", None]), "1" * k + "a" * (10 - k)))
    rows += [(900, "big", "en", " \t\n"), (901, "big", "en", None), rows[3]]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string").selectExpr("*", "'x' as m", "1 as host", "2 as c0", "3 as votes")
    out = quality.judge(df, model, F.col("source"), F.col("lang"))
    assert out.columns == [*df.columns, "_judged"]
    got = collections.defaultdict(list)
    for x in out.select("doc_id", "_judged.*").collect():
        got[x["doc_id"]].append((x["evidence"], x["path_rate"], x["keep"]))
    evidence = [-20.0 if not (t or "").split() else sum(a * b for a, b in zip(weights, quality.measures(t, {}))) - 6.0 for *_, t in rows]
    vote = [1 / (1 + math.exp(-e)) for e in evidence]

    def sites(*key):
        out = {}
        for row, v in zip(rows, vote):
            s = out.setdefault(tuple(row[k] for k in key), {"n": 0, "votes": 0.0, "squares": 0.0})
            s["n"], s["votes"], s["squares"] = s["n"] + 1, s["votes"] + v, s["squares"] + v * v
        return out

    hosts, paths, mean = sites(1), sites(1, 2), sum(vote) / len(vote)
    for_hosts, for_paths = _strength(hosts.values(), mean), _strength(paths.values(), mean)
    for (i, host, lang, _), e, v in zip(rows, evidence, vote):
        h, p = hosts[(host,)], paths[(host, lang)]
        host_rate = (h["votes"] + for_hosts * mean) / (h["n"] + for_hosts)
        rate = min(max((p["votes"] - v + for_paths * host_rate) / (p["n"] - 1 + for_paths), 1e-6), 1 - 1e-6)
        logit = e + math.log(rate / (1 - rate)) - math.log(mean / (1 - mean))
        for x in got[i]:
            assert np.allclose(x[:2], (e, rate), rtol=1e-6) and x[2] == (logit > 0)
    assert sum(map(len, got.values())) == len(rows)


def test_op6_is_total(spark, docs):
    out = queries()["op6_site_quality"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(docs) and not any(r["keep"] for r in out if not docs[r["doc_id"]].split())
