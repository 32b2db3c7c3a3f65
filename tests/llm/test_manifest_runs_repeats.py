"""Merkle manifests, periodic runs and repeated passages against plain computations, with odd inputs."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.llm import merkle, periodic, repeats
from barloom.llm.registry import queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ("*", "'x' as pos", "1 as tree", "2 as node", "3 as id", "'k' as key", "4 as n", "5 as tag", "6 as words")


def sha(s):
    return hashlib.sha256(s.encode("utf-8")).hexdigest()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# --- Merkle ----------------------------------------------------------------------------------


def _leaf(*fields):
    return sha("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def _levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def _proof(levels, i):
    out = []
    for nodes in levels[:-1]:
        out.append((i & 1, nodes[i ^ 1] if i ^ 1 < len(nodes) else None))
        i >>= 1
    return out


def _plain_manifest(rows):
    """Of (doc_id, text, lang, source, n_chars): the rows of the contract."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0], _leaf(r[0], r[3], r[2], r[4], r[1]), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: _levels([x[1] for x in sorted(groups[g], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))]) for g in order}
    top = _levels([trees[g][-1][0] for g in order])
    out = []
    for at, g in enumerate(order):
        for i, (doc, leaf, r) in enumerate(sorted(groups[g], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))):
            proof = _proof(trees[g], i) + _proof(top, at)
            hit = doc is not None and zlib.crc32(str(doc).encode()) % 7 == 0 and r[4] is not None
            node = _leaf(doc, r[3], g, r[4] + 1, r[1]) if hit else leaf
            for left, other in proof:
                node = sha(node if other is None else other + node if left else node + other)
            out.append((doc, leaf, trees[g][-1][0], top[-1][0], sha("".join(x[1] for x in proof if x[1])), node, node == top[-1][0]))
    return out


def _order(rows):
    return sorted(rows, key=str)


def _manifest(df, levels=merkle.LEVELS):
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    hit = (F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("n_chars").isNotNull()
    claim = F.when(hit, merkle.digest(*fields[:3], F.col("n_chars") + 1, fields[4]))
    out = merkle.manifest(df, "doc_id", "lang", merkle.digest(*fields), claim, levels)
    return out.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")), "folded", F.col("folded") == F.col("root"))


@pytest.mark.parametrize("levels", [1, 2, 10])
def test_manifest_of_odd_rows(spark, levels):
    """Null ids, groups and fields, repeated rows, a lone group, superblocks of two leaves and more groups than a superblock."""
    r = random.Random(levels)
    rows = [(i, r.choice([None, "", "é" * 3, "a b"]), r.choice([None, "en", "", "é", "z"]), r.choice([None, "s"]), r.choice([None, 3, 4])) for i in range(23)]
    rows += [rows[4], rows[4], (None, "t", "en", "s", 1), (7, "other", rows[7][2], None, 2), (99, "x" * 200_000, "alone", "s", 200_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(x) for x in _manifest(df.selectExpr(*CLASHES), levels).collect()]
    assert _order(got) == _order(_plain_manifest(rows))
    one = [tuple(x) for x in _manifest(spark.createDataFrame(rows[-1:], SCHEMA), levels).collect()]
    assert _order(one) == _order(_plain_manifest(rows[-1:])) and one[0][1] == one[0][3]
    assert _manifest(df.limit(0), levels).count() == 0


def test_proofs_show_what_was_changed(spark):
    rows = [(i, f"text {i}", "en", "s", i) for i in range(9)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = merkle.manifest(df, "doc_id", "lang", merkle.digest(F.col("text")), F.when(F.col("doc_id") == 3, merkle.digest(F.lit("forged")))).collect()
    assert {x["doc_id"] for x in out if x["folded"] != x["root"]} == {3}
    assert all(merkle.fold(x["leaf"], x["proof"]) == x["root"] for x in out)
    assert {len(x["proof"]) for x in out} == {4}


def test_op11_query(spark):
    d = pd.read_parquet(f"{SF}/documents.parquet")
    rows = [(int(a), b, c, e, int(n)) for a, b, c, e, n in d[["doc_id", "text", "lang", "source", "n_chars"]].itertuples(index=False)]
    out = queries()["op11_merkle_exchange"](spark, SF)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert _order(tuple(x) for x in out.collect()) == _order(_plain_manifest(rows))


# --- periodic runs ---------------------------------------------------------------------------


def _runs(w):
    found = {}
    for q in range(1, len(w) // 4 + 1):
        k = 0
        while k + q < len(w):
            if w[k] != w[k + q]:
                k += 1
                continue
            start = k
            while k + q < len(w) and w[k] == w[k + q]:
                k += 1
            if k - start + q >= max(6, 4 * q):
                found.setdefault((start, k - start + q), q)
    return sorted((s, q, n) for (s, n), q in found.items())


def _made(seed):
    r, w = random.Random(seed), []
    while len(w) < r.choice([5, 60, 400, 900]):
        few = r.choice([2, 3, 50])
        base = [f"w{r.randrange(few)}" for _ in range(r.choice([1, 2, 3, 5, 8, 13, 30, 60]))]
        w += (base * r.randrange(1, r.choice([3, 8, 40, 60])))[: r.randrange(1, 700)]
    return w


def test_z_function():
    r = random.Random(3)
    for _ in range(200):
        s = [r.randrange(2) for _ in range(r.randrange(30))]
        assert periodic.z_function(s) == [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(len(s))]


@pytest.mark.parametrize("tile", [16, 64, 4096])
def test_runs_across_tiles(spark, tile):
    """Long runs over many tiles, nested and touching runs, equal rows, no words."""
    docs = [_made(seed) for seed in range(60)] + [["a"] * 3000, ["a"] * 5, ["a"] * 6, [], ["a", "b"] * 700 + ["b"], [f"u{i}" for i in range(500)]]
    rows = [(f"{i}".encode(), w) for i, w in enumerate(docs)]
    df = spark.createDataFrame(rows + rows[:3], "key binary, words array<string>").repartition(4)
    got = {}
    for x in periodic.periodic_runs(df, tile).collect():
        got.setdefault(int(x["key"]), []).append((x["start"], x["period"], x["length"]))
    assert {k: sorted(v) for k, v in got.items()} == {i: _runs(w) for i, w in enumerate(docs) if _runs(w)}


def test_collapse_keeps_the_first_period(spark):
    rows = [(b"1", "x a b a b a b a b y y y y y y z".split()), (b"2", ["q"]), (b"3", [])]
    out = {x["key"]: x for x in periodic.collapse(spark.createDataFrame(rows, "key binary, words array<string>"), lambda x: x).collect()}
    assert set(out) == {b"1"}
    assert out[b"1"]["collapsed"] == sha("x a b y z") and tuple(out[b"1"]["best"]) == (9, 1, 6)
    assert periodic.collapse(spark.createDataFrame([], "key binary, words array<string>"), lambda x: x).count() == 0


def _plain_runs(doc, text):
    w, h = words(text), zlib.crc32(str(doc).encode())
    if h % 10 == 0 and w:
        a = (h // 10) % len(w)
        p = 1 + (len(w) - a) // (3 + (h // 10) % 8)
        w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
    runs = _runs(w)
    gone = {i for s, q, n in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda r: (Fraction(r[2], r[1]), -r[0], -r[1]), default=None)
    named = (best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4
    return (doc, len(runs), *named, sha("".join(f"{s},{n},{q}\n" for s, q, n in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def test_op12_query(spark):
    d = pd.read_parquet(f"{SF}/documents.parquet")
    out = queries()["op12_scale_tiles"](spark, SF)
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert _order(tuple(x) for x in out.collect()) == _order(_plain_runs(int(i), t) for i, t in zip(d["doc_id"], d["text"]))


def test_op12_odd_tables(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "é " * 9), (4, "b " * 9), (4, "b " * 9), (None, "c c c c c c c"), (5, "ab cd " * 20_000 + "end"), (70, "a b c d"), (30, "x y z " * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as key", "2 as words", "3 as p", "4 as w")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(x) for x in queries()["op12_scale_tiles"](spark, str(tmp_path)).collect()]

    def plain(i, t):  # _runs would take too long on the long text
        if i == 5:
            w = words(t)
            h = zlib.crc32(b"5")
            assert h % 10 and len(w) == 40_001
            return (5, 1, 0, 40_000, 2, 20_000_000, sha("0,40000,2\n"), sha("ab cd end"))
        return (None, *_plain_runs("null", t)[1:]) if i is None else _plain_runs(i, t)

    assert _order(got) == _order(plain(i, t) for i, t in rows)
    df.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries()["op12_scale_tiles"](spark, f"{tmp_path}/none").count() == 0


# --- repeated passages -----------------------------------------------------------------------


def _plain_repeats(rows, window=50):
    first = {}
    split = [(i, words(t)) for i, t in rows]
    for i, w in split:
        if i is not None:
            for k in range(len(w) - window + 1):
                x = tuple(w[k : k + window])
                first[x] = min(first.get(x, i), i)
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return out


def test_symbols_of_equal_stretches_agree_inside():
    """Whatever lies around a stretch, its symbols agree behind the margin."""
    r = np.random.default_rng(5)
    for few in (2, 3, 40, 10_000):
        pool = r.integers(1, 1 << 63, few).astype(np.uint64)
        for _ in range(300):
            core = r.choice(pool, 50)
            around = [np.concatenate([r.choice(pool, r.integers(0, 40)), np.zeros(0, np.uint64)]) for _ in range(4)]
            found = []
            for a, b in (around[:2], around[2:]):
                h = np.concatenate([a, core, b])
                s = repeats.symbols(h, np.zeros(len(h), bool))
                assert len(s) == len(h)
                found.append(s[len(a) + repeats.MARGIN : len(a) + 50 - repeats.MARGIN])
            assert (found[0] == found[1]).all() and len(found[0])


def test_window_hashes_are_those_of_their_words():
    r = np.random.default_rng(2)
    h = r.integers(0, 3, 400).astype(np.uint64)
    for width in (1, 2, 3, 7, 50, 64):
        own = repeats._window_hash(h, width, repeats._A)
        assert len(own) == 400 - width + 1
        seen = {}
        for i, x in enumerate(own):
            assert seen.setdefault(tuple(h[i : i + width]), x) == x
        assert len(set(seen.values())) == len(seen)


def test_repeats_of_odd_rows(spark):
    """Copies, near copies, shared passages of 49 to 120 words, one word again and again, repeated ids, nulls, a very long text."""
    r = random.Random(8)
    def some(n, few=200):
        return [f"w{r.randrange(few)}" for _ in range(n)]

    common, edge, exact = some(120), some(49), some(50)
    rows = [(i, " ".join(some(r.randrange(60)) + common[r.randrange(30) : 90 + r.randrange(30)] + some(r.randrange(60)))) for i in range(10, 40)]
    rows += [(50 + i, " ".join(some(5) + edge + some(5))) for i in range(4)] + [(60 + i, " ".join(some(5) + exact + some(5))) for i in range(4)]
    rows += [(70, "ab " * 400), (71, "x " + "ab " * 60 + "y"), (72, "cd " * 49), (73, "cd " * 49), (74, "ab cd " * 60), (75, "z ab cd " * 40 + "ab cd " * 40)]
    rows += [(80, rows[0][1]), (81, rows[0][1] + "  "), (5, rows[0][1].replace(" ", "\n")), (82, None), (83, ""), (84, " \t"), (None, rows[0][1]), (None, " ".join(exact))]
    rows += [(90, " ".join(common)), (90, " ".join(common)), (90, " ".join(exact + common)), (1, " ".join(exact))]
    rows += [(2, " ".join(some(30_000, 9000) + common)), (3, " ".join(some(20_000, 2)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(*CLASHES).repartition(5)
    out = repeats.drop_repeats(df).collect()
    assert _order((x["doc_id"], x["n_words"], x["n_removed"], x["kept_sha256"]) for x in out) == _order(_plain_repeats(rows))
    assert all(sum(s["end"] - s["start"] for s in x["removed"]) == x["n_removed"] for x in out)
    assert repeats.drop_repeats(df.limit(0)).count() == 0


def test_places_that_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(periodic, "BROADCAST_KEYS", 0)
    monkeypatch.setattr(merkle, "BROADCAST_COUNTS", 0)
    text = " ".join(f"w{i}" for i in range(70))
    rows = [(i, text + f" {i}" * i, "en", "s", i) for i in range(9)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = repeats.drop_repeats(df).collect()
    assert _order((x["doc_id"], x["n_words"], x["n_removed"], x["kept_sha256"]) for x in out) == _order(_plain_repeats([x[:2] for x in rows]))
    assert _order(tuple(x) for x in _manifest(df).collect()) == _order(_plain_manifest(rows))
    docs = df.select(F.col("doc_id").cast("string").cast("binary").alias("key"), "text")
    found = periodic.collapse(docs, lambda x: x.select("key", periodic.words_of(F.col("text")).alias("words")))
    assert {x["key"]: x["best"]["length"] for x in found.collect()} == {str(i).encode(): i for i in range(6, 9)}


def test_op13_query(spark):
    d = pd.read_parquet(f"{SF}/documents.parquet")
    out = queries()["op13_recompression"](spark, SF)
    assert out.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert _order(tuple(x) for x in out.collect()) == _order(_plain_repeats([(int(i), t) for i, t in zip(d["doc_id"], d["text"])]))
