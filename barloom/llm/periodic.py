"""Periodic runs in sequences of words, by tiles of each period octave.

A run of period q is a longest stretch in which words q apart are equal. For
every octave of periods, P to 2P - 1, a document is exploded into tiles that
overlap by more than a run needs to be seen on both sides; a tile is solved by
itself, and no tile holds more than a bounded stretch of words.

A run of length 4q has 3q places that equal the one q further on, so for some
multiple b of P the 2P words from b on equal those from b + q on. One comparison
of block hashes a word finds these (b, q). From such a boundary, the Z-functions
of the words behind it and (reversed) before it say how far the equality reaches
either way, for all periods of the octave at once. What reaches a period's bound
is a fragment of a run. Fragments are shuffled by document and period, and
overlapping ones are stitched, so a run may cross any number of tiles.

A fragment that a divisor of q repeats too belongs to a run with that divisor as
its period, and so does the whole run; it is left out where it is found.

Words are compared by 64-bit hashes in Spark, and never sent to Python but for
documents that have runs.

Edge cases: null and empty texts have no words and no runs; runs may overlap and
share words; a very long document is cut into tiles like any other; equal rows
are one document with one result each; rows with equal ids and different words
are documents of their own; a null id is an id; an empty table gives no rows;
other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import CRC32_SQL, materialize, small_batches, table, text_or_empty

#: A run is at least so many periods and so many words long.
PERIODS, WORDS = 4, 6
#: Words of a tile that are its own, at least; 32 periods where that is more.
TILE = 4096
#: Periods that a fragment is followed to either side of its boundary; more than PERIODS - 1.
REACH = 16
#: Keys of documents with runs are broadcast to the scan of the texts up to so many.
BROADCAST_KEYS = 1_000_000

_A = np.uint64(0x9E3779B97F4A7C15)


def z_function(s: list) -> list[int]:
    """How far the sequence equals itself from each place on."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _blocks(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of each ``width`` (a power of two) words in a row; equal hashes are a hint, which the Z-functions verify."""
    have = 1
    while have < width:
        h = h[:-have] * _A + h[have:]
        have *= 2
    return h


def candidates(tiles_: list[np.ndarray], p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tile, boundary, period) where 2p words from a multiple of p on may equal those a period of p to 2p - 1 further on."""
    sizes = np.array([len(t) for t in tiles_])
    rows = -(-sizes // p)  # each tile begins at a multiple of p
    begin = np.cumsum(rows) - rows
    h = np.zeros((rows.sum() + 3) * p, np.uint64)
    for t, at in zip(tiles_, begin * p):
        h[at : at + len(t)] = t
    block = _blocks(h, 2 * p)
    n = len(block) // p - 1
    row, shift = np.nonzero(block[p : (n + 1) * p].reshape(n, p) == block[: n * p : p, None])
    tile = np.searchsorted(begin, row, side="right") - 1
    b, q = (row - begin[tile]) * p, shift + p
    inside = b + q + 2 * p <= sizes[tile]
    return tile[inside], b[inside], q[inside]


def _primes(q: int) -> list[int]:
    out, d = [], 2
    while d * d <= q:
        if q % d == 0:
            out.append(d)
            while q % d == 0:
                q //= d
        d += 1
    return [*out, q] if q > 1 else out


def _boundary(h: np.ndarray, b: int, p: int, reach: int) -> tuple[list[int], list[int]]:
    """For each shift below 2p: how far the words from b on equal those that far behind, and likewise before b."""
    ahead = z_function(h[b : b + reach + 2 * p].tolist())
    low = max(b - reach, 0)
    back = h[low:b][::-1].tolist()
    whole = h[low : b + 2 * p][::-1].tolist()
    z = z_function([*back, None, *whole])
    behind = [0] * (2 * p)
    for q in range(1, 2 * p):
        at = len(back) + 1 + (len(whole) - (b + q - low))  # the word before b + q, in the reversed stretch
        behind[q] = min(z[at], len(back)) if back and 0 <= at < len(z) else 0
    return ahead, behind


def fragments(h: np.ndarray, p: int, found) -> list[tuple[int, int, int]]:
    """(period, start, end) of the stretches of repeating words around the candidates (boundary, period) of a tile, by boundary.

    A stretch covers the words [start, end) and is PERIODS periods long or more.
    """
    out, done, at, reach = [], {}, None, REACH * p
    for b, q in found:
        if done.get(q, -1) >= b + 2 * p:
            continue  # a fragment of the period goes on through this boundary
        if at != b:
            ahead, behind = _boundary(h, b, p, reach)
            at = b
        start, stop = b - behind[q], b + ahead[q]
        # a fragment that was followed to the end of its reach goes on: it is taken up again from a boundary well inside it
        done[q] = stop if ahead[q] + q < len(ahead) else stop - 4 * p
        if stop - start >= (PERIODS - 1) * q and not any(np.array_equal(h[start : stop + q - d], h[start + d : stop + q]) for d in (q // r for r in _primes(q))):
            out.append((q, start, stop + q))
    return out


def solve(tiles_: list[np.ndarray], p: int, first: np.ndarray, end: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(tile, period, start, end) of the fragments of tiles of one octave; a tile looks from its boundaries in [first, end)."""
    tile, b, q = candidates(tiles_, p)
    own = (b >= first[tile]) & (b < end[tile])
    tile, b, q = (x[own].tolist() for x in (tile, b, q))
    out, i = [], 0
    while i < len(tile):
        j = i
        while j < len(tile) and tile[j] == tile[i]:
            j += 1
        out += [(tile[i], *x) for x in fragments(tiles_[tile[i]], p, zip(b[i:j], q[i:j]))]
        i = j
    return out


def tiles(n: Column, tile: int = TILE) -> Column:
    """Array of (p, first, end) for a document of ``n`` words: the octaves that a run can have, each cut at multiples of p."""
    top = F.floor(F.log2((n / PERIODS).cast("double")) + 1e-9).cast("int")
    octaves = F.sequence(F.lit(0), top)

    def cut(o):
        p = F.pow(F.lit(2.0), o).cast("int")
        size = F.greatest(F.lit(tile), p * 32)
        return F.transform(F.sequence(F.lit(0), n - 1, size), lambda s: F.struct(p.alias("p"), s.alias("first"), F.least(s + size, n).alias("end")))

    return F.when(n >= WORDS, F.flatten(F.transform(octaves, cut)))


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tiles (key, p, from_, first, end, words) to fragments in the document's own word numbers."""
    schema = pa.schema([("key", pa.binary()), ("q", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
    for batch in batches:
        words, keys = batch.column("words"), batch.column("key")
        values, offsets = words.values.to_numpy().view(np.uint64), words.offsets.to_numpy()
        octave, low, first, end = (batch.column(c).to_numpy() for c in ("p", "from_", "first", "end"))
        rows = []
        for p in np.unique(octave).tolist():  # the tiles of an octave are looked through in one go
            at = np.flatnonzero(octave == p)
            own = [values[offsets[i] : offsets[i + 1]] for i in at]
            for k, q, s, e in solve(own, p, (first - low)[at], (end - low)[at]):
                rows.append((keys[at[k]].as_py(), q, s + int(low[at[k]]), e + int(low[at[k]])))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)


def periodic_runs(docs: DataFrame, tile: int = TILE) -> DataFrame:
    """(key, start, period, length) of every run. ``docs``: key binary, words array<string>."""
    hashed = docs.select("key", F.transform("words", lambda w: F.xxhash64(w)).alias("h"), F.size("words").alias("n")).where(F.col("n") >= WORDS)
    cut = hashed.select("key", "h", "n", F.explode(tiles(F.col("n"), tile)).alias("t"))
    around = F.col("t.p") * REACH
    low = F.greatest(F.col("t.first") - around, F.lit(0))
    high = F.least(F.col("t.end") + around + 4 * F.col("t.p"), F.col("n"))
    cut = cut.select("key", "t.p", low.alias("from_"), "t.first", "t.end", F.slice("h", low + 1, high - low).alias("words"))
    found = cut.mapInArrow(_solve, "key binary, q int, start int, end int").distinct()
    by = Window.partitionBy("key", "q").orderBy("start", "end")
    # places that equal the one q further on; fragments whose places touch are one run
    stop = F.col("end") - F.col("q")
    before = F.max(stop).over(by.rowsBetween(Window.unboundedPreceding, -1))
    found = found.withColumn("new", F.coalesce(F.col("start") > before, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(by))
    runs = found.groupBy("key", "q", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    runs = runs.select("key", "start", F.col("q").alias("period"), (F.col("end") - F.col("start")).alias("length"))
    return runs.where(F.col("length") >= F.greatest(F.lit(WORDS), PERIODS * F.col("period")))


def collapse(docs: DataFrame, words: Callable[[DataFrame], DataFrame], tile: int = TILE) -> DataFrame:
    """One row per document with runs: key, runs (start, period, length by start), the best of them, the kept words' digest.

    ``docs``: key and what ``words`` makes (key, words) of; rows with equal keys are equal. A run's words after its first
    period go.
    """
    small_batches(docs.sparkSession)
    own = F.array_sort(F.collect_list(F.struct("start", "period", "length")))
    runs = materialize(periodic_runs(words(docs), tile).groupBy("key").agg(own.alias("runs")), "runs")
    keys = runs.select("key")
    if runs.count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    texts = words(docs.join(keys, "key", "left_semi")).dropDuplicates(["key"]).join(runs, "key")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, words, own in b[["key", "words", "runs"]].itertuples(index=False, name=None):
                change = np.zeros(len(words) + 1, np.int64)
                for r in own:
                    change[r["start"] + r["period"]] += 1
                    change[r["start"] + r["length"]] -= 1
                kept = " ".join(w for w, c in zip(words, np.cumsum(change)) if not c)
                best = max(own, key=lambda r: (Fraction(r["length"], r["period"]), -r["start"], -r["period"]))
                rows.append((key, own, dict(best), hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest()))
            yield pd.DataFrame(rows, columns=["key", "runs", "best", "collapsed"])

    run = "struct<start: int, period: int, length: int>"
    return texts.mapInPandas(cut, f"key binary, runs array<{run}>, best {run}, collapsed string")


def words_of(text: Column) -> Column:
    """The words of a text, in Spark."""
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _repeated(docs: DataFrame) -> DataFrame:
    """(doc_id, key, words): of every tenth document the words behind the a-th are the first p from there on, again and again."""
    docs = docs.select("key", "doc_id", words_of(F.col("text")).alias("w"))
    h, n = F.crc32(F.col("doc_id").cast("string")), F.size("w")
    g = F.floor(h / 10)
    a = F.pmod(g, F.when(n > 0, n))
    p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
    docs = docs.select("doc_id", "key", "w", F.when((h % 10 == 0) & (n > 0), a).cast("int").alias("a"), p.cast("int").alias("p"), n.alias("n"))
    turns = F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int"))
    repeated = F.concat(F.slice("w", F.lit(1), F.col("a")), F.slice(F.flatten(turns), F.lit(1), F.col("n") - F.col("a")))
    return docs.select("doc_id", "key", F.when(F.col("a").isNotNull(), repeated).otherwise(F.col("w")).alias("words"))


def op12_scale_tiles(spark, sf_dir: str) -> DataFrame:
    # rows with one id may hold different texts
    own = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(" "), F.col("text"))
    docs = table(spark, sf_dir, "documents").select("doc_id", text_or_empty("text").alias("text")).withColumn("key", F.unhex(F.md5(own)))
    found = collapse(docs, _repeated)
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    found = found.select("key", F.size("runs").alias("n_runs"), "best", F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), "collapsed")
    plain = _repeated(docs).select("doc_id", "key", F.sha2(F.array_join("words", " "), 256).alias("plain"))
    out = plain.join(materialize(found, "collapsed"), "key", "left")
    best = lambda f: F.col(f"best.{f}").cast("long")
    return out.select(
        "doc_id",
        F.coalesce("n_runs", F.lit(0)).cast("long").alias("n_runs"),
        best("start").alias("start"),
        best("length").alias("length"),
        best("period").alias("period"),
        F.expr("(1000L * best.length) div best.period").alias("exponent_milli"),
        F.coalesce("runs_sha256", F.sha2(F.lit(""), 256)).alias("runs_sha256"),
        F.coalesce("collapsed", "plain").alias("collapsed_sha256"),
    )


OP12_SQL = rf"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {CRC32_SQL} AS h FROM documents),
e AS (SELECT *, len(w) AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d),
f AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM e),
t AS (SELECT doc_id, n, k - 1 AS i, w[CASE WHEN a IS NULL OR k - 1 < a THEN k ELSE a + (k - 1 - a) % p + 1 END] AS word FROM (SELECT *, unnest(range(1, n + 1)) AS k FROM f)),
m AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM t x JOIN t y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND y.i - x.i <= x.n // 4),
s AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS stretch FROM m),
r AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM s GROUP BY doc_id, q, stretch HAVING count(*) + q >= greatest(6, 4 * q)),
-- a stretch that a smaller period repeats too is one run, of the smallest
runs AS (SELECT doc_id, start, length, min(q) AS period FROM r GROUP BY 1, 2, 3),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length / period DESC, start, period) = 1),
lines AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS text FROM runs GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT t.doc_id, string_agg(word, ' ' ORDER BY t.i) AS kept FROM t ANTI JOIN gone ON gone.doc_id = t.doc_id AND gone.i = t.i GROUP BY 1)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(lines.text, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN best ON best.doc_id = d.doc_id LEFT JOIN lines ON lines.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id"""
