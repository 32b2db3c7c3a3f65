"""Repeated passages between documents, by recompression.

Words become symbols, and rounds replace short runs of one symbol and pairs of
neighbours by new symbols. Whether a pair is replaced depends on the pair alone
(each round deals the symbols to a left and a right half, and joins left-right
neighbours), and a new symbol's name is a hash of what it stands for, so a name
means the same in every document without a dictionary being exchanged. Equal
stretches of words therefore get equal symbols in their interior, wherever they
stand: what lies around a stretch can change its symbols within ``MARGIN`` words
of its ends only, as ``LIMITS`` bounds what a round may join.

So two equal windows of ``WINDOW`` words have the same symbols over the words in
their middle. Two symbols that meet there name a pair, and the least of these
names is the window's anchor (where one symbol fills the middle, its own name).
Spark names the anchors' owners globally: one aggregate finds the anchors that
more than one document has, one join brings these back to their documents, and
only windows at such an anchor are verified, by a 128-bit hash of all their words
and the smallest doc_id that holds it. Texts with more than one document are represented
by the smallest of these; in all others every window starts in a smaller
document too.

Aggregates combine in the tasks before their shuffle, so a passage that a third
of all documents hold costs one row a task; joins go to its occurrences, which
Spark may split. Names are 64-bit hashes and only decide what is verified; a
false verdict would need two windows with equal 128-bit hashes.

Edge cases: null and empty texts and those shorter than a window have nothing
removed; a repeat inside one document is none; rows with equal doc_id are no
smaller than each other, each row has its own verdict, and repeated rows are
kept as rows; a row without a doc_id is no source and loses nothing; an empty
table gives no rows; very long texts are parsed whole; runs of one word longer
than ``RUN`` stay as single symbols; other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import WordHashes, kept, materialize, small_batches, table, text_or_empty

#: Words of a passage.
WINDOW = 50
#: Longest run of one word that becomes a symbol.
RUN = 4
#: Words that a joined pair may span, by round.
LIMITS = (2, 2, 3, 4, 6, 8)
#: Texts that a worker holds and parses at a time.
BATCH = 200
#: Places of documents in later passes over the texts are broadcast up to this many bytes.
BROADCAST_BYTES = 40_000_000

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def margin(limits=LIMITS, run: int = RUN) -> int:
    """Words at either end of a stretch whose symbols its surroundings may change: a run, and one symbol a round."""
    out, widest = run, 1
    for limit in limits:
        out, widest = out + min(widest, limit - 1), max(widest, limit)
    return out


MARGIN = margin()


def _mix(a: np.ndarray, b: np.ndarray, k: np.uint64 = _A) -> np.ndarray:
    x = (a ^ (a >> np.uint64(31))) * k + b
    x = (x ^ (x >> np.uint64(29))) * k
    return x ^ (x >> np.uint64(32))


def _join_runs(s: np.ndarray, span: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    n = np.diff(np.append(first, len(s)))
    whole = (n > 1) & (n * span[first] <= limit)
    keep = np.ones(len(s), bool)
    keep[first] = False
    keep &= ~np.repeat(whole, n)  # the rest of a joined run goes
    keep[first] = True
    s, span = s.copy(), span.copy()
    at = first[whole]
    s[at], span[at] = _mix(s[at], n[whole].astype(np.uint64), _B), n[whole] * span[at]
    return s[keep], span[keep]


def _join_pairs(s: np.ndarray, span: np.ndarray, limit: int, turn: int) -> tuple[np.ndarray, np.ndarray]:
    right = (s >> np.uint64(7 * turn)) & np.uint64(1) == 1
    i = np.flatnonzero(~right[:-1] & right[1:] & (span[:-1] + span[1:] <= limit))
    keep = np.ones(len(s), bool)
    keep[i + 1] = False
    s, span = s.copy(), span.copy()
    s[i], span[i] = _mix(s[i], s[i + 1]), span[i] + span[i + 1]
    return s[keep], span[keep]


def parse(h: np.ndarray, wall: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols after all rounds and the words that each spans. Nothing is joined across ``wall``."""
    far = RUN + max(LIMITS)
    s, span = _join_runs(h, np.where(wall, far + 1, 1), RUN)
    for turn, limit in enumerate(LIMITS):
        s, span = _join_pairs(s, span, limit, turn)
    return s, np.where(span > far, 1, span)


def symbols(h: np.ndarray, wall: np.ndarray) -> np.ndarray:
    """For every word the name of the symbol it lies in."""
    return np.repeat(*parse(h, wall)) if len(h) else h


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def _window_hash(h: np.ndarray, width: int, k: np.uint64) -> np.ndarray:
    """A hash of each ``width`` words in a row, from those of halves."""
    parts, have, out, done = h, 1, None, 0
    while have <= width:
        if width & have:
            out = parts if out is None else _mix(out[: len(parts) - done], parts[done:], k)
            done += have
        if 2 * have <= width:
            parts = _mix(parts[:-have], parts[have:], k)
        have *= 2
    return out


def split(text: str | None) -> list[bytes]:
    """Words between \\x20 and \\x09-\\x0D."""
    return text.encode("utf-8", "surrogatepass").split() if isinstance(text, str) else []


def _hashed(words: list[bytes]) -> np.ndarray:
    known = kept("words", "hashes", WordHashes)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def anchors(h: np.ndarray, wall: np.ndarray, window: int) -> np.ndarray:
    """The anchor of the window that starts at each word; windows that run into a wall or the end have none that counts."""
    n, middle = max(len(h) - window + 1, 0), window - 2 * MARGIN
    if not n:
        return h[:0]
    s, span = parse(h, wall)
    none = ~np.uint64(0)
    meet = np.full(len(h), none)  # where a symbol ends, the pair that it and the next one make
    meet[np.cumsum(span)[:-1] - 1] = _mix(s[:-1], s[1:], _B)
    pair = _least(meet, middle - 1)[MARGIN : MARGIN + n]
    return np.where(pair == none, np.repeat(s, span)[MARGIN : MARGIN + n], pair)


def _laid_out(texts) -> tuple[list[list[bytes]], np.ndarray, np.ndarray, np.ndarray]:
    """The words of each text, their hashes end to end with a wall behind each text, the walls, and where each text begins."""
    found = [split(t) for t in texts]
    flat = np.concatenate([np.empty(0, np.uint64), *(np.append(_hashed(w), np.uint64(0)) for w in found)])
    ends = np.cumsum([len(w) + 1 for w in found], dtype=np.int64) - 1
    wall = np.zeros(len(flat), bool)
    wall[ends] = True
    return found, flat, wall, ends - [len(w) for w in found]


def _profiles(texts: DataFrame, window: int) -> DataFrame:
    """Per row the number of its words, the digest of all of them, and its distinct anchors."""

    def profile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found, flat, wall, begin = _laid_out(b["text"])  # texts of a batch are parsed in one go
            each = anchors(flat, wall, window)
            rows = []
            for w, at in zip(found, begin):
                own = np.unique(each[at : at + len(w) - window + 1]) if len(w) >= window else np.empty(0, np.uint64)
                rows.append((len(w), hashlib.sha256(b" ".join(w)).hexdigest(), own.view(np.int64)))
            out = pd.DataFrame(rows, columns=["n", "plain", "anchors"])
            out[["id", "print", "tag"]] = b[["id", "print", "tag"]].to_numpy()
            yield out[["id", "print", "tag", "n", "plain", "anchors"]]

    return texts.mapInPandas(profile, "id long, print binary, tag long, n long, plain string, anchors array<long>")


def _sent(places: DataFrame, size) -> DataFrame:
    """A table of small rows by document, with the hint that its measured size (bytes a row: ``size``) allows."""
    held = places.agg(F.coalesce(F.sum(size), F.lit(0))).head()[0]
    return F.broadcast(places) if held <= BROADCAST_BYTES else places


def _owners(base: DataFrame, reps: DataFrame, window: int) -> DataFrame:
    """One row a text that has a window, that of its smallest id: id, tag, anchors, and ``k``, the text's number among those of its id.

    Copies are few as a rule and ids seldom repeat, so the anchors stay where they are: the rows to leave out or to
    number are sent to them, if their measured size allows.
    """
    rows = base.where(F.col("id").isNotNull() & (F.col("n") >= window)).select("id", "tag", "anchors")
    late = base.select("id", "tag", "print").join(reps, "print").where("id > owner").select("id", "tag").distinct()
    rows = rows.join(_sent(materialize(late, "copies"), F.lit(16)), ["id", "tag"], "left_anti")
    again = materialize(base.groupBy("id").count().where("count > 1").select("id"), "repeated-ids")
    if again.isEmpty():
        return rows.withColumn("k", F.lit(0))
    again = _sent(again, F.lit(8))
    each = rows.join(again, "id", "left_semi").dropDuplicates(["id", "tag"])
    each = each.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("tag")) - 1)
    return rows.join(again, "id", "left_anti").withColumn("k", F.lit(0)).unionByName(each)


SPANS = "array<struct<start: int, end: int>>"


def merged(starts, window: int) -> list[tuple[int, int]]:
    """The spans (start, end) that windows with these starts cover."""
    out: list[list[int]] = []
    for s in sorted(starts):
        if out and s <= out[-1][1]:
            out[-1][1] = int(s) + window
        else:
            out.append([int(s), int(s) + window])
    return [tuple(x) for x in out]


def repeated_spans(texts: DataFrame, owners: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document with such: the spans of words that windows cover which start in a document with a smaller id too.

    ``texts``: id, tag, text. ``owners``: id, tag, k, anchors (ascending); one row a document, and one document a text.
    """
    own = materialize(owners.select("id", "k", "tag"), "documents")
    tokens = owners.select("id", "k", F.posexplode("anchors").alias("pos", "anchor"))
    shared = tokens.groupBy("anchor").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("anchor")
    spots = tokens.join(shared, "anchor").groupBy("id", "k").agg(F.collect_list("pos").alias("shared"))
    spots = materialize(spots.join(own, ["id", "k"]), "shared-anchors")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found, flat, wall, begin = _laid_out(b["text"])
            each = anchors(flat, wall, window)
            at = []
            for w, low, own_ in zip(found, begin, b["shared"]):
                mine = each[low : low + len(w) - window + 1]
                wanted = np.unique(mine)[np.asarray(own_, np.int64)]
                at.append(low + np.flatnonzero(np.isin(mine, wanted)))
            if at and sum(map(len, at)):
                row = np.repeat(np.arange(len(found)), [len(x) for x in at])
                at = np.concatenate(at)
                one, two = (_window_hash(flat, window, m)[at].view(np.int64) for m in (_A, _B))
                yield pd.DataFrame({"h1": one, "h2": two, "id": b["id"].to_numpy()[row], "k": b["k"].to_numpy()[row], "start": (at - begin[row]).astype(np.int32)})

    chosen = texts.join(_sent(spots, 48 + 4 * F.size("shared")), ["id", "tag"]).select("id", "k", "text", "shared")
    windows = materialize(chosen.mapInPandas(verify, "h1 long, h2 long, id long, k int, start int"), "windows")
    first = windows.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("h1", "h2", "first")
    later = windows.join(first, ["h1", "h2"]).where("id > first").groupBy("id", "k").agg(F.collect_set("start").alias("starts"))

    def spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [[{"start": s, "end": e} for s, e in merged(x, window)] for x in b["starts"]]
            yield pd.DataFrame({"id": b["id"], "tag": b["tag"], "spans": found})

    return materialize(later.join(own, ["id", "k"]).mapInPandas(spans, f"id long, tag long, spans {SPANS}"), "repeated")


def drop_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, n_words, n_removed, removed (spans of words, end exclusive) and the digest of the kept words."""
    small_batches(docs.sparkSession, BATCH)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    texts = texts.select("id", "text", F.unhex(F.md5("text")).alias("print"), F.xxhash64("text").alias("tag"))
    base = materialize(_profiles(texts, window), "profiles")
    reps = materialize(base.where(F.col("id").isNotNull() & (F.col("n") >= window)).groupBy("print").agg(F.min("id").alias("owner")), "owners")
    found = repeated_spans(texts.select("id", "tag", "text"), _owners(base, reps, window), window)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, tag, text, spans in b.itertuples(index=False, name=None):
                words, stay, at = split(text), [], 0
                for x in spans:
                    stay += words[at : x["start"]]
                    at = x["end"]
                stay += words[at:]
                rows.append((doc, tag, len(words) - len(stay), spans, hashlib.sha256(b" ".join(stay)).hexdigest()))
            yield pd.DataFrame(rows, columns=["id", "tag", "gone", "spans", "kept"])

    chosen = texts.join(_sent(found, 48 + 16 * F.size("spans")), ["id", "tag"]).select("id", "tag", "text", "spans")
    cuts = materialize(chosen.mapInPandas(cut, f"id long, tag long, gone long, spans {SPANS}, kept string").dropDuplicates(["id", "tag"]), "cuts")
    every = F.array(F.struct(F.lit(0).alias("start"), F.col("n").cast("int").alias("end")))
    out = base.drop("anchors").join(reps, "print", "left").join(cuts, ["id", "tag"], "left")
    copy = F.coalesce(F.col("id") > F.col("owner"), F.lit(False))
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_words"),
        F.when(copy, F.col("n")).otherwise(F.coalesce("gone", F.lit(0))).alias("n_removed"),
        F.when(copy, every).otherwise(F.coalesce("spans", F.array().cast(SPANS))).alias("removed"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", "plain")).alias("kept_sha256"),
    )


def op13_recompression(spark, sf_dir: str) -> DataFrame:
    return drop_repeats(table(spark, sf_dir, "documents")).drop("removed")


OP13_SQL = r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
h AS (SELECT doc_id, i, sha256(array_to_string(list_slice(w, i, i + 49), ' ')) AS h FROM s),
f AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY h) AS m FROM h) WHERE doc_id > m),
c AS (SELECT doc_id, w, generate_subscripts(w, 1) AS k FROM d),
m AS (SELECT c.doc_id, c.k, c.w[c.k] AS word, coalesce(c.k - f.i < 50, false) AS gone FROM c ASOF LEFT JOIN f ON c.doc_id = f.doc_id AND c.k >= f.i),
g AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY k) FILTER (NOT gone) AS kept FROM m GROUP BY 1)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_removed, 0)::bigint AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id)"""
