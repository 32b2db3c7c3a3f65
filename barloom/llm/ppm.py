"""Language-model scores by prediction by partial matching over bytes.

The model is a trie of byte contexts up to ``ORDER``. It is kept flat: a gram is
a context and the byte behind it, packed into one long; counts of shorter
contexts are sums of those of longer ones. A byte is coded in the longest
context that has been followed by it; each shorter step costs an escape, whose
probability is half that of distinct against seen bytes (method D), and bytes
that a longer context has already ruled out are excluded from the counts of the
shorter. Below order 0, the bytes never seen share the last escape evenly. All
of this depends on the gram alone, so every gram of the corpus gets one log
probability, from the shortest context up: one join and one window a level.

A text starts behind ``ORDER`` bytes 0xFE and ends with the byte 0xFF, which
UTF-8 never uses.

Documents are dealt to blocks of a bounded number of bytes by a hash of id and
text. Each block asks for the distinct keys it holds (words and grams), a join
answers them, and the block's documents meet the answers in one task. Nothing
of the model goes through the driver, at any size.

Beside the trie's score stands the base score, a unigram model over words. Words
are told apart by 64-bit hashes.

Edge cases: a null text is empty (one end token, one end byte); an empty
training part leaves uniform probabilities; repeated rows, repeated ids and null
ids are scored each; a text longer than a block is scored in a block with
others; an empty table gives no rows; other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import WordHashes, kept, materialize, small_batches, table

ORDER = 5
#: Bytes of text in a block, about; a longer text is in a block with others.
BLOCK_BYTES = 32_000_000
#: Bytes whose grams are counted at a time, and scored at a time.
BATCH_BYTES, SCORE_BYTES = 1_500_000, 500_000
START, END = 0xFE, 0xFF
#: The end token of the word model; no word holds a line feed.
END_TOKEN = b"\n"
ALPHA = 0.1


def tokens(text: str) -> list[bytes]:
    """Words in UTF-8 and the end token. Bytes lower-case A-Z alone and split at \\x20 and \\x09-\\x0D alone."""
    return [*text.encode("utf-8", "surrogatepass").lower().split(), END_TOKEN]


def word_keys(text: str, hashes: WordHashes) -> np.ndarray:
    """A key for every token; word keys are negative, grams are not."""
    found = tokens(text)
    return np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found)).view(np.int64) | np.int64(-(2**63))


def grams(texts: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Gram at every byte of every text (and at its end), and where each text's grams start."""
    pad = bytes([START]) * order
    joined = b"".join([pad + t.encode("utf-8", "surrogatepass") + bytes([END]) for t in texts])
    raw = np.frombuffer(joined, np.uint8)
    # eight bytes from every place on, of which the first order + 1 stay
    eight = np.ndarray((len(raw) - order,), ">u8", joined + bytes(8), strides=(1,))
    real = raw[order:] != START
    code = (eight[real].astype(np.uint64) >> np.uint64(8 * (7 - order))).view(np.int64)
    ends = np.flatnonzero(raw == END)
    lengths = np.diff(np.concatenate([[-1], ends])) - order
    return code, np.cumsum(lengths) - lengths


def _batches(texts: list[str], size: int = BATCH_BYTES) -> Iterator[list[int]]:
    own, held = [], 0
    for i, t in enumerate(texts):
        own.append(i)
        held += len(t)
        if held >= size:
            yield own
            own, held = [], 0
    if own:
        yield own


class Tally:
    """Counts of keys, gathered over a task and flushed when large."""

    LIMIT = 1_500_000

    def __init__(self, order: int):
        self.order, self.hashes, self.parts, self.size = order, kept("words", "hashes", WordHashes), [], 0

    def add(self, texts: list[str], trained: list[bool] | None = None) -> None:
        """Counts of training texts; of the others only that their grams exist. Without ``trained``: that grams and words exist."""
        for train in (True, False):
            own = [t for t, x in zip(texts, trained or [False] * len(texts)) if x == train]
            for at in _batches(own):
                part = [own[i] for i in at]
                codes, _ = grams(part, self.order)
                self.keep(codes, train)
                if train or trained is None:
                    self.keep(np.concatenate([word_keys(t, self.hashes) for t in part]), train)

    def keep(self, keys: np.ndarray, train: bool) -> None:
        if not len(keys):
            return
        found, n = np.unique(keys, return_counts=True)
        self.parts.append((found, n.astype(np.int64) if train else np.zeros(len(n), np.int64)))
        self.size += len(found)
        if self.size > self.LIMIT:
            self.merge()

    def merge(self) -> None:
        if len(self.parts) > 1:
            key, n = (np.concatenate(x) for x in zip(*self.parts))
            self.parts = []
            order = np.argsort(key, kind="stable")
            key, n = key[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            self.parts = [(key[first], np.add.reduceat(n, first))]
            self.size = len(first)

    def flush(self) -> Iterator[pd.DataFrame]:
        self.merge()
        for key, n in self.parts:
            yield pd.DataFrame({"key": key, "n": n})
        self.parts, self.size = [], 0


def _gram_scores(counted: DataFrame, order: int) -> DataFrame:
    """(key, value): the log10 probability of every gram.

    ``counted``: key, n (training count, 0 for grams that only other texts
    hold). On level k a row is a gram of k context bytes. ``all`` and ``kinds``
    are its context's counts, in sum and distinct; ``ruled`` is what the bytes
    that followed the context count in the context one byte shorter: they have
    followed it too, and are excluded there. ``rest`` is the log probability of
    the byte once the context has been left by an escape.
    """
    rows = {order: counted.select(F.col("key").alias("gram"), "n")}
    for k in range(order - 1, -1, -1):
        low = F.col("gram").bitwiseAND(F.lit((1 << (8 * (k + 1))) - 1))
        rows[k] = materialize(rows[k + 1].groupBy(low.alias("gram")).agg(F.sum("n").alias("n")), f"level{k}")
    by = Window.partitionBy(F.shiftright("gram", 8))
    seen = (F.col("n") > 0).cast("long")
    done = None
    for k in range(order + 1):
        here = rows[k]
        if k:
            low = F.col("gram").bitwiseAND(F.lit((1 << (8 * k)) - 1))
            shorter = done.select(F.col("gram").alias("low"), *[F.col(c).alias(f"s_{c}") for c in ("n", "all", "kinds", "rest")])
            here = here.join(shorter, low == F.col("low")).drop("low")
            here = here.withColumn("ruled", F.sum(seen * F.col("s_n")).over(by))
        here = here.withColumns({"all": F.sum("n").over(by), "kinds": F.sum(seen).over(by)})
        if k:
            total = (F.col("s_all") - F.col("ruled")).cast("double")
            hit = F.log10((F.col("s_n") - 0.5) / total)
            escape = F.log10(0.5 * (F.col("s_kinds") - F.col("kinds")) / total) + F.col("s_rest")
            rest = F.when(total <= 0, F.col("s_rest")).when(F.col("s_n") > 0, hit).otherwise(escape)
        else:
            rest = -F.log10(F.greatest(F.lit(255) - F.col("kinds"), F.lit(1)).cast("double"))
        done = here.select("gram", "n", "all", "kinds", rest.alias("rest"))
        done = materialize(done, f"trie{k}")
    value = (
        F.when(F.col("n") > 0, F.log10((F.col("n") - 0.5) / F.col("all")))
        .when(F.col("all") > 0, F.log10(0.5 * F.col("kinds") / F.col("all")) + F.col("rest"))
        .otherwise(F.col("rest"))
    )
    return done.select(F.col("gram").alias("key"), value.alias("value"))


class Table:
    """Values by long key: open addressing over arrays, looked up all at once."""

    FREE = np.iinfo(np.int64).max  # no gram and no word key

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(int(np.ceil(np.log2(max(len(keys), 1) * 1.4))), 4)
        self.keys, self.values = np.full(1 << self.bits, self.FREE, np.int64), np.zeros(1 << self.bits)
        at, todo = self.slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[at[todo]] == self.FREE
            first = todo[free]
            _, one = np.unique(at[first], return_index=True)
            placed = first[one]
            self.keys[at[placed]], self.values[at[placed]] = keys[placed], values[placed]
            todo = todo[self.keys[at[todo]] != keys[todo]]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values of the keys; 0 for a key without one."""
        at = self.slot(keys)
        off, gone = np.flatnonzero(self.keys[at] != keys), []
        while len(off):
            free = self.keys[at[off]] == self.FREE
            gone.append(off[free])
            off = off[~free]
            at[off] = (at[off] + 1) & ((1 << self.bits) - 1)
            off = off[self.keys[at[off]] != keys[off]]
        out = self.values[at]
        for x in gone:
            out[x] = 0.0
        return out


def ppm_scores(
    docs: DataFrame,
    training: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    order: int = ORDER,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document: n_tokens, n_known, train_tokens, base_score, score, n_bytes and ``trained``."""
    small_batches(docs.sparkSession)
    dtype = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(training, F.lit(False)).alias("trained")
    )

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tally = Tally(order)
        for b in batches:
            tally.add(b["text"].tolist(), b["trained"].tolist())
            if tally.size > Tally.LIMIT:
                yield from tally.flush()
        yield from tally.flush()

    counts = slim.mapInPandas(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "counts")
    words = counts.where("key < 0")
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).head()
    values = words.select("key", F.col("n").cast("double").alias("value")).unionByName(_gram_scores(counts.where("key >= 0"), order))

    total = slim.agg(F.sum(F.octet_length("text").cast("long"))).head()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    dealt = slim.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int")).repartition(4 * blocks, "block")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Distinct keys of each block; a key that is flushed twice only gets its answer twice."""
        tallies: dict[int, Tally] = {}
        for b in batches:
            for block, rows in b.groupby("block"):
                tally = tallies.setdefault(int(block), Tally(order))
                tally.add(rows["text"].tolist())
                if tally.size > Tally.LIMIT:
                    yield from (out[["key"]].assign(block=int(block)) for out in tally.flush())
        for block, tally in tallies.items():
            yield from (out[["key"]].assign(block=block) for out in tally.flush())

    asked = dealt.mapInPandas(ask, "key long, block int")
    # one row a key on the model's side, so its hashed partitions are even
    answers = asked.join(values.hint("shuffle_hash"), "key").select("block", "key", "value")

    def score(texts: pa.Table, answer: pa.Table) -> pa.Table:
        hashes = kept("words", "hashes", WordHashes)
        found = Table(answer["key"].to_numpy(), answer["value"].to_numpy())
        size = pc.binary_length(texts["text"]).to_numpy()
        ends = np.append(np.flatnonzero(np.diff(np.cumsum(size) // SCORE_BYTES)) + 1, len(size))
        out = np.zeros((texts.num_rows, 5))
        base = n + ALPHA * (v + 1)
        for lo, hi in zip(np.append(0, ends[:-1]).tolist(), ends.tolist()):
            part = texts["text"].slice(lo, hi - lo).to_pylist()
            keys = [word_keys(t, hashes) for t in part]
            size = np.array([len(k) for k in keys])
            c = found.get(np.concatenate(keys))
            first = np.cumsum(size) - size
            out[lo:hi, 0], out[lo:hi, 1] = size, np.add.reduceat(c > 0, first, dtype=np.int64)
            out[lo:hi, 2] = np.add.reduceat(np.log10((c + ALPHA) / base), first)
            codes, starts = grams(part, order)
            out[lo:hi, 3] = np.add.reduceat(found.get(codes), starts)
            out[lo:hi, 4] = np.diff(np.append(starts, len(codes)))
        columns = {"n_tokens": out[:, 0].astype(np.int64), "n_known": out[:, 1].astype(np.int64), "train_tokens": np.full(len(out), n, np.int64)}
        columns |= {"base_score": out[:, 2], "score": out[:, 3], "n_bytes": out[:, 4].astype(np.int64)}
        return pa.table({"id": texts["id"], "trained": texts["trained"]} | columns)

    schema = f"id {dtype}, trained boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long"
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, schema).withColumnRenamed("id", id_col)


def op3_ppm_score(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    training = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0
    return ppm_scores(docs, training).select(
        "doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes"
    )
