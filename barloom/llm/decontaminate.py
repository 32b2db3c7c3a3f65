"""Benchmark decontamination by q-gram lemma filtering.

An item of n characters occurs in a text with at most k = floor(rate * n) edits.
Of its floor(n / q) disjoint q-grams each edit can spoil one, so a region that
holds the item shares at least floor(n / q) - k of them with it, all on
diagonals (text position less item position) that lie within k of each other.
Shared q-grams are counted in diagonal bands that overlap by k; regions below
the bound are dropped, the others are verified by banded alignment.

The items are the stated query set: they are split into blocks of at most
``BLOCK_CHARS`` characters, and every text is scanned once for each block. One
block at a time is held: with several, what a block finds is written before the
next is broadcast. Texts are not shuffled (with several blocks, only those that
hold an item are named to the others, by two hashes).

A leak is an item that occurs whole, within its edit budget. Items of every
length are searched for, short ones by shorter q-grams; an item of under 10
characters has no edits to spend and must occur as it is.

Both sides are compared in lower case, with every white-space character as a
space; positions stay those of the text. Edge cases: null and empty texts and
items match nothing; repeated items and repeated rows are reported each, null
ids too; an empty table of texts or items finds nothing; other columns may have
any name; a very long text is searched whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize, small_batches, table

EDIT_RATE = 0.1
BLOCK_CHARS = 4_000_000
#: Lengths of q-grams; the first that leaves an item enough to share beyond its edits is taken.
GRAMS = (8, 4, 2, 1)
#: Texts found by one block, up to this many (16 bytes each), are broadcast; more are joined by a shuffle.
BROADCAST_TEXTS = 500_000
_B = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)
_BITS = 22

REGIONS = "doc {}, item {}, start int, end int, edits int, item_chars int"


def normal(text: str) -> np.ndarray:
    """Code points in lower case, white space as spaces, one for each of the text."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c if len(d := c.lower()) != 1 else d for c in text)
    codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), "<u4").copy()
    codes[(codes >= 9) & (codes <= 13)] = 32
    return codes


def gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all q-grams (q a power of two), by doubling."""
    h, n, b = codes.astype(np.uint64), 1, _B
    while n < q:
        if len(h) <= n:
            return np.empty(0, np.uint64)
        h = h[:-n] * b + h[n:]
        n, b = 2 * n, np.uint64(int(b) ** 2 & 0xFFFFFFFFFFFFFFFF)
    return h


class Index:
    """Disjoint q-grams of a block of items."""

    def __init__(self, items: list[tuple], rate: float):
        self.items = []
        entries: dict[int, list] = {q: [] for q in GRAMS}
        for item, text in items:
            codes = normal(text)
            n = len(codes)
            k = int(rate * n)
            if not n:
                continue
            q = next((q for q in GRAMS[:2] if n // q - k >= (2 if q > 4 else 1)), 0) or next(q for q in GRAMS[2:] if n // q - k >= 1)
            number = len(self.items)
            self.items.append((item, codes, k, n // q - k))
            h = gram_hashes(codes, q)[::q]
            entries[q] += [(x, number, i * q) for i, x in enumerate(h.tolist())]
        self.tables = {}
        for q, rows in entries.items():
            if rows:
                rows.sort()
                keys = np.array([r[0] for r in rows], np.uint64)
                seen = np.zeros(1 << _BITS, bool)
                seen[self.slot(keys)] = True
                self.tables[q] = (keys, np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), seen)
        self.k = np.array([x[2] for x in self.items], np.int64)
        self.least = np.array([x[3] for x in self.items], np.int64)

    @staticmethod
    def slot(h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> np.uint64(31))) * _MIX >> np.uint64(64 - _BITS)).astype(np.int64)

    @staticmethod
    def key(item: np.ndarray, band: np.ndarray) -> np.ndarray:
        return (item << 40) + band + (1 << 39)

    def candidates(self, codes: np.ndarray) -> list[tuple[int, int, int]]:
        """(item number, first diagonal of the band, its width) where the bound holds."""
        out = []
        for q, (keys, items, offsets, seen) in self.tables.items():
            h = gram_hashes(codes, q)
            at = np.flatnonzero(seen[self.slot(h)])
            if not len(at):
                continue
            lo, hi = np.searchsorted(keys, h[at], "left"), np.searchsorted(keys, h[at], "right")
            n = hi - lo
            if not n.any():
                continue
            entry = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            item, diagonal = items[entry], np.repeat(at, n) - offsets[entry]
            width = self.k[item] + 1
            band = diagonal // width
            also = diagonal - band * width < self.k[item]
            # an item's q-gram counts once in a band, however often the text repeats it
            offset = offsets[entry]
            key = self.key(np.concatenate([item, item[also]]), np.concatenate([band, band[also] - 1]))
            each = np.unique(np.stack([key, np.concatenate([offset, offset[also]])], 1).view("i8,i8"))["f0"]
            found, count = np.unique(each, return_counts=True)
            number = found >> 40
            good = count >= self.least[number]
            for i, band in zip(number[good].tolist(), ((found[good] & ((1 << 40) - 1)) - (1 << 39)).tolist()):
                w = int(self.k[i]) + 1
                out.append((i, band * w, w + int(self.k[i])))
        return out


def banded(item: np.ndarray, text: np.ndarray, first: int, width: int, k: int, anchored: bool = False) -> tuple[int, int] | None:
    """Least edits, and end, of ``item`` in ``text`` on diagonals first - k to first + width + k; None beyond k edits.

    Row i of the matrix is held for the band only. Both ends in the text are
    free, unless the start is anchored at 0. A gap along the row is a running
    minimum.
    """
    lo, size = first - k, width + 2 * k + 1
    col = np.arange(size)
    at = lo + col  # text position behind which row 0 stands, per column
    row = np.abs(at) if anchored else np.zeros(size, np.int64)
    # outside the text stands a character that nothing equals, at the price of a gap
    area = np.full(size + len(item), 0xFFFFFFFF, np.uint32)
    a, b = max(0, -lo), min(len(area), len(text) - lo)
    if b > a:
        area[a:b] = text[lo + a : lo + b]
    down = np.full(size, 1 << 30, np.int64)
    for i in range(len(item)):
        np.add(row[1:], 1, out=down[:-1])
        row += area[i : i + size] != item[i]
        np.minimum(row, down, out=row)
        row -= col
        np.minimum.accumulate(row, out=row)
        row += col
        if i % 8 == 7 and row.min() > k:
            return None
    best = int(row.argmin())
    return (int(row[best]), min(lo + best + len(item), len(text))) if row[best] <= k else None


def matches(codes: np.ndarray, index: Index) -> list[tuple[int, int, int, int]]:
    """(item number, start, end, edits), the best of each set of overlapping regions of an item."""
    found: dict[int, list] = {}
    for i, first, width in index.candidates(codes):
        _, item, k, _ = index.items[i]
        n = len(item)
        exact = _exact(item, codes, first, first + width)
        if exact is not None:
            found.setdefault(i, []).append((0, exact, exact + n))
            continue
        hit = banded(item, codes, first, width, k)
        if hit is None:
            continue
        edits, end = hit
        back = codes[max(0, end - n - k) : end][::-1]
        reverse = banded(item[::-1], back, 0, 1, k, True)
        start = end - (reverse[1] if reverse else n)
        found.setdefault(i, []).append((edits, max(0, start), end))
    out = []
    for i, rows in found.items():
        kept: list = []
        for e, a, b in sorted(rows):
            if not any(a < y and x < b for _, x, y in kept):
                kept.append((e, a, b))
        out += [(i, a, b, e) for e, a, b in kept]
    return sorted(out)


def _exact(item: np.ndarray, codes: np.ndarray, lo: int, hi: int) -> int | None:
    region = codes[max(0, lo) : hi + len(item)].tobytes()
    at = region.find(item.tobytes())
    while at >= 0 and at % 4:
        at = region.find(item.tobytes(), at + 1)
    return max(0, lo) + at // 4 if at >= 0 else None


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple]]:
    """The items in blocks of about ``block_chars`` characters, one at a time on the driver."""
    rows = items.where(F.length(text_col) > 0).select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    total = rows.agg(F.sum(F.length("t"))).head()[0] or 0
    n = -(-total // block_chars)
    for b in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b)
        yield [(r["i"], r["t"]) for r in part.collect()]


def find_contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    rate: float = EDIT_RATE,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """One row per region of a text that holds an item within the edit budget."""
    small_batches(docs.sparkSession)
    schema = REGIONS.format(docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString())
    names = ["doc", "item", "start", "end", "edits", "item_chars"]
    slim = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    spark = docs.sparkSession

    def regions(held) -> DataFrame:
        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            index = Index(held.value, rate)
            for b in batches:
                rows = []
                for doc, text in zip(b["doc"].astype(object), b["text"]):
                    if isinstance(text, str):
                        rows += [
                            (doc, index.items[i][0], a, e, n, len(index.items[i][1])) for i, a, e, n in matches(normal(text), index)
                        ]
                yield pd.DataFrame(rows, columns=names)

        return slim.mapInPandas(scan, schema)

    out = None
    for held, alone in _held(items, item_col, item_text, block_chars):
        part = regions(held) if alone else materialize(regions(held), "regions")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], schema)
    return out.withColumnsRenamed({"doc": id_col, "item": item_col})


def drop_contaminated(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    rate: float = EDIT_RATE,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """The rows of ``docs`` whose text holds no item; columns as they are."""
    small_batches(docs.sparkSession)
    text = F.col(text_col).cast("string")
    held_by = [F.xxhash64(text), F.xxhash64(text, F.lit(1))]
    for held, alone in _held(items, item_col, item_text, block_chars):
        if alone:
            return docs.where(_clean(held, rate)(text))
        found = materialize(docs.where(~_clean(held, rate)(text)).select(held_by[0].alias("_h"), held_by[1].alias("_i")).distinct(), "contaminated")
        if found.count() <= BROADCAST_TEXTS:
            found = F.broadcast(found)
        docs = docs.join(found, (held_by[0] == F.col("_h")) & (held_by[1] == F.col("_i")), "left_anti")
    return docs


def _held(items: DataFrame, id_col: str, text_col: str, block_chars: int) -> Iterator[tuple]:
    """(broadcast block of items, whether it is the only one); a block is let go when the next is asked for."""
    spark, blocks, held = items.sparkSession, item_blocks(items, id_col, text_col, block_chars), None
    block = next(blocks, None)
    while block is not None:
        after = next(blocks, None)
        alone = held is None and after is None
        held = spark.sparkContext.broadcast(block)
        yield held, alone
        if not alone:
            held.destroy()
        block = after


def _clean(held, rate: float):
    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = Index(held.value, rate)
        for texts in batches:
            yield pd.Series([not (isinstance(t, str) and matches(normal(t), index)) for t in texts], dtype=bool)

    return clean


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
