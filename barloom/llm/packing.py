"""Hierarchical packing of token sequences into windows of several lengths.

Documents are tokenized and packed where they are read, so no token crosses a
shuffle and a hot source or a very long document is only more windows.

Within a task: whole windows are cut from a document at once, and its remainder
is routed to a tier, the smallest power of two that holds it. From time to time
(and at the end) the tiers are packed: a remainder of the longest tier opens a
window, the gap behind it is filled with the best fitting remainders of the
shorter tiers, and a cut closes what is left. Remainders of shorter tiers that
no gap took are packed into windows of their own tier. What is left at the
task's end becomes windows of falling powers of two, so no window is padded.

Windows of one tier are dealt to step groups of equal token counts.

Edge cases: a null text is empty and yields the end id alone; repeated rows are
packed each (null ids too); an empty table yields no pieces; a very long text is
many windows; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import kept, small_batches

WINDOW = 2048
TIERS = (256, 512, 1024, 2048)
#: Tokens of remainders that a task holds before it packs them.
HOLD_TOKENS = 1_000_000
#: Tokens of a step group.
STEP_TOKENS = 64 * 2048
END_ID = 1

PIECES = (
    "doc_id {}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long, "
    "window long, tier int, step_group long"
)


class _Numbers(dict):
    """Numbers words as they are first asked for.

    Two kinds of words cost no encoding of their own: those that lower-casing
    (which the vocabulary does too) turns into another, and letters with marks
    behind them, which the vocabulary always splits there.
    """

    MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

    def __init__(self):
        super().__init__()
        self.count = 0
        self.new: list[tuple[int, str]] = []
        self.joined: list[tuple[int, int, int]] = []

    def __missing__(self, word: str) -> int:
        if word and max(word) < "\u0130" and (low := word.lower()) != word:
            n = self[word] = self[low]
            return n
        letters = word.rstrip(self.MARKS)
        parts = (self[letters], self[word[len(letters) :]]) if letters != word and _all_letters(letters) else None
        n = self[word] = self.count
        self.count += 1
        if parts:
            self.joined.append((n, *parts))
        else:
            self.new.append((n, word))
        return n


def _all_letters(word: str) -> bool:
    """Whether the word is letters alone in the vocabulary's normal form too (some letters turn into one with a mark)."""
    return word.isalpha() and (word.isascii() or unicodedata.normalize("NFC", word.lower()).isalpha())


class WordTokenizer:
    """Encodes word by word and remembers the words.

    The vocabulary's tokenizer drops white space and never joins across it, so
    a text's ids are those of its words in a row. A line feed, which no word
    holds, stands for the end of a text.
    """

    #: Words that are remembered before all are forgotten.
    KEEP = 600_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.keep = self.KEEP
        self.t = Tokenizer.from_file(path)
        suffix = getattr(self.t.model, "end_of_word_suffix", None)
        self.ends = np.zeros(self.t.get_vocab_size(), bool)
        for token, i in self.t.get_vocab().items() if suffix else ():
            self.ends[i] = token.endswith(suffix)
        self.forget()

    def forget(self) -> None:
        self.numbers = _Numbers()
        self.numbers["\n"], self.numbers.count = 0, 1
        self.ids, self.start, self.size, self.used = np.array([END_ID], "<u4"), np.zeros(1, np.int64), np.ones(1, np.int64), 1

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words in a row, and where each word's end."""
        n = self.size[numbers]
        stop = np.cumsum(n)
        return self.ids[np.repeat(self.start[numbers] - (stop - n), n) + np.arange(stop[-1] if len(stop) else 0)], stop

    def place(self, numbers: list[int], ids: np.ndarray, size: np.ndarray) -> None:
        have, need = len(self.ids), self.used + len(ids)
        if need > have:
            self.ids = np.concatenate([self.ids, np.zeros(max(need - have, have), "<u4")])
        self.start[numbers] = self.used + np.cumsum(size) - size
        self.size[numbers] = size
        self.ids[self.used : need] = ids
        self.used = need

    def learn(self) -> None:
        new, self.numbers.new = self.numbers.new, []
        joined, self.numbers.joined = self.numbers.joined, []
        more = np.zeros(self.numbers.count - len(self.start), np.int64)
        self.start, self.size = np.concatenate([self.start, more]), np.concatenate([self.size, more])
        letters, others = [], []
        for x in new:
            (letters if _all_letters(x[1]) else others).append(x)
        for i in range(0, len(letters), 500):
            part = letters[i : i + 500]
            # a word of letters is one word of the vocabulary, so where its last id stands is known
            ids = np.array(self.t.encode_batch_fast([" ".join([w for _, w in part])], add_special_tokens=False)[0].ids, "<u4")
            stop = np.flatnonzero(self.ends[ids]) + 1
            if len(stop) == len(part):
                self.place([n for n, _ in part], ids, np.diff(stop, prepend=0))
            else:
                others += part
        for i in range(0, len(others), 20_000):
            part = others[i : i + 20_000]
            each = [e.ids for e in self.t.encode_batch_fast([w for _, w in part], add_special_tokens=False)]
            size = np.fromiter(map(len, each), np.int64, len(each))
            self.place([n for n, _ in part], np.fromiter(chain.from_iterable(each), "<u4", size.sum()), size)
        if joined:
            which = np.array(joined, np.int64)
            ids, stop = self.gather(which[:, 1:].ravel())
            self.place(which[:, 0], ids, np.diff(stop[1::2], prepend=0))

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, with the end id behind them."""
        if len(self.numbers) > self.keep:
            self.forget()
        blank = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ") for t in texts]
        words = " \n ".join([*blank, ""])[:-1].split(" ")
        at = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        if self.numbers.new or self.numbers.joined:
            self.learn()
        flat, stop = self.gather(at)
        return np.split(flat, stop[np.flatnonzero(at == 0)][:-1])


def tokenizer_of(path: str) -> WordTokenizer:
    """One per Python worker: what a task has learned serves the next."""
    return kept("tokenizer", path, lambda: WordTokenizer(path))


class Packer:
    """Packs pieces (row, start, ids) of one task; gathers finished pieces in ``out``."""

    def __init__(self, task: int, window: int, tiers: tuple[int, ...], step_tokens: int):
        self.window, self.tiers, self.step_tokens = window, tiers, step_tokens
        self.first = task << 36
        self.count = self.held = 0
        self.waiting: dict[int, list] = {t: [] for t in tiers}
        self.step = {}
        self.out: list[tuple] = []

    def add(self, doc, ids: np.ndarray) -> None:
        n, at = len(ids), 0
        while n - at >= self.window:
            self.emit([(doc, at, ids[at : at + self.window], n)])
            at += self.window
        if at < n:
            self.route((doc, at, ids[at:], n))
            self.held += n - at

    def route(self, piece) -> None:
        self.waiting[next(t for t in self.tiers if t >= len(piece[2]))].append(piece)

    def emit(self, pieces: list) -> None:
        total = sum(len(p[2]) for p in pieces)
        length = total if total & (total - 1) == 0 else self.window
        tier = next(t for t in self.tiers if t >= length)
        group, used = self.step.get(tier, (0, 0))
        if used and used + length > self.step_tokens:
            group, used = group + 1, 0
        self.step[tier] = (group, used + length)
        seq, at = self.first + self.count, 0
        self.count += 1
        step = (self.first + group) * len(self.tiers) + self.tiers.index(tier)
        for doc, start, ids, n in pieces:
            self.out.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), n, seq, at, length, tier, step))
            at += len(ids)

    @staticmethod
    def cut(piece, n: int):
        doc, start, ids, total = piece
        return (doc, start, ids[:n], total), (doc, start + n, ids[n:], total)

    def pack(self, last: bool) -> None:
        long, short = self.waiting[self.tiers[-1]], [p for t in self.tiers[:-1] for p in self.waiting[t]]
        self.waiting = {t: [] for t in self.tiers}
        shelf: dict[int, list] = {}
        mask = 0  # bit n: a remainder of n tokens is on the shelf
        for p in short:
            shelf.setdefault(len(p[2]), []).append(p)
            mask |= 1 << len(p[2])

        def off(n: int):
            nonlocal mask
            p = shelf[n].pop()
            if not shelf[n]:
                mask &= ~(1 << n)
            return p

        long.sort(key=lambda p: len(p[2]))
        while long:
            own = [long.pop()]
            gap = self.window - len(own[0][2])
            while gap and (fits := mask & ((1 << (gap + 1)) - 1)):
                own.append(off(fits.bit_length() - 1))
                gap -= len(own[-1][2])
            if gap:  # only longer remainders are left: one is cut to close the window
                if mask:
                    a, b = self.cut(off((mask & -mask).bit_length() - 1), gap)
                    shelf.setdefault(len(b[2]), []).append(b)
                    mask |= 1 << len(b[2])
                elif long:
                    a, b = self.cut(long.pop(0), gap)
                    if len(b[2]) > self.tiers[-2]:
                        long.insert(0, b)
                    else:
                        shelf.setdefault(len(b[2]), []).append(b)
                        mask |= 1 << len(b[2])
                else:
                    self.route(own[0]) if len(own) == 1 else [self.route(p) for p in own]
                    break
                own.append(a)
            self.emit(own)
        rest = [p for ps in shelf.values() for p in ps]
        for tier in self.tiers[:-1]:
            part = [p for p in rest if len(p[2]) <= tier]
            rest = [p for p in rest if len(p[2]) > tier]
            # what does not fill a window of this tier moves up to the next
            rest += self.close(part, tier)
        if last:
            rest += [p for ps in self.waiting.values() for p in ps]
            self.waiting = {t: [] for t in self.tiers}
            rest = self.close(rest, self.window)
            size = self.window
            while rest:
                size //= 2
                if sum(len(p[2]) for p in rest) >= size:
                    rest = self.close(rest, size)
            self.held = 0
        else:
            for p in rest:
                self.route(p)
            self.held = sum(len(p[2]) for ps in self.waiting.values() for p in ps)

    def close(self, pieces: list, size: int) -> list:
        """Full windows of ``size`` from pieces in a row; the pieces left over."""
        own, room, todo = [], size, pieces[::-1]
        while todo:
            p = todo.pop()
            if len(p[2]) > room:
                p, b = self.cut(p, room)
                todo.append(b)
            own.append(p)
            room -= len(p[2])
            if not room:
                self.emit(own)
                own, room = [], size
        return own


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    tiers: tuple[int, ...] = TIERS,
    hold_tokens: int = HOLD_TOKENS,
    step_tokens: int = STEP_TOKENS,
    keep_words: int = WordTokenizer.KEEP,
) -> DataFrame:
    """One row per piece. ``tokenizer`` is the path of the vocabulary file on the executors.

    ``keep_words``: words that a worker remembers, about 300 bytes each; fewer cost time and change nothing else.
    """
    small_batches(docs.sparkSession)
    dtype = docs.schema[id_col].dataType.simpleString()
    schema = PIECES.format(dtype)
    names = [x.split()[0].strip("`") for x in schema.split(", ")]

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = TaskContext.get()
        packer = Packer(context.partitionId() if context else 0, window, tiers, step_tokens)
        tok = tokenizer_of(tokenizer)
        tok.keep = keep_words

        def flush():
            out, packer.out = packer.out, []
            return pd.DataFrame(out, columns=names)

        for b in batches:
            texts = [t if isinstance(t, str) else "" for t in b["text"]]
            for lo, hi in slices(texts):
                for doc, ids in zip(b["id"].iloc[lo:hi], tok.encode_all(texts[lo:hi])):
                    packer.add(doc, ids)
                if packer.held > hold_tokens:
                    packer.pack(False)
                if packer.out:
                    yield flush()
        packer.pack(True)
        if packer.out:
            yield flush()

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInPandas(pack, schema).withColumnRenamed("doc_id", id_col)


def slices(texts: list[str], chars: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of about so many characters."""
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op10_tier_packing(spark, sf_dir: str) -> DataFrame:
    from ._common import table

    return pack_documents(table(spark, sf_dir, "documents"), vocabulary())
