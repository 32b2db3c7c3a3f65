"""Secret scans over whole texts.

Two families of findings:

* pattern findings (``assign``, ``access``, ``hex``): leftmost, non-overlapping
  matches of a fixed pattern for each kind;
* ``entropy`` findings: a window slides over every candidate string, its
  Shannon entropy is kept by incremental counts, and stretches of windows at or
  above the threshold of the string's character class become findings, unless
  an allow-list entry suppresses them. Characters of a pattern finding are taken
  out of a stretch; the rest of it stays a finding, however short.

Edge cases: a null or empty text has no findings; repeated rows are scanned
each on its own, null ids stay; an empty table gives no rows; only the id and
the text are read, so other columns may have any name. Offsets count code
points, ends are exclusive. The scan is one pass without a shuffle, so a hot
source or a very long text costs only its size.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ._common import small_batches

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{24,}")

#: Length of the sliding window, in characters.
WINDOW = 24
#: Least entropy in bits a character, by the character class of the string.
THRESHOLDS = {"hex": 3.2, "letters": 4.3, "mixed": 4.0}
#: Strings of these shapes, and parts of strings that hold these words, are not secrets.
ALLOW_SHAPES = (
    re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),
    re.compile(r"[0-9]+"),
)
JOINS = "+/_=-"
_PART = re.compile(r"[A-Za-z0-9]+")
ALLOW_WORDS = ("example", "placeholder", "changeme", "abcdefgh", "0123456789")

FINDING = "struct<kind:string,start:int,end:int,entropy:double>"
_XLOG = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 1)]


#: Letters and the signs that join words in paths and names.
_LETTERS = re.compile(r"[/_A-Za-z-]+")


def char_class(s: str) -> str:
    if re.fullmatch(r"[0-9a-fA-F]+", s):
        return "hex"
    return "letters" if _LETTERS.fullmatch(s) else "mixed"


def allowed(s: str) -> bool:
    return any(p.fullmatch(s) for p in ALLOW_SHAPES)


def unworded(s: str) -> list[tuple[int, str]]:
    """``s`` without the parts (between joining signs) that hold an allow word: offsets and strings of a window or more."""
    low = s.lower()
    if not any(w in low for w in ALLOW_WORDS):
        return [(0, s)]
    out, at = [], 0
    ends = [m.span() for m in _PART.finditer(low) if any(w in m[0] for w in ALLOW_WORDS)]
    for a, b in [*ends, (len(s), len(s))]:
        piece = s[at:a].rstrip(JOINS) if a < len(s) else s[at:a]
        start = at + (len(piece) - len(piece.lstrip(JOINS)) if at else 0)
        piece = s[start : at + len(piece)]
        if len(piece) >= WINDOW:
            out.append((start, piece))
        at = b
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same characters as disjoint spans, by start."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def uncovered(a: int, b: int, base: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The parts of a stretch outside all base spans. ``base``: disjoint, by start; only those in reach are looked at."""
    out, i = [], max(bisect_right(base, (a, a)) - 1, 0)
    while i < len(base) and base[i][0] < b:
        x, y = base[i]
        if a < y:
            out.append((a, x))
            a = y
        i += 1
    return [(x, y) for x, y in [*out, (a, b)] if x < y]


def entropy_spans(s: str, window: int = WINDOW) -> list[tuple[int, int, float]]:
    """Stretches of ``s`` covered by windows at or above the threshold.

    Moving the window by one character changes two counts, so the sum of
    c * log2(c) is updated in constant time.
    """
    least = THRESHOLDS[char_class(s)]
    counts: dict[str, int] = {}
    total, out = 0.0, []
    xlog = _XLOG if window == WINDOW else [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    base = math.log2(window)
    for i, ch in enumerate(s):
        if i >= window:
            old = s[i - window]
            c = counts[old]
            total += xlog[c - 1] - xlog[c]
            counts[old] = c - 1
        c = counts.get(ch, 0)
        total += xlog[c + 1] - xlog[c]
        counts[ch] = c + 1
        if i >= window - 1 and (h := base - total / window) >= least - 1e-9:
            start = i - window + 1
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], i + 1, max(out[-1][2], h))
            else:
                out.append((start, i + 1, h))
    return out


def find(text: str) -> list[tuple[str, int, int, float | None]]:
    """All findings of one text, by start, then by kind as listed."""
    found: list[tuple[str, int, int, float | None]] = []
    found += [("assign", m.start(), m.end(), None) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), None) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # greedy runs: a run of 24 or more is one match of HEX as a whole
    found += [("hex", m.start(), m.end(), None) for m in _LONG_HEX.finditer(text)]
    base = merged([(a, b) for _, a, b, _ in found])
    for m in CANDIDATE.finditer(text):
        for at, s in unworded(m[0]):
            if allowed(s):
                continue
            at += m.start()
            for a, b, h in entropy_spans(s):
                if allowed(s[a:b]):
                    continue
                rest = uncovered(a + at, b + at, base)
                found += [("entropy", x, y, h) for x, y in rest if text[x:y].strip(JOINS)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


#: A match of HEX is a whole run, so runs of 24 or more can be asked for directly.
_LONG_HEX = re.compile(r"[0-9a-f]{24,}")


def redact(text: str, found: list, mark: str = "[SECRET]") -> str:
    parts, at = [], 0
    for _, a, b, _ in found:
        if b <= at:
            continue
        parts += [text[at:a], mark] if a >= at else []
        at = b
    return "".join([*parts, text[at:]]) if found else text


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id and ``findings``."""
    small_batches(docs.sparkSession)
    dtype = docs.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [find(t) if isinstance(t, str) else [] for t in b["text"]]
            rows = [[dict(zip(("kind", "start", "end", "entropy"), x)) for x in f] for f in found]
            yield pd.DataFrame({"id": b["id"], "findings": rows})

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInPandas(scan, f"id {dtype}, findings array<{FINDING}>").withColumnRenamed("id", id_col)


@F.pandas_udf(StringType())
def redact_secrets(texts: pd.Series) -> pd.Series:
    """The texts with every finding replaced by a mark; nulls stay."""
    return texts.map(lambda t: redact(t, find(t)), na_action="ignore")


def _joined(findings: str) -> F.Column:
    return F.array_join(
        F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ","
    )


def op1_secret_scan(spark, sf_dir: str) -> DataFrame:
    from ._common import table

    found = scan_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("findings", lambda f: f["kind"] != "entropy")

    def count(kind):
        return F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("findings")).alias("spans"),
        count("entropy").alias("n_entropy"),
    )
