"""M1: users' own pattern detectors, as table functions that Spark runs once a ticker.

A detector is a class with ``detect(bars)``: it gets one ticker's bars in the
order of their dates (dicts with idx, date, open, high, low, close, volume) and
gives ``Match`` rows. ``register`` adds it to those that ``detect_all`` runs; no
code of the library has to be touched. The class runs as a Python table function
over the bars, partitioned by ticker and ordered by date, so Spark shuffles and
sorts, and a task holds one ticker.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import structure

FIELDS = ("date", "open", "high", "low", "close", "volume")
MATCHES = "ticker string, pattern string, direction string, start_index int, end_index int, start_date date, end_date date, levels map<string, double>, quality double"


class Match(NamedTuple):
    """One match; the dates follow from the bar numbers."""

    pattern: str
    direction: str
    start: int
    end: int
    levels: dict
    quality: float


class Detector:
    """Base of a user's detector."""

    def detect(self, bars: list[dict]) -> Iterable[Match]:
        raise NotImplementedError


def _function(cls: type[Detector]):
    class Run:
        def __init__(self) -> None:
            self.ticker, self.bars = None, []

        def eval(self, row) -> None:
            self.ticker = row["ticker"]
            self.bars.append({"idx": len(self.bars)} | {f: row[f] for f in FIELDS})

        def terminate(self):
            for m in cls().detect(self.bars) if self.bars else ():
                levels = {k: float(v) for k, v in m.levels.items()}
                yield self.ticker, m.pattern, m.direction, m.start, m.end, self.bars[m.start]["date"], self.bars[m.end]["date"], levels, round(float(m.quality), 2)

    return F.udtf(Run, returnType=MATCHES)


def matches(bars: DataFrame, cls: type[Detector]) -> DataFrame:
    """The rows of one detector."""
    return _function(cls)(bars.select("ticker", *FIELDS).asTable().partitionBy("ticker").orderBy("date"))


def as_detector(cls: type[Detector]):
    """A detector class in the form that ``structure.DETECTORS`` holds."""
    return lambda prepared: matches(prepared.bars, cls)


def register(name: str, cls: type[Detector]) -> None:
    """From now on ``detect_all`` runs the detector too; a name that is taken is an error."""
    if name in structure.DETECTORS:
        raise ValueError(f"there is a detector named {name}")
    structure.DETECTORS[name] = as_detector(cls)


def unregister(name: str) -> None:
    structure.DETECTORS.pop(name)
