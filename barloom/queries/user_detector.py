"""A detector as a user would write it; workers import this module alone."""

from __future__ import annotations

from ..operators.detectors import Detector, Match


class KeyReversal(Detector):
    """A bar that goes below the one before it and closes above that one's high."""

    def detect(self, bars):
        for a, b in zip(bars, bars[1:]):
            if b["low"] < a["low"] and b["close"] > a["high"]:
                yield Match("Key Reversal", "bullish", a["idx"], b["idx"], {"trigger": a["high"], "stop": b["low"]}, (b["close"] - a["high"]) / a["high"])
