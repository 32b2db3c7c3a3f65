"""Event study (K6): signals on every bar, barriers ahead, one open trade a ticker.

Signals are vectorised; only the walk from trade to trade inside a fold is
sequential, and it jumps: the exit of a trade is found by a search over the
arrays of the fold, not by stepping through bars.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import HOLD, ROUND_TRIP, STEP, T, TEST, TRAIN
from ..functions import rules as R
from ..functions.batches import by_ticker, numbers, starts
from ..functions.isolation import sound
from .market import scan, universe, with_sector

TRADES = (
    "ticker string, fold int, action string, entry_date date, entry_price double, exit_date date, exit_price double, exit_reason string, "
    "return_pct double, holding_bars int, sector string, adx double, rsi double, gap_pct double, vol_ratio double, vol_z double"
)
PRICES = ("open", "high", "low", "close", "stop", "target")
MEASURES = ("adx_14", "rsi_14", "gap_pct", "volume_ratio", "vol_z_score")
_KINDS = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "date": pa.date32()}
WALKED = [(n, _KINDS[k]) for n, k in (f.split() for f in TRADES.split(", ")) if n != "sector"] + [("error", pa.string())]


def signals(bars: DataFrame) -> DataFrame:
    """Every bar with its buy signal, if it has one (C15), and its barriers."""
    df = scan(bars)
    a = F.col("raw_action")
    buy = F.col("liquid") & F.col("confirmed") & ((a == "STRONG BUY") | R.is_breakout(a) | a.isin("BUY ON DIP", "ACCUMULATE"))
    atr = F.when(F.col("atr_14") > 0, F.col("atr_14")).otherwise(F.col("close") * 0.02)
    gain = F.greatest(atr * T.profit_atr / F.col("close"), F.lit(T.profit_floor_pct / 100))
    return df.withColumns(
        {"signal": buy, "stop": F.bround(R.stop_loss("close", atr), 4), "target": F.bround(F.col("close") * (1 + gain + ROUND_TRIP), 4)}
    )


def _exit(low, high, stop, target, start, stop_at):
    """Place of the first bar from ``start`` that touches a barrier; the stop comes first on the same bar."""
    down = np.flatnonzero(low[start : stop_at + 1] <= stop)
    up = np.flatnonzero(high[start : stop_at + 1] >= target)
    a, b = (x[0] if len(x) else stop_at + 1 for x in (down, up))
    if min(a, b) > stop_at - start:
        return stop_at, "time"
    return start + min(a, b), "stop_loss" if a <= b else "take_profit"


def _trades(g: dict[str, np.ndarray], action, train: int, test: int, step: int, hold: int) -> list[tuple]:
    """The closed trades of one ticker, its bars in order: fold, signal's bar, entry, exit, price, reason, return. ``action``: of a bar."""
    o, h, lo, c, stop, target = (g[x] for x in ("open", "high", "low", "close", "stop", "target"))
    n, rows = len(o), []
    at = np.flatnonzero(g["signal"])
    for fold, start in enumerate(range(train, n - test + 1, step), 1):
        end, t = start + test, start
        while True:
            k = np.searchsorted(at, t)
            if k == len(at) or at[k] + 1 >= end:  # an entry on the next fold is discarded
                break
            s, e = at[k], at[k] + 1
            if not o[e] > 0:
                t = s + 1
                continue
            final = min(e + hold, end - 1, n - 1)
            x, why = _exit(lo, h, stop[s], target[s], e, final)
            price = {"stop_loss": stop[s], "take_profit": target[s], "time": c[x]}[why]
            why = why if why != "time" else ("max_hold" if x < end - 1 else "fold_end")
            net = (price / o[e] - 1) * 100 - ROUND_TRIP * 100
            rows.append((fold, action(s), g["date"][e], float(round(o[e], 4)), g["date"][x], float(round(price, 4)), why, float(round(net, 3)), int(x - e)) + tuple(float(g[v][s]) for v in MEASURES))
            t = x + 1
    return rows


def walk(g: pd.DataFrame, train: int = TRAIN, test: int = TEST, step: int = STEP, hold: int = HOLD) -> pd.DataFrame:
    """The closed trades of one ticker."""
    g = g.sort_values("date", ignore_index=True)
    columns = {x: g[x].to_numpy(float) for x in (*PRICES, *MEASURES)} | {"signal": g["signal"].to_numpy(bool), "date": g["date"]}
    rows = _trades(columns, lambda s: g["raw_action"][s], train, test, step, hold)
    return pd.DataFrame([(g["ticker"][0], *r[:9], g["sector"][0], *r[9:]) for r in rows], columns=[f.split()[0] for f in TRADES.split(", ")])


def _walked(t: pa.Table, args: tuple, isolate: bool) -> pa.Table:
    """The trades of whole tickers; with ``isolate`` a ticker whose walk fails is one row, with its error."""
    columns = {x: numbers(t, x) for x in (*PRICES, *MEASURES)} | {"signal": pc.fill_null(t["signal"], False).to_numpy(), "date": t["date"].cast(pa.int32()).to_numpy()}
    first = starts(t)
    rows = []
    for i, j in zip(first, np.append(first[1:], t.num_rows)):
        ticker, blank = t["ticker"][i].as_py(), (None,) * (len(WALKED) - 2)
        g = {k: v[i:j] for k, v in columns.items()}
        try:
            if isolate:
                sound(pd.DataFrame({"date": t["date"].slice(i, j - i).to_pandas(), "close": g["close"]}))
            rows += [(ticker, *r, None) for r in _trades(g, lambda s: t["raw_action"][int(i + s)].as_py(), *args)]
        except Exception as e:
            if not isolate:
                raise
            rows.append((ticker, *blank, f"{type(e).__name__}: {e}"))
    values = zip(*rows) if rows else ([] for _ in WALKED)
    return pa.table([pa.array(v, kind, from_pandas=True) for v, (_, kind) in zip(values, WALKED)], names=[n for n, _ in WALKED])


def _study(bars: DataFrame, sectors: DataFrame, args: tuple, isolate: bool) -> DataFrame:
    """Trades with ``error``; only they are given their sector."""
    action = F.when(F.col("signal"), F.col("raw_action")).alias("raw_action")
    rows = signals(universe(bars, None)).select("ticker", "date", *PRICES, "signal", action, *MEASURES)
    found = by_ticker(rows, lambda t: _walked(t, args, isolate), f"{TRADES.replace(' sector string,', '')}, error string")
    found = with_sector(found, sectors).withColumn("sector", F.when(F.col("error").isNull(), F.col("sector")))
    return found.select(*[f.split()[0] for f in TRADES.split(", ")], "error")


def event_study(bars: DataFrame, sectors: DataFrame, train: int = TRAIN, test: int = TEST, step: int = STEP, hold: int = HOLD) -> DataFrame:
    """K6: the trades of every ticker, its history from the last long gap on (F1)."""
    return _study(bars, sectors, (train, test, step, hold), False).drop("error")


def event_study_or_error(bars: DataFrame, sectors: DataFrame, train: int = TRAIN, test: int = TEST, step: int = STEP, hold: int = HOLD) -> DataFrame:
    """K6 with M5: trades with the column ``error``; a ticker whose walk fails is one row."""
    return _study(bars, sectors, (train, test, step, hold), True)
