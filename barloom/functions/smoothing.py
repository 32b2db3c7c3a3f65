"""Exponential smoothing and weekly values of one ticker's bars, for grouped tasks."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa

from .batches import day_numbers, numbers, starts


def _ewm(alpha: float, *columns) -> np.ndarray:
    """Smoothed columns; those of one ``alpha`` go in one call."""
    return pd.DataFrame(np.column_stack(columns)).ewm(alpha=alpha, adjust=False, min_periods=1).mean().to_numpy().T


def _span(k: int) -> float:
    return 2.0 / (k + 1)


def _gains(close: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Moves up and down; the first is none."""
    move = np.diff(close, prepend=np.nan)
    return np.where(move > 0, move, 0.0), np.where(move < 0, -move, 0.0)


def _rsi(up: np.ndarray, down: np.ndarray) -> np.ndarray:
    rsi = 100 - 100 / (1 + up / np.where(down != 0, down, np.nan))
    rsi = np.where((down == 0) & (up > 0), 100.0, rsi)
    return np.where(np.isnan(rsi), 50.0, rsi)


def friday(days: np.ndarray) -> np.ndarray:
    """The Friday that ends a day's week, of days since 1970 (a Thursday)."""
    return days + (1 - days) % 7


SMOOTHED = ("ema_20", "ema_12", "ema_26", "macd_signal", "rsi_14", "adx_14", "w_sma_50", "w_rsi")


def smoothed(g: pd.DataFrame, adapt: bool = True) -> pd.DataFrame:
    """The exponential measures of one ticker (F3, F4, F5, F7) and its weekly ones.

    A history shorter than a span takes its own length for it, and weekly values begin with ten weeks; without ``adapt``
    the spans are fixed and every completed week has its values.
    """
    g = g.sort_values("date", ignore_index=True)
    c, high, low = (g[x].to_numpy(float) for x in ("close", "high", "low"))
    n = len(g) if adapt else 10**9
    out = {f"ema_{k}": _ewm(_span(min(k, n)), c)[0] for k in (20, 12, 26)}
    out["macd_signal"] = _ewm(_span(min(9, n)), out["ema_12"] - out["ema_26"])[0]
    up, down, prev = np.diff(high, prepend=np.nan), -np.diff(low, prepend=np.nan), np.concatenate(([np.nan], c[:-1]))
    tr = np.maximum(np.maximum(high - low, np.abs(high - prev)), np.abs(low - prev))
    moves = (tr, np.where((up > down) & (up > 0), up, 0.0), np.where((down > up) & (down > 0), down, 0.0))
    k, r = max(2, min(14, n - 1)) if n > 2 else 1, min(14, n)
    gain, loss, range_, plus, minus = _ewm(1 / k, *_gains(c), *moves) if k == r else (*_ewm(1 / r, *_gains(c)), *_ewm(1 / k, *moves))
    with np.errstate(divide="ignore", invalid="ignore"):
        out["rsi_14"] = _rsi(gain, loss)
        range_ = np.where(range_ != 0, range_, np.nan)
        plus, minus = 100 * plus / range_, 100 * minus / range_
        both = plus + minus
        adx = _ewm(1 / k, 100 * np.abs(plus - minus) / np.where(both != 0, both, np.nan))[0]
    out["adx_14"] = np.where(np.isnan(adx), 0.0, adx)
    out["w_sma_50"] = out["w_rsi"] = np.full(len(g), np.nan)
    day = g["date"].to_numpy().astype("datetime64[D]").astype("int64")
    week = friday(day)
    ends = np.flatnonzero(np.diff(week, append=week[-1] + 7)) if len(g) else np.array([], int)
    m = len(ends)
    if m >= (10 if adapt else 1):
        # values of a week are known from the label of the next one on
        at = np.searchsorted(week[ends], day, side="right") - 2
        weekly = c[ends]
        with np.errstate(divide="ignore", invalid="ignore"):
            rsi = _rsi(*_ewm(1 / (min(14, m) if adapt else 14), *_gains(weekly)))
        for name, values in (("w_sma_50", pd.Series(weekly).rolling(50, min_periods=1).mean().to_numpy()), ("w_rsi", rsi)):
            out[name] = np.where(at >= 0, values[np.maximum(at, 0)], np.nan)
    return g.assign(**out)


#: Bars and weeks from which a history takes every span as it is.
LONG, LONG_WEEKS = 26, 14


def _by(groups: np.ndarray, alpha: float, *columns) -> np.ndarray:
    """As ``_ewm``, each group by itself."""
    return pd.DataFrame(np.column_stack(columns)).groupby(groups).ewm(alpha=alpha, adjust=False, min_periods=1).mean().to_numpy().T


def _smoothed_long(t: pa.Table) -> dict[str, np.ndarray]:
    """As ``smoothed`` for tickers that are long enough for every span, in one pass."""
    first = starts(t)
    own = np.repeat(np.arange(len(first)), np.diff(first, append=t.num_rows))
    c, high, low = (numbers(t, x) for x in ("close", "high", "low"))

    def moves(x, begin):
        d = np.diff(x, prepend=np.nan)
        d[begin] = np.nan
        return d

    out = {f"ema_{k}": _by(own, _span(k), c)[0] for k in (20, 12, 26)}
    out["macd_signal"] = _by(own, _span(9), out["ema_12"] - out["ema_26"])[0]
    up, down, prev = moves(high, first), -moves(low, first), np.concatenate(([np.nan], c[:-1]))
    prev[first] = np.nan
    tr = np.maximum(np.maximum(high - low, np.abs(high - prev)), np.abs(low - prev))
    dms = (np.where((up > down) & (up > 0), up, 0.0), np.where((down > up) & (down > 0), down, 0.0))

    def split(move):
        return np.where(move > 0, move, 0.0), np.where(move < 0, -move, 0.0)

    gain, loss, range_, plus, minus = _by(own, 1 / 14, *split(moves(c, first)), tr, *dms)
    day = day_numbers(t)
    week = friday(day)
    last = (np.diff(week, append=week[-1] + 7) != 0) | (np.diff(own, append=-1) != 0)
    ends = np.flatnonzero(last)
    weekly, of = c[ends], own[ends]
    begin = np.flatnonzero(np.diff(of, prepend=-1))
    with np.errstate(divide="ignore", invalid="ignore"):
        out["rsi_14"] = _rsi(gain, loss)
        range_ = np.where(range_ != 0, range_, np.nan)
        plus, minus = 100 * plus / range_, 100 * minus / range_
        both = plus + minus
        adx = _by(own, 1 / 14, 100 * np.abs(plus - minus) / np.where(both != 0, both, np.nan))[0]
        rsi = _rsi(*_by(of, 1 / 14, *split(moves(weekly, begin))))
    out["adx_14"] = np.where(np.isnan(adx), 0.0, adx)
    # a bar knows the weeks before its own, of these the last one from the next label on
    at = np.cumsum(last) - last + (day == week) - 2
    known = at >= begin[own]
    means = pd.Series(weekly).groupby(of).rolling(50, min_periods=1).mean().to_numpy()
    for name, values in (("w_sma_50", means), ("w_rsi", rsi)):
        out[name] = np.where(known, values[np.maximum(at, 0)], np.nan)
    return out


def smoothed_batch(t: pa.Table, adapt: bool = True) -> pa.Table:
    """``smoothed`` for a table of whole tickers in order: the long ones in one pass, the others one by one."""
    first = starts(t)
    n = np.diff(first, append=t.num_rows)
    own = np.repeat(np.arange(len(first)), n)
    single = np.isin(np.arange(len(first)), own[t["date"].is_null().to_numpy()])
    if adapt and not single.all():
        week = friday(day_numbers(t.set_column(t.column_names.index("date"), "date", t["date"].fill_null(pa.scalar(0, pa.int32()).cast(pa.date32())))))
        weeks = np.bincount(own, np.diff(week, prepend=week[0] - 7) != 0)
        single |= (n < LONG) | (weeks < LONG_WEEKS + 1)
    schema = pa.schema([*t.schema, *[(c, pa.float64()) for c in SMOOTHED]])
    parts = [pa.Table.from_pandas(smoothed(t.slice(first[i], n[i]).to_pandas(), adapt), schema=schema, preserve_index=False) for i in np.flatnonzero(single)]
    if not single.all():
        long = t.filter(pa.array(~single[own])).combine_chunks() if single.any() else t
        out = _smoothed_long(long)
        parts.append(pa.table([*long.columns, *[pa.array(out[c], from_pandas=True) for c in SMOOTHED]], schema=schema))
    return pa.concat_tables(parts)
