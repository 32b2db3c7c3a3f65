"""Constants of the market scan. Results depend on them."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Thresholds:
    # raw action
    sell_ratio: float = 0.75
    sell_rsi: float = 28.0
    strong_pos: float = 88.0
    strong_rsi_lo: float = 58.0
    strong_rsi_hi: float = 72.0
    strong_gap: float = 0.2
    momentum_rsi: float = 55.0
    breakout_gap: float = 0.0
    trend_ratio: float = 0.97
    trend_rsi: float = 42.0
    trend_cmf: float = -0.05
    dip_pos: float = 20.0
    dip_rsi: float = 35.0
    acc_pos: float = 45.0
    acc_rsi: float = 45.0
    acc_cmf: float = 0.0
    # confirmation
    adx_min: float = 22.0
    vol_ratio: float = 1.6
    vol_z: float = 1.5
    vwap_ratio: float = 1.01
    dip_cmf: float = 0.15
    # exits
    atr_stop: float = 2.0
    cut_loss_pct: float = -8.0
    vwap_cut: float = 0.92
    profit_floor_pct: float = 2.0
    profit_atr: float = 2.5
    default_profit_pct: float = 5.0
    # history
    gap_days: int = 25
    min_bars: int = 15
    lookback: int = 250
    #: Days before the latest date that the market scan looks at.
    scan_days: int = 400
    min_avg_volume: float = 50_000.0


@dataclass(frozen=True)
class Weights:
    sell: float = -45.0
    strong: float = 48.0
    crossover: float = 32.0
    momentum: float = 24.0
    dip: float = 30.0
    accumulate: float = 10.0
    hold: float = 0.0
    unconfirmed: float = 0.25
    cmf_bonus: float = 12.0
    cmf_from: float = 0.15
    squeeze: float = 8.0
    weekly: float = 15.0
    illiquid: float = -40.0
    range_pos: float = 0.05
    confidence: float = 0.3
    projected: float = 1.5


T, W = Thresholds(), Weights()
FEE, ROUND_TRIP = 0.0035, 0.007
RISK_PER_TRADE = 0.01
NO_SECTOR = "General / Diversified"
#: Bars that a folded backtest needs.
TRAIN, TEST, STEP, HOLD = 250, 60, 60, 60
