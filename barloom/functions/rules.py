"""Scalar rules as Column builders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import FEE, RISK_PER_TRADE, ROUND_TRIP, T, W


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


#: I1, fixed labels.
TIERS = ([20, 60, 150], ["Very Low (New/Short History)", "Low (<3 Months)", "Medium (<1 Year)", "High (1Y+)"])


def confidence_tier(n) -> Column:
    """I1."""
    return bucket(n, *TIERS)


def volatility_regime(n, adx, atr, close) -> Column:
    """I2."""
    share = F.when(c(close) > 0, c(atr) / c(close) * 100).otherwise(0.0)
    strong = c(adx) >= 25
    return (
        F.when(c(n) < 20, "Insufficient Data")
        .when(strong & (share >= 2.5), "Trending / Volatile")
        .when(strong, "Trending")
        .when(share >= 3.5, "Volatile Range")
        .otherwise("Range / Consolidation")
    )


def confidence_weight(n) -> Column:
    """0.5 at 25 bars or fewer, 1 at 250 or more, linear between."""
    return F.lit(0.5) + F.lit(0.5) * F.least(F.greatest((c(n) - 25) / F.lit(225.0), F.lit(0.0)), F.lit(1.0))


def kelly_fraction(win_rate, payoff) -> Column:
    """I4: half of Kelly's share, within 0 and a quarter."""
    w, p = F.least(F.greatest(c(win_rate), F.lit(0.0)), F.lit(1.0)), F.greatest(c(payoff), F.lit(1e-6))
    return F.least(F.greatest((w - (1 - w) / p) * 0.5, F.lit(0.0)), F.lit(0.25))


def graduated(v, soft_lo: float, lo: float, hi: float, soft_hi: float, points: float) -> Column:
    """Full points within lo and hi, falling to zero at the soft ends; null counts zero."""
    v = c(v)
    out = F.when((v >= lo) & (v <= hi), F.lit(float(points)))
    if lo > soft_lo:
        out = out.when((v > soft_lo) & (v < lo), points * (v - soft_lo) / (lo - soft_lo))
    if soft_hi > hi:
        out = out.when((v > hi) & (v < soft_hi), points * (soft_hi - v) / (soft_hi - hi))
    return out.otherwise(F.lit(0.0))


def eta_days(price, target, start, end, n) -> Column:
    """Bars until the target at the pace from ``start`` to ``end`` over n bars; null without a rising pace."""
    rate = F.pow(c(end) / c(start), 1.0 / c(n)) - 1
    days = F.greatest(F.rint(F.log(c(target) / c(price)) / F.log(1 + rate)), F.lit(1.0)).cast("int")
    return F.when((c(price) > 0) & (c(target) > 0), F.when(c(target) <= c(price), F.lit(0)).when((c(n) >= 3) & (rate > 0), days))


def target_fields(mode, value, buy, shares) -> dict[str, Column]:
    """A profit target as a price, in percent and as an amount."""
    amount = c(mode) == "AMOUNT"
    price = F.when(amount, c(buy) + F.coalesce(F.try_divide(c(value), c(shares)), F.lit(0.0))).otherwise(c(buy) * (1 + c(value) / 100))
    return {
        "target_price": price,
        "target_pct": F.when(amount, (price - c(buy)) / c(buy) * 100).otherwise(c(value)),
        "target_amount": F.when(amount, c(value)).otherwise((price - c(buy)) * c(shares)),
    }


def breakeven_fields(buy, shares, price) -> dict[str, Column]:
    """I8: shares to buy at today's price until selling all would cost only the fees."""
    target = c(price) * (1 + ROUND_TRIP)
    valid = (c(buy) > 0) & (c(shares) > 0) & (c(price) > 0)
    none = target >= c(buy)
    n = F.when(valid, F.when(none, F.lit(0)).otherwise(F.ceil(c(shares) * (c(buy) - target) / (target - c(price)) - 1e-9))).cast("long")
    return {
        "breakeven_shares": n,
        "breakeven_avg_cost": F.when(valid, (c(shares) * c(buy) + n * c(price)) / (c(shares) + n)),
        "breakeven_cost": F.when(valid, n * c(price) * (1 + FEE)),
    }


def exit_analytics(pnl_pct, days, price, stop, peak, invested, value) -> dict[str, Column]:
    """I9."""
    growth = 1 + c(pnl_pct) / 100
    net = (c(value) - c(invested)) - (c(invested) + c(value)) * FEE
    return {
        "annualized_pct": F.when((c(days) > 0) & (growth > 0), (F.pow(growth, 365.0 / c(days)) - 1) * 100),
        "to_stop_pct": F.when(c(price) > 0, (c(price) - c(stop)) / c(price) * 100),
        "drawdown_pct": F.when(c(peak) > 0, (c(price) / c(peak) - 1) * 100),
        "net_pnl": net,
        "net_pnl_pct": F.when(c(invested) > 0, net / c(invested) * 100).otherwise(0.0),
    }


def stop_loss(price, atr) -> Column:
    """I11."""
    return F.greatest(c(price) - T.atr_stop * c(atr), F.lit(0.0001))


def take_profit(price, atr, projected_pct=None) -> Column:
    """From the analog's projection where there is one, else from the range; with fees."""
    gain = F.coalesce(c(atr) * T.profit_atr / c(price), F.lit(0.03))
    if projected_pct is not None:
        gain = F.when(c(projected_pct).isNotNull(), F.greatest(c(projected_pct), F.lit(T.profit_floor_pct)) / 100).otherwise(gain)
    return c(price) * (1 + gain + ROUND_TRIP)


def position_size(cash, price, stop_distance) -> dict[str, Column]:
    """The smaller of what the risk budget and the cash allow."""
    by_risk = F.floor(F.coalesce(F.try_divide(c(cash) * RISK_PER_TRADE, c(stop_distance)), F.lit(0.0)))
    by_cash = F.floor(c(cash) / (c(price) * (1 + FEE)))
    shares = F.greatest(F.least(by_risk, by_cash), F.lit(0)).cast("long")
    outlay = shares * c(price) * (1 + FEE)
    return {"shares": shares, "outlay": outlay, "outlay_pct": F.when(c(cash) > 0, outlay / c(cash) * 100).otherwise(0.0)}


def bucket(v, edges: list[float], labels: list[str]) -> Column:
    """The label of the first edge above the value; the last label beyond all."""
    return reduce(lambda out, x: F.when(c(v) < x[0], x[1]).otherwise(out), list(zip(edges, labels))[::-1], F.lit(labels[-1]))


#: I13, fixed labels.
ADX = ([20, 25, 35], ["adx<20 (weak trend)", "adx 20-25", "adx 25-35", "adx>=35 (strong trend)"])
RSI = ([40, 55, 65, 75], ["rsi<40", "rsi 40-55", "rsi 55-65", "rsi 65-75", "rsi>=75"])
GAP = ([-1.0, 0.0, 1.0, 3.0], ["gap<-1%", "gap -1%..0%", "gap 0%..1%", "gap 1%..3%", "gap>=3%"])


def volume_confirmation(ratio, z) -> Column:
    return (
        F.when((c(ratio) >= 2.0) | (c(z) >= 3.0), "very strong volume")
        .when((c(ratio) >= 1.5) | (c(z) >= 2.0), "strong volume")
        .when((c(ratio) >= T.vol_ratio) | (c(z) >= T.vol_z), "confirmed (minimum bar)")
        .otherwise("unconfirmed")
    )


def raw_action() -> Column:
    """The first rule that holds. Expects the columns of the scan."""
    close, pos, rsi, gap = F.col("close"), F.col("range_pos"), F.col("rsi_14"), F.col("gap_pct")
    cross, push, up = F.col("crossover"), F.col("momentum"), F.col("gap_pct") >= T.breakout_gap
    return (
        F.when((close <= F.col("sma_50") * T.sell_ratio) & (rsi <= T.sell_rsi), "SELL / AVOID")
        .when((pos >= T.strong_pos) & rsi.between(T.strong_rsi_lo, T.strong_rsi_hi) & (gap >= T.strong_gap), "STRONG BUY")
        .when(cross & push & up, "BREAKOUT BUY (X-OVER + MOMENTUM)")
        .when(cross & up, "BREAKOUT BUY (X-OVER)")
        .when(push & up, "BREAKOUT BUY (MOMENTUM)")
        .when((close < F.col("sma_50") * T.trend_ratio) & (rsi <= T.trend_rsi) & (F.col("cmf_20") <= T.trend_cmf), "SELL / AVOID (TREND)")
        .when((pos <= T.dip_pos) | (rsi <= T.dip_rsi), "BUY ON DIP")
        .when(
            (pos >= T.acc_pos) & (rsi >= T.acc_rsi) & (F.col("cmf_20") >= T.acc_cmf) & ((close >= F.col("ema_20")) | (close >= F.col("sma_50"))),
            "ACCUMULATE",
        )
        .otherwise("HOLD / NEUTRAL")
    )


def action_bonus(action: Column) -> Column:
    out = F.lit(W.hold)
    for name, bonus in (
        ("SELL / AVOID", W.sell), ("SELL / AVOID (TREND)", W.sell * 0.6), ("STRONG BUY", W.strong),
        ("BREAKOUT BUY (X-OVER + MOMENTUM)", W.crossover + W.momentum), ("BREAKOUT BUY (X-OVER)", W.crossover),
        ("BREAKOUT BUY (MOMENTUM)", W.momentum), ("BUY ON DIP", W.dip), ("ACCUMULATE", W.accumulate),
    ):
        out = F.when(action == name, F.lit(bonus)).otherwise(out)
    return out


def is_breakout(action: Column) -> Column:
    return action.startswith("BREAKOUT BUY")


def gates() -> dict[str, Column]:
    """C14: the parts of the confirmation and the reasons that are not met."""
    a = F.col("raw_action")
    strong = (F.col("adx_14") >= T.adx_min) & ((F.col("volume_ratio") >= T.vol_ratio) | (F.col("vol_z_score") >= T.vol_z))
    vwap = F.col("close") >= F.col("vwap_20") * T.vwap_ratio
    squeeze = ~is_breakout(a) | F.col("bb_kc_squeeze")
    weekly = (F.col("close") > F.col("w_sma_50")) & (F.col("w_rsi") >= 50)
    needs, dip = (a == "STRONG BUY") | is_breakout(a), a == "BUY ON DIP"
    flow = F.col("cmf_20") >= T.dip_cmf

    def unmet(*pairs):
        return F.concat_ws(", ", F.array_compact(F.array(*[F.when(cond, F.lit(text)) for cond, text in pairs])))

    return {
        "weekly_aligned": weekly,
        "confirmed": (~needs | (strong & vwap & squeeze)) & (~dip | (weekly & flow)),
        "unmet": F.when(needs, unmet((~strong, "low ADX/volume"), (~vwap, "below VWAP"), (~squeeze, "no squeeze release")))
        .when(dip, unmet((~weekly, "weekly trend not aligned"), (~flow, "CMF below accumulation floor")))
        .otherwise(""),
        "liquid": F.col("volume_avg") >= T.min_avg_volume,
    }


def trend_bonus() -> Column:
    """The action's points after gates, bonuses and penalties. Expects raw_action and ``gates``."""
    a = F.col("raw_action")
    buying = (a == "STRONG BUY") | is_breakout(a) | a.isin("ACCUMULATE", "BUY ON DIP")
    dip = a == "BUY ON DIP"
    unconfirmed = F.when(F.col("confirmed"), 1.0).otherwise(W.unconfirmed)
    extras = F.when(buying & (F.col("cmf_20") >= W.cmf_from), W.cmf_bonus).otherwise(0.0) + F.when(buying & F.col("bb_kc_squeeze"), W.squeeze).otherwise(0.0)
    # a dip's gate scales its bonuses too; the others' gate only the base
    base = F.when(dip, (action_bonus(a) + extras) * unconfirmed).otherwise(action_bonus(a) * unconfirmed + extras)
    aligned = F.col("weekly_aligned") & ((a == "STRONG BUY") | is_breakout(a) | (dip & F.col("confirmed")))
    return base + F.when(aligned, W.weekly).otherwise(0.0) + F.when(F.col("liquid"), 0.0).otherwise(W.illiquid)


def wilson(k, n, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the interval for k of n, in percent; null for n = 0."""
    p = c(k) / c(n)
    centre = p + z * z / (2 * c(n))
    spread = z * F.sqrt(p * (1 - p) / c(n) + z * z / (4 * c(n) * c(n)))
    scale = 1 + z * z / c(n)
    lo, hi = F.greatest((centre - spread) / scale, F.lit(0.0)), F.least((centre + spread) / scale, F.lit(1.0))
    return F.when(c(n) > 0, lo * 100), F.when(c(n) > 0, hi * 100)


def exit_action(n_bars, pnl_pct, price, vwap, take_profit) -> Column:
    """With too short a history a position is only held."""
    under = (c(price) < c(vwap) * T.vwap_cut) & (c(pnl_pct) < 0)
    return (
        F.when(c(n_bars) < T.min_bars, "HOLD")
        .when((c(pnl_pct) <= T.cut_loss_pct) | under, "CUT LOSS")
        .when(c(price) >= c(take_profit), "TAKE PROFIT")
        .otherwise("HOLD")
    )
