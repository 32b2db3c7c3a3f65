"""The market scan: matrix rows, sectors, watchlist."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import NO_SECTOR, T, W
from ..functions import rules as R
from ..operators import indicators as I
from ..shared import written
from ..sources.layout import stored


def with_sector(df: DataFrame, sectors: DataFrame) -> DataFrame:
    """The ticker's sector, or the default."""
    return df.join(sectors.select("ticker", "sector"), "ticker", "left").withColumn("sector", F.coalesce("sector", F.lit(NO_SECTOR)))


def universe(bars: DataFrame, days: int | None = T.scan_days) -> DataFrame:
    """A9 and F1 in front of a scan: the last ``days`` days (all for None), each ticker from its last long gap on."""
    return I.history_trim(I.scan_lookback(bars, days) if days else bars)


def scan(bars: DataFrame, adapt: bool = True) -> DataFrame:
    """Indicators, range position and signal flags of every bar, with the raw action and its gates."""
    df = I.range_position(I.indicators(bars, adapt))
    df = df.withColumns({"crossover": I.crossover(), "momentum": I.momentum()})
    df = df.withColumn("raw_action", R.raw_action())
    return df.withColumns(R.gates())


def matrix(bars: DataFrame, sectors: DataFrame, analogs: DataFrame | None = None, days: int | None = T.scan_days, adapt: bool = True) -> DataFrame:
    """K2: one scored row per ticker with enough bars (C2) in the universe."""
    df = with_sector(I.latest(scan(universe(bars, days), adapt)), sectors).where(F.col("n_bars") >= T.min_bars)
    if analogs is None:
        df = df.withColumns({"confidence": F.lit(0.0), "projected_pct": F.lit(None).cast("double")})
    else:
        df = df.join(analogs.select("ticker", "confidence", "projected_pct"), "ticker", "left").withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
    df = df.withColumns({"trend_bonus": R.trend_bonus(), "weight": R.confidence_weight("n_bars")})
    raw = F.col("confidence") * W.confidence + F.coalesce("projected_pct", F.lit(0.0)) * W.projected + F.col("range_pos") * W.range_pos + F.col("trend_bonus")
    return df.withColumns(
        {
            "score": raw * F.col("weight"),
            "breakdown": F.struct(
                (F.col("confidence") * W.confidence).alias("pattern"),
                (F.coalesce("projected_pct", F.lit(0.0)) * W.projected).alias("projected"),
                (F.col("range_pos") * W.range_pos).alias("range"),
                F.col("trend_bonus").alias("trend"),
            ),
            "stop": R.stop_loss("close", "atr_14"),
            "take_profit": R.take_profit("close", "atr_14", "projected_pct"),
            "confidence_tier": R.confidence_tier("n_bars"),
        }
    )


CATEGORIES = ("STRONG BUY", "BREAKOUT BUY", "BUY ON DIP", "ACCUMULATE")


def category(action: Column) -> Column:
    out = F.lit(None).cast("string")
    for name in CATEGORIES[::-1]:
        out = F.when(action.startswith(name), F.lit(name)).otherwise(out)
    return out


def top_per_category(rows: DataFrame, owned: DataFrame, n: int = 10) -> DataFrame:
    """The best liquid rows of each category that are not held."""
    free = rows.where("liquid").join(owned.select("ticker").distinct(), "ticker", "left_anti")
    free = free.withColumn("category", category(F.col("raw_action"))).where("category is not null")
    by = Window.partitionBy("category").orderBy(F.desc("score"), "ticker")
    return free.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= n)


def sector_analytics(rows: DataFrame) -> DataFrame:
    """One row per sector. ``rows``: latest bars with sector, ret_1, ret_5, close, volume, cmf_20, sma_50."""
    agg = rows.groupBy("sector").agg(
        F.count("*").alias("stocks"),
        F.avg("ret_1").alias("ret_1d"),
        F.avg("ret_5").alias("ret_5d"),
        F.avg("cmf_20").alias("cmf"),
        (F.avg((F.col("close") >= F.col("sma_50")).cast("int")) * 100).alias("breadth_pct"),
        F.sum(F.col("close") * F.col("volume")).alias("traded_value"),
        F.min_by("ticker", F.struct((-F.col("ret_1")).alias("r"), "ticker")).alias("leader"),
    )
    return agg.withColumn("status", sector_status())


def sector_status() -> Column:
    one, five, cmf, breadth = F.col("ret_1d"), F.col("ret_5d"), F.col("cmf"), F.col("breadth_pct")
    return (
        F.when((cmf >= 0.12) & (one >= 1.0) & (breadth >= 60), "STRONG INFLOW")
        .when(one >= 1.8, "BREAKOUT")
        .when((five >= 2.0) & (breadth >= 50), "ACCUMULATE")
        .when((one <= -1.5) & (cmf < 0), "HEAVY DISTRIBUTION")
        .otherwise("CONSOLIDATION")
    )


def sector_rows(bars: DataFrame, sectors: DataFrame) -> DataFrame:
    """Latest bars as E1 takes them: members have five bars or more; without smoothing."""
    df = bars.withColumns({"n_bars": I.n_bars(), "sma_50": I.sma(50), "prev": F.lag("close").over(I.w())})
    first = F.first("close").over(I.w().rowsBetween(-5, 0))  # five bars back, or the first bar
    df = I.money_flow(df.withColumn("c5", first))
    df = df.withColumns(
        {
            "ret_1": F.coalesce((F.col("close") - F.col("prev")) / F.col("prev") * 100, F.lit(0.0)),
            "ret_5": (F.col("close") - F.col("c5")) / F.col("c5") * 100,
        }
    )
    return with_sector(I.latest(df).where("n_bars >= 5"), sectors)


def sector_avg_5d(rows: DataFrame) -> DataFrame:
    """Mean five-bar return of the tickers with six bars or more."""
    return rows.where("n_bars >= 6").groupBy("sector").agg(F.avg("ret_5").alias("avg_5d"))


def sector_index_return(rows: DataFrame, sector_index: DataFrame, index_of: DataFrame) -> DataFrame:
    """Five-bar return of the index of each row's sector; null without one. ``index_of``: sector, index_ticker."""
    ret = I.latest(sector_index.withColumn("index_5d", I.n_bar_return(5))).select(F.col("ticker").alias("index_ticker"), "index_5d")
    return rows.join(index_of, "sector", "left").join(ret, "index_ticker", "left")


def watchlist(bars: DataFrame, sectors: DataFrame, zones: DataFrame, index_returns: DataFrame, regime: str = "unknown", analogs: DataFrame | None = None, days: int | None = T.scan_days, adapt: bool = True) -> DataFrame:
    """K3: additive pre-breakout score of the tickers that have not fired yet; floor 35.

    ``zones``: ticker, resistance. ``index_returns``: sector, index_5d. ``days`` 0: ``bars`` are a universe already.
    """
    df = I.with_up_down_volume(I.volume_build(scan(bars if days == 0 else universe(bars, days), adapt)))
    df = df.withColumns({"adx_rising": I.adx_rising(), "ret_5": F.coalesce(I.n_bar_return(5), F.lit(0.0)), "high_10": F.max("high").over(I.last(10))})
    # three parts need the last bars of this: it is made once
    df = df.withColumn("_back", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date")))).where(F.col("_back") <= 60).drop("_back")
    df = stored(df, "watched")
    now = with_sector(I.latest(df), sectors).where(F.col("liquid") & (F.col("n_bars") >= 20))
    members = with_sector(I.latest(df), sectors).where("n_bars >= 6")
    mean = members.groupBy("sector").agg(F.avg("ret_5").alias("sector_5d"))
    now = now.join(mean, "sector", "left").join(index_returns.select("sector", "index_5d"), "sector", "left")
    now = now.join(I.atr_percentile(df), "ticker", "left").join(zones.select("ticker", "resistance"), "ticker", "left")
    now = now.withColumn("resistance", F.coalesce("resistance", "range_high"))
    if analogs is None:
        now = now.withColumns({"confidence": F.lit(0.0), "projected_pct": F.lit(0.0)})
    else:
        now = now.join(analogs.select("ticker", "confidence", "projected_pct"), "ticker", "left")
    g = R.graduated
    failed = (F.col("high_10") >= F.col("resistance") * 0.98) & (F.col("close") <= F.col("resistance") * 0.95)
    adx = g("adx_14", 8, 15, 25, 34, 20)
    points = {
        "squeeze": F.when(F.col("bb_kc_squeeze"), 25.0).otherwise(0.0),
        "adx": F.when(F.col("adx_rising"), adx).otherwise(adx * 0.4),
        "rsi": g("rsi_14", 42, 50, 65, 73, 15),
        "volume": g("volume_build", 0.9, 1.25, 10, 10, 15),
        "range": g("range_pos", 62, 87, 100, 100, 15),
        "flow": F.when(F.col("cmf_20") > 0, 10.0).otherwise(0.0),
        "weekly": F.when(F.col("weekly_aligned"), 10.0).otherwise(0.0),
        "sector": g(F.col("ret_5") - F.coalesce("sector_5d", F.lit(0.0)), 0, 6, 999, 999, 12),
        "index": g(F.col("ret_5") - F.col("index_5d"), 0, 5, 999, 999, 10),
        "analog": F.when(F.col("projected_pct") > 0, F.least(F.lit(12.0), F.col("confidence") * 0.12)).otherwise(0.0),
        "failed": F.when(failed, -15.0).otherwise(0.0),
        "dry_up": g("dry_up", -1, -1, 0.75, 0.95, 12),
        "contraction": g("atr_percentile", -1, -1, 40, 65, 10),
        "up_down": g("up_down_volume", 0.9, 1.3, 999, 999, 10),
        "regime": F.lit({"bull": 3.0, "bear": -6.0}.get(regime, 0.0)),
    }
    now = now.withColumn("points", F.struct(*[v.alias(k) for k, v in points.items()]))
    total = sum((F.col(f"points.{k}") for k in points), F.lit(0.0))
    a = F.col("raw_action")
    fired = (a == "STRONG BUY") | R.is_breakout(a) | a.startswith("SELL")
    now = now.withColumn("breakout_score", F.greatest(total, F.lit(0.0))).where(~fired & (F.col("breakout_score") >= 35))
    score = F.col("breakout_score")
    distance = F.greatest((F.col("resistance") - F.col("close")) / F.col("close") * 100, F.lit(0.0))
    return now.withColumns({"tier": F.when(score < 65, "Watching").when(score >= 78, "High Confidence").otherwise("Confirmed"), "dist_to_resistance_pct": distance})


def watchlist_tiers(rows: DataFrame, top: int = 25, fallback: int = 10) -> DataFrame:
    """The best confirmed rows, then the best of the rest."""
    group = F.when(F.col("breakout_score") >= 65, 0).otherwise(1)
    ranked = rows.withColumn("tier_group", group).withColumn(
        "rank", F.row_number().over(Window.partitionBy("tier_group").orderBy(F.desc("breakout_score"), "ticker"))
    )
    return ranked.where(((F.col("tier_group") == 0) & (F.col("rank") <= top)) | ((F.col("tier_group") == 1) & (F.col("rank") <= fallback)))


def market_overview(rows: DataFrame) -> DataFrame:
    """E3. ``rows``: ticker, ret_1, ret_5."""
    return rows.agg(
        F.avg("ret_1").alias("avg_1d"),
        F.avg("ret_5").alias("avg_5d"),
        F.count_if(F.col("ret_1") > 0).alias("advancers"),
        F.count_if(F.col("ret_1") < 0).alias("decliners"),
        F.count_if(F.col("ret_1") == 0).alias("unchanged"),
        F.min_by("ticker", F.struct((-F.col("ret_1")).alias("r"), "ticker")).alias("top_gainer"),
        F.min_by("ticker", F.struct("ret_1", "ticker")).alias("top_loser"),
    )


def weekly_overview(rows: DataFrame, n: int = 3) -> DataFrame:
    """The n best and worst five-bar returns."""
    top = rows.orderBy(F.desc("ret_5"), "ticker").limit(n).withColumn("side", F.lit("top"))
    low = rows.orderBy("ret_5", "ticker").limit(n).withColumn("side", F.lit("bottom"))
    return top.unionByName(low).select("side", "ticker", "ret_5")


def weekly_report(rows: DataFrame, summary: DataFrame, regimes: DataFrame, n: int = 3) -> DataFrame:
    """E4 in full: the week's best and worst tickers (of six bars or more) and sectors, and each index with its regime.

    ``rows``: ticker, ret_5, n_bars. ``summary``: sector, ret_5d. ``regimes``: ticker, regime, one row an index.
    """
    none = F.lit(None).cast("string").alias("state")
    movers = weekly_overview(rows.where("n_bars >= 6"), n).select(F.col("side").alias("kind"), F.col("ticker").alias("name"), F.col("ret_5").alias("pct"), none)
    ends = summary.where("ret_5d is not null").agg(F.min(F.struct((-F.col("ret_5d")).alias("r"), "sector")).alias("best"), F.min(F.struct("ret_5d", "sector")).alias("worst"))
    pair = lambda kind, pct: F.struct(F.lit(kind).alias("kind"), F.col(f"{kind.split('_')[0]}.sector").alias("name"), pct.alias("pct"), none)
    sectors = ends.select(F.inline(F.array(pair("best_sector", -F.col("best.r")), pair("worst_sector", F.col("worst.ret_5d"))))).where("name is not null")
    index = regimes.select(F.lit("index").alias("kind"), F.col("ticker").alias("name"), F.lit(None).cast("double").alias("pct"), F.col("regime").alias("state"))
    return movers.unionByName(sectors).unionByName(index)


def biggest_movers(rows: DataFrame, n: int = 30) -> DataFrame:
    """By the size of the one-bar move; equal moves by ticker, descending."""
    return rows.orderBy(F.desc(F.abs("ret_1")), F.desc("ticker")).limit(n).select("ticker", "ret_1")


def sector_highlights(summary: DataFrame, n: int = 5) -> DataFrame:
    """G4."""
    return summary.orderBy(F.desc("ret_1d"), "sector").limit(n)


def rotation_flags(rows: DataFrame, owned: DataFrame, n: int = 10) -> DataFrame:
    """Held rows for which the best row of the category that is not held scores higher."""
    rows = rows.withColumn("category", category(F.col("raw_action"))).where("category is not null")
    rows = written(rows.select("ticker", "category", "score"), "rotation")  # the scan is made once
    held = rows.join(owned.select("ticker").distinct(), "ticker", "left_semi").select("category", F.col("ticker").alias("held"), F.col("score").alias("held_score"))
    free = rows.join(owned.select("ticker").distinct(), "ticker", "left_anti")
    best = free.withColumn("r", F.row_number().over(Window.partitionBy("category").orderBy(F.desc("score"), "ticker"))).where("r = 1")
    best = best.select("category", F.col("ticker").alias("candidate"), F.col("score").alias("candidate_score"))
    both = held.join(best, "category").where("candidate_score > held_score")
    return both.withColumn("difference", F.col("candidate_score") - F.col("held_score")).orderBy(F.desc("difference"), "held").limit(n)


def sector_index(bars: DataFrame, sectors: DataFrame) -> DataFrame:
    """F37 over D21: members rebased to 100, carried over the union of the sector's dates, then averaged.

    A member stands at 100 before its first bar and at its last value on a date
    without one, so the sector's sum moves by its members' own changes alone:
    no grid of dates and members is laid out.
    """
    rebased = F.col("close") / F.first("close").over(I.w()) * 100
    own = bars.select("ticker", "date", rebased.alias("v"))
    own = own.withColumns({"change": F.col("v") - F.coalesce(F.lag("v").over(I.w()), F.lit(100.0)), "first": (F.row_number().over(I.w()) == 1).cast("int")})
    days = with_sector(own, sectors).groupBy("sector", "date").agg(F.sum("change").alias("change"), F.sum("first").alias("first"))
    sector = Window.partitionBy("sector")
    return days.select("sector", "date", (100 + F.sum("change").over(sector.orderBy("date")) / F.sum("first").over(sector)).alias("index"))


# --- filters ---------------------------------------------------------------------------------


def without_benchmarks(df: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """C1."""
    return df.join(benchmarks.select("ticker").distinct(), "ticker", "left_anti")


def _every(conditions: list[Column]) -> Column:
    return reduce(lambda x, y: x & y, conditions, F.lit(True))


def recommended(actions=None, sectors=None, min_score: float | None = None) -> Column:
    """C4, as a condition; a row without a score fails ``min_score``."""
    parts = [F.col("raw_action").isin(list(actions))] if actions else []
    parts += [F.col("sector").isin(list(sectors))] if sectors else []
    parts += [F.coalesce(F.col("score") >= min_score, F.lit(False))] if min_score is not None else []
    return _every(parts)


def filter_recommendations(rows: DataFrame, **conditions) -> DataFrame:
    """C4."""
    return rows.where(recommended(**conditions))


def presets() -> dict[str, Column]:
    """Named screens."""
    a = F.col("raw_action")
    pushing = (a == "STRONG BUY") | R.is_breakout(a)
    return {
        "strong_momentum": pushing & (F.col("adx_14") >= 20),
        "low_vol_accumulate": (a == "ACCUMULATE") & (F.col("adx_14") < 20) & (F.abs("vol_z_score") < 1),
        "oversold_dip": (a == "BUY ON DIP") & (F.coalesce("rsi_14", F.lit(100.0)) <= 38),
        "high_confidence": F.col("confidence_tier").contains("High") & (pushing | a.isin("ACCUMULATE", "BUY ON DIP")),
        "pattern_confirmed": F.col("confidence") >= 60,
    }


def ad_hoc(ticker: str = "", action: str = "", trend: str = "", tier: str = "", hide_illiquid=False, hide_unconfirmed=False, preset: str = "") -> Column:
    """C6, as a condition: all given ones hold."""
    parts = [F.upper("ticker").contains(ticker.upper())] if ticker else []
    parts += [F.upper("raw_action").contains(action.upper())] if action else []
    parts += [F.col("trend_class") == trend] if trend else []
    parts += [F.col("confidence_tier") == tier] if tier else []
    parts += [F.col("liquid")] if hide_illiquid else []
    parts += [F.col("confirmed")] if hide_unconfirmed else []
    parts += [presets()[preset]] if preset else []
    return _every(parts)


def ad_hoc_screen(rows: DataFrame, **conditions) -> DataFrame:
    """C6."""
    return rows.where(ad_hoc(**conditions))


def screens(rows: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """Every named screen's tickers in one pass over the rows."""
    names = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in conditions.items()]))
    return rows.select(F.explode(names).alias("screen"), "ticker")


def action_listing(rows: DataFrame, action: str, n: int = 10) -> DataFrame:
    """The best n rows of an action, with the number of rows left out."""
    own = written(rows.where(F.col("raw_action").contains(action)), "listing")  # the scan is made once
    total = own.agg(F.count("*").alias("_n"))
    best = own.orderBy(F.desc("score"), "ticker").limit(n)
    return best.join(F.broadcast(total)).withColumn("remaining", F.greatest(F.col("_n") - n, F.lit(0))).drop("_n")


def prefix_screen(bars: DataFrame, prefix: str) -> DataFrame:
    """Tickers that start with a letter, or (``#``) with none."""
    t = F.col("ticker")
    return bars.where(t.rlike("^[^A-Za-z]") if prefix == "#" else F.upper(t).startswith(prefix.upper())).select("ticker").distinct()


def text_search(df: DataFrame, query: str, *cols: str) -> DataFrame:
    """Case-insensitive substring over several columns; an empty query keeps all."""
    return df.where(F.lower(F.concat_ws(" ", *cols)).contains(query.strip().lower())) if query.strip() else df
