"""Aggregates over trades, positions and coverage.

``trades``: ticker, fold, action, entry_date, exit_date, exit_reason, return_pct,
sector, adx, rsi, gap_pct, volume_confirmation, entry_regime, excess_return_pct
and the bucket columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..shared import shared_dir


def with_benchmark(trades: DataFrame, index: DataFrame) -> DataFrame:
    """The index's move between entry and exit, the excess over it, and the regime on entry.

    ``index``: date, close, regime. One row a day, so it is small next to trades.
    """
    a = index.select(F.col("date").alias("entry_date"), F.col("close").alias("_in"), F.col("regime").alias("entry_regime"))
    b = index.select(F.col("date").alias("exit_date"), F.col("close").alias("_out"))
    out = trades.join(a, "entry_date", "left").join(b, "exit_date", "left")
    move = F.when(F.col("_in") > 0, (F.col("_out") / F.col("_in") - 1) * 100)
    out = out.withColumn("benchmark_return_pct", F.bround(move, 3))
    return out.withColumns(
        {"excess_return_pct": F.col("return_pct") - F.col("benchmark_return_pct"), "entry_regime": F.coalesce("entry_regime", F.lit("unknown"))}
    ).drop("_in", "_out")


def with_buckets(trades: DataFrame) -> DataFrame:
    """I13."""
    return trades.withColumns(
        {
            "adx_bucket": R.bucket("adx", *R.ADX),
            "rsi_bucket": R.bucket("rsi", *R.RSI),
            "gap_bucket": R.bucket("gap_pct", *R.GAP),
            "volume_confirmation": R.volume_confirmation("vol_ratio", "vol_z"),
        }
    )


#: M2: a factor's name and its key.
FACTORS: dict[str, str] = {
    "action": "action", "regime": "entry_regime", "adx": "adx_bucket", "rsi": "rsi_bucket",
    "gap": "gap_bucket", "volume": "volume_confirmation", "sector": "sector", "exit_reason": "exit_reason",
}


def _bucket_aggs() -> list[Column]:
    return [
        F.count("*").alias("trade_count"),
        F.count_if(F.col("return_pct") > 0).alias("wins"),
        F.avg("return_pct").alias("avg_return_pct"),
        F.avg("excess_return_pct").alias("avg_excess_pct"),
        F.count("excess_return_pct").alias("covered"),
    ]


def _bucket_finish(df: DataFrame, reliable: int) -> DataFrame:
    lo, hi = R.wilson("wins", "trade_count")
    return df.withColumns(
        {
            "win_rate_pct": F.col("wins") / F.col("trade_count") * 100,
            "ci_low": lo,
            "ci_high": hi,
            "coverage": F.concat_ws("/", "covered", "trade_count"),
            "reliable": F.col("trade_count") >= reliable,
        }
    )


def bucket_stats(trades: DataFrame, key: str | Column, reliable: int = 30) -> DataFrame:
    """E9."""
    key = F.col(key) if isinstance(key, str) else key
    return _bucket_finish(trades.groupBy(key.alias("bucket")).agg(*_bucket_aggs()), reliable)


def factor_report(trades: DataFrame, factors: dict[str, str] = FACTORS, reliable: int = 30) -> DataFrame:
    """E9 for every factor in one pass, by grouping sets."""
    cols = list(factors.values())
    grouped = trades.groupingSets([[F.col(c)] for c in cols], *[F.col(c) for c in cols]).agg(*_bucket_aggs(), *[F.grouping(c).alias(f"_g_{c}") for c in cols])
    name = F.coalesce(*[F.when(F.col(f"_g_{c}") == 0, F.lit(k)) for k, c in factors.items()])
    bucket = F.coalesce(*[F.when(F.col(f"_g_{c}") == 0, F.col(c)) for c in cols])
    out = grouped.select(name.alias("factor"), bucket.alias("bucket"), "trade_count", "wins", "avg_return_pct", "avg_excess_pct", "covered")
    return _bucket_finish(out, reliable)


def benchmark_summary(trades: DataFrame) -> DataFrame:
    """E11."""
    return trades.agg(
        F.avg("excess_return_pct").alias("avg_excess_pct"),
        (F.count_if(F.col("excess_return_pct") > 0) / F.count("excess_return_pct") * 100).alias("beat_pct"),
        F.count("excess_return_pct").alias("covered"),
        F.count("*").alias("trades"),
    )


def action_breakdown(trades: DataFrame) -> DataFrame:
    """E12."""
    return trades.groupBy("action").agg(
        F.count("*").alias("trade_count"), (F.count_if(F.col("return_pct") > 0) / F.count("*") * 100).alias("win_rate_pct"), F.avg("return_pct").alias("avg_return_pct")
    )


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """The rows in ranges of ``order``, numbered in ``_p``; written once, so that the ranges stay."""
    path = shared_dir(rows.sparkSession, "ranges")
    out = rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id())
    out.write.parquet(path)
    return rows.sparkSession.read.schema(out.schema).parquet(path)


def before(rows: DataFrame, **aggs: tuple[Column, object]) -> DataFrame:
    """Joins to ``placed`` rows an aggregate over all ranges before their own: name=(aggregate, how to combine). One row a range is ordered."""
    w = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    each = rows.groupBy("_p").agg(*[a.alias(k) for k, (a, _) in aggs.items()])
    return rows.join(F.broadcast(each.select("_p", *[f(k).over(w).alias(k) for k, (_, f) in aggs.items()])), "_p")


def equity(trades: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """H2: place (``seq``), running equity, its peak and the drawdown, in the given order.

    Total losses (a return of -100 % or less) end at an equity of zero, whose
    ``log_equity`` is null. Without groups the trades are taken in ranges of the order.
    """
    r = F.col("return_pct") / 100
    log = F.when(r > -1, F.log1p(r))
    if by:
        out = trades.withColumns({"_n0": F.lit(0), "_s0": F.lit(None).cast("double"), "_m0": F.lit(None).cast("double")})
    else:
        out = before(placed(trades, order), _n0=(F.count("*"), F.sum), _s0=(F.sum(log), F.sum), _m0=(F.min(r), F.min))
    w = Window.partitionBy(*by or ["_p"]).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    s0, own = F.col("_s0"), F.sum(log).over(w)
    log_sum, lost = F.coalesce(s0 + own, s0, own), F.least("_m0", F.min(r).over(w)) <= -1
    out = out.withColumns(
        {
            "seq": F.row_number().over(w) - 1 + F.coalesce("_n0", F.lit(0)),
            "log_equity": F.when(~lost, log_sum), "equity": F.exp(log_sum) * F.when(lost, 0.0).otherwise(1.0),
        }
    ).drop("_n0", "_s0", "_m0")
    if by:
        out = out.withColumn("peak", F.max("equity").over(w))
    else:
        out = before(out, _e0=(F.max("equity"), F.max)).withColumn("peak", F.greatest("_e0", F.max("equity").over(w))).drop("_e0", "_p")
    return out.withColumn("drawdown", F.when(F.col("peak") > 0, (F.col("equity") - F.col("peak")) / F.col("peak")).otherwise(0.0))


def perf_metrics(trades: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Per group (none: over all) mean, deviation, Sharpe, Sortino and the largest drawdown."""
    df = equity(trades, by, order)
    r = F.col("return_pct") / 100
    out = df.groupBy(*by).agg(
        F.count("*").alias("trade_count"),
        (F.count_if(r > 0) / F.count("*") * 100).alias("win_rate_pct"),
        F.avg(r).alias("mean"),
        F.stddev_pop(r).alias("vol"),
        F.stddev_pop(F.when(r < 0, r)).alias("_down"),
        F.min("drawdown").alias("max_drawdown"),
        F.sum(F.when(r > 0, r).otherwise(0.0)).alias("gross_profit"),
        F.sum(F.when(r <= 0, -r).otherwise(0.0)).alias("gross_loss"),
    )
    return out.withColumns(
        {
            "sharpe": F.when(F.col("vol") > 1e-9, F.col("mean") / F.col("vol")).otherwise(0.0),
            "sortino": F.when(F.col("_down") > 1e-9, F.col("mean") / F.col("_down")).otherwise(0.0),
        }
    ).drop("_down")


def overall(trades: DataFrame, order: list[str], min_folds: int = 4) -> DataFrame:
    """Profit factor (null without a loss) and whether enough folds traded."""
    folds = trades.agg(F.count_distinct("fold").alias("fold_count"))
    out = perf_metrics(trades, [], order).join(F.broadcast(folds))
    return out.withColumns(
        {"profit_factor": F.when(F.col("gross_loss") > 1e-9, F.col("gross_profit") / F.col("gross_loss")), "is_reliable": F.col("fold_count") >= min_folds}
    )


def equity_curve(daily: DataFrame, points: int = 200) -> DataFrame:
    """At most ``points`` rows by stride, with the last. ``daily``: seq (0 to n - 1) and values."""
    n = daily.agg(F.count("*").alias("_n"))
    stride = F.greatest(F.col("_n") / points, F.lit(1.0))
    first = F.floor(F.ceil(F.col("seq") / stride - 1e-9) * stride + 1e-9) == F.col("seq")
    return daily.join(F.broadcast(n)).where(first | (F.col("seq") == F.col("_n") - 1)).drop("_n")


def score_quintiles(rows: DataFrame, n: int = 5) -> DataFrame:
    """By score, chunks of ceil(rows / n). ``rows``: ticker, session_date, score, hit, best_gain_pct."""
    total = rows.agg(F.count("*").alias("_n"))
    order = ["score", "ticker", "session_date"]
    own = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    ranked = before(placed(rows, order), _n0=(F.count("*"), F.sum)).join(F.broadcast(total)).withColumn("_r", own - 1 + F.coalesce("_n0", F.lit(0)))
    chunk = F.floor(F.col("_r") / F.ceil(F.col("_n") / n)) + 1
    return ranked.groupBy(chunk.cast("int").alias("quintile")).agg(
        F.min("score").alias("low"), F.max("score").alias("high"), F.count("*").alias("n"),
        (F.avg(F.col("hit").cast("int")) * 100).alias("hit_pct"), F.avg("best_gain_pct").alias("avg_best_gain_pct"),
    )


def forward_window(bars: DataFrame, snapshots: DataFrame, target_pct: float = 3.0, lo: int = 1, hi: int = 3) -> DataFrame:
    """The best close of the next bars after a snapshot that falls on a bar."""
    w = Window.partitionBy("ticker").orderBy("date")
    ahead = w.rowsBetween(1, hi)
    df = bars.select("ticker", F.col("date").alias("session_date"), "close", F.max("close").over(ahead).alias("_best"), F.count("close").over(ahead).alias("_n"))
    out = snapshots.join(df, ["ticker", "session_date"]).where(F.col("_n") >= lo)
    out = out.withColumn("best_gain_pct", (F.col("_best") / F.col("close") - 1) * 100)
    return out.withColumn("hit", F.col("best_gain_pct") >= target_pct).drop("_best", "_n", "close")


# --- positions -------------------------------------------------------------------------------


def leaderboard(picks: DataFrame, n: int = 10) -> DataFrame:
    """Achieved picks by ticker."""
    done = picks.where("status = 'achieved'").groupBy("ticker").agg(
        F.count("*").alias("hits"), F.sum("achieved_pct").alias("total_return_pct"), F.avg("achieved_pct").alias("avg_return_pct"), F.max("achieved_date").alias("last_achieved_date")
    )
    return done.orderBy(F.desc("hits"), F.desc("total_return_pct"), "ticker").limit(n)


def open_positions(ledger: DataFrame) -> DataFrame:
    """Net shares and the average price of the buys, where shares are left. ``ledger``: ticker, side, price, shares."""
    buy = F.col("side") == "BUY"
    return ledger.groupBy("ticker").agg(
        F.sum(F.when(buy, F.col("shares")).otherwise(-F.col("shares"))).alias("net_shares"),
        F.try_divide(F.sum(F.when(buy, F.col("price") * F.col("shares"))), F.sum(F.when(buy, F.col("shares")))).alias("avg_buy_price"),
    ).where("net_shares > 0")


def ledger_cash(start: float, owned: DataFrame, closed: DataFrame) -> DataFrame:
    """E16."""
    a = owned.agg(F.coalesce(F.sum(F.col("buy_price") * F.col("shares")), F.lit(0.0)).alias("open_cost"))
    b = closed.agg(
        F.coalesce(F.sum(F.col("buy_price") * F.col("shares")), F.lit(0.0)).alias("closed_cost"),
        F.coalesce(F.sum(F.col("sell_price") * F.col("shares")), F.lit(0.0)).alias("proceeds"),
    )
    return a.join(b).select((F.lit(start) - F.col("open_cost") - F.col("closed_cost") + F.col("proceeds")).alias("cash"))


def realised(closed: DataFrame) -> DataFrame:
    """E18."""
    return closed.withColumns(
        {"realized_pnl": (F.col("sell_price") - F.col("buy_price")) * F.col("shares"), "pnl_pct": F.when(F.col("buy_price") > 0, (F.col("sell_price") / F.col("buy_price") - 1) * 100)}
    )


def exposure(positions: DataFrame, equity_value: Column, sector_limit: float = 35.0, position_limit: float = 25.0) -> DataFrame:
    """Value and share of equity by sector, with warnings. ``positions``: ticker, sector, value."""
    total = positions.agg(equity_value.alias("equity"), F.count("*").alias("held"))
    out = positions.groupBy("sector").agg(F.sum("value").alias("value"), F.max("value").alias("largest")).join(F.broadcast(total))
    out = out.withColumns({"sector_pct": F.col("value") / F.col("equity") * 100, "largest_pct": F.col("largest") / F.col("equity") * 100})
    many = F.col("held") >= 2
    return out.withColumns({"sector_warning": many & (F.col("sector_pct") >= sector_limit), "position_warning": many & (F.col("largest_pct") >= position_limit)})


def risk_allocations(positions: DataFrame, cash: float, unit_pct: float = 1.0, low_cash_pct: float = 5.0, sector_limit: float = 35.0, position_limit: float = 25.0) -> DataFrame:
    """E19 in full: value and share of equity by sector, by ticker and of the cash. ``positions``: ticker, sector, value.

    ``risk_multiple``: a position's share over that of a normal one. ``warning``: the largest sector or position at its
    limit, of two positions or more; too little cash.
    """
    pair = lambda kind, name: F.struct(F.lit(kind).alias("kind"), F.col(name).alias("name"), "value")
    sums = positions.select(F.explode(F.array(pair("sector", "sector"), pair("position", "ticker"))).alias("x")).groupBy("x.kind", "x.name").agg(F.sum("x.value").alias("value"))
    account = positions.agg((F.coalesce(F.sum("value"), F.lit(0.0)) + cash).alias("equity"), F.count_distinct("ticker").alias("held"))
    top = sums.groupBy("kind").agg(F.min_by("name", F.struct((-F.col("value")).alias("v"), "name")).alias("top"))
    share = F.when(F.col("equity") > 0, F.col("value") / F.col("equity") * 100)
    rows = sums.join(F.broadcast(top), "kind").join(F.broadcast(account)).withColumn("pct_of_equity", share)
    limit = F.when(F.col("kind") == "sector", sector_limit).otherwise(position_limit)
    rows = rows.select(
        "kind", "name", "value", "pct_of_equity", F.when(F.col("kind") == "position", F.col("pct_of_equity") / unit_pct).alias("risk_multiple"),
        F.coalesce((F.col("held") >= 2) & F.col("name").eqNullSafe(F.col("top")) & (F.col("pct_of_equity") >= limit), F.lit(False)).alias("warning"),
    )
    drag = F.when(F.col("equity") > 0, F.lit(cash) / F.col("equity") * 100).otherwise(0.0)
    spare = account.select(F.lit("cash").alias("kind"), F.lit("cash").alias("name"), F.lit(cash).alias("value"), drag.alias("pct_of_equity"), F.lit(None).cast("double").alias("risk_multiple"), (drag < low_cash_pct).alias("warning"))
    return rows.unionByName(spare)


def account_total(positions: DataFrame, closed: DataFrame) -> DataFrame:
    """E22, the account's row: shares, cost, value, gain, breadth, best and worst position with their share of all gains and
    losses, who drives half of them (losses first), and the realised trades. ``positions``: ticker, shares, cost, value, days_held."""
    rows = positions.withColumn("pnl", F.col("value") - F.col("cost"))
    pnl = F.col("pnl")
    a = rows.agg(
        F.count("*").alias("positions"), F.sum("shares").alias("shares"), F.sum("cost").alias("cost"), F.sum("value").alias("value"), F.sum("pnl").alias("pnl"), F.avg("days_held").alias("avg_days"),
        F.count_if(pnl > 0).alias("winners"), F.count_if(pnl < 0).alias("losers"), F.count_if(pnl == 0).alias("flat"),
        F.min(F.struct((-pnl).alias("p"), "ticker")).alias("_best"), F.min(F.struct("pnl", "ticker")).alias("_worst"),
        F.sum(F.when(pnl > 0, pnl)).alias("_gains"), F.sum(F.when(pnl < 0, -pnl)).alias("_losses"),
    )
    loss, gain = F.try_divide(F.greatest(-F.col("_worst.pnl"), F.lit(0.0)), F.col("_losses")) * 100, F.try_divide(F.greatest(-F.col("_best.p"), F.lit(0.0)), F.col("_gains")) * 100
    driver = F.when(loss >= 50, F.concat(F.col("_worst.ticker"), F.lit(" drives losses"))).when(gain >= 50, F.concat(F.col("_best.ticker"), F.lit(" drives gains")))
    done = realised(closed).agg(F.coalesce(F.sum("realized_pnl"), F.lit(0.0)).alias("realised"))
    out = a.withColumns({"pnl_pct": F.when(F.col("cost") > 0, pnl / F.col("cost") * 100), "best": F.col("_best.ticker"), "worst": F.col("_worst.ticker"), "loss_share": loss, "gain_share": gain, "driver": driver})
    return out.drop("_best", "_worst", "_gains", "_losses").join(F.broadcast(done)).withColumn("total_pnl", F.coalesce(pnl, F.lit(0.0)) + F.col("realised"))


def statement(positions: DataFrame, closed: DataFrame, cash: float) -> DataFrame:
    """E20. ``positions``: cost, value."""
    a = positions.agg(F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"), F.coalesce(F.sum("value"), F.lit(0.0)).alias("value"))
    b = realised(closed).agg(F.coalesce(F.sum("realized_pnl"), F.lit(0.0)).alias("realised"))
    return a.join(b).select(
        F.lit(cash).alias("cash"), "cost", "value", (F.col("value") - F.col("cost")).alias("unrealised"), "realised", (F.lit(cash) + F.col("value")).alias("equity")
    )


def ledger_summary(closed: DataFrame) -> DataFrame:
    """E21."""
    pnl = F.col("realized_pnl")
    out = realised(closed).agg(
        F.count("*").alias("trades"), F.count_if(pnl > 0).alias("wins"), F.sum(F.when(pnl > 0, pnl).otherwise(0.0)).alias("gross_gain"),
        F.sum(F.when(pnl < 0, -pnl).otherwise(0.0)).alias("gross_loss"), F.sum(pnl).alias("net"),
    )
    return out.withColumns(
        {"win_pct": F.when(F.col("trades") > 0, F.col("wins") / F.col("trades") * 100), "profit_factor": F.when(F.col("gross_loss") > 0, F.col("gross_gain") / F.col("gross_loss"))}
    )


def position_rollup(positions: DataFrame) -> DataFrame:
    """Sector subtotals and the grand total (sector null). ``positions``: ticker, sector, cost, value, days_held."""
    pnl = positions.withColumn("pnl", F.col("value") - F.col("cost"))
    out = pnl.rollup("sector").agg(
        F.count("*").alias("positions"), F.sum("cost").alias("cost"), F.sum("value").alias("value"), F.sum("pnl").alias("pnl"), F.avg("days_held").alias("avg_days"),
        F.count_if(F.col("pnl") > 0).alias("winners"), F.count_if(F.col("pnl") < 0).alias("losers"), F.count_if(F.col("pnl") == 0).alias("flat"),
        F.min_by("ticker", F.struct((-F.col("pnl")).alias("p"), "ticker")).alias("best"), F.min_by("ticker", F.struct("pnl", "ticker")).alias("worst"),
        F.sum(F.when(F.col("pnl") < 0, -F.col("pnl")).otherwise(0.0)).alias("losses"), F.grouping("sector").alias("_g"),
    )
    total = F.max(F.when(F.col("_g") == 1, F.col("losses"))).over(Window.partitionBy(F.lit(1)))
    return out.withColumn("loss_share_high", F.coalesce(F.try_divide(F.col("losses"), total) >= 0.5, F.lit(False))).drop("losses", "_g")


def dealing_stats(ledger: DataFrame, positions: DataFrame) -> DataFrame:
    """E23."""
    a = ledger.agg(F.count("*").alias("deals"), F.sum(F.col("price") * F.col("shares")).alias("turnover"))
    return a.join(positions.agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("portfolio_value")))


def action_counts(rows: DataFrame) -> DataFrame:
    """E36."""
    a = F.col("action")
    return rows.groupBy(F.when(a.isin("HOLD", "TAKE PROFIT", "CUT LOSS"), a).otherwise("OTHER").alias("action")).count()


# --- coverage --------------------------------------------------------------------------------


def bar_coverage(bars: DataFrame) -> DataFrame:
    """E25, per ticker."""
    return bars.groupBy("ticker").agg(F.count("*").alias("bars"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def coverage_summary(coverage: DataFrame, floors: tuple[int, int] = (310, 490)) -> DataFrame:
    """Spread of the bar counts, tickers above the floors, the upper median and what it lacks."""
    ranked = coverage.withColumn("_r", F.row_number().over(Window.orderBy("bars", "ticker")) - 1).join(F.broadcast(coverage.agg(F.count("*").alias("_n"))))
    upper = F.max(F.when(F.col("_r") == F.floor(F.col("_n") / 2), F.col("bars")))
    return ranked.agg(
        F.count("*").alias("tickers"), F.min("bars").alias("min_bars"), F.median("bars").alias("median_bars"), F.max("bars").alias("max_bars"), upper.alias("upper_median"),
        *[F.count_if(F.col("bars") >= f).alias(f"at_least_{f}") for f in floors], F.greatest(F.lit(floors[0]) - upper, F.lit(0)).alias("shortfall"),
    )


def coverage_extremes(coverage: DataFrame, n: int = 10) -> DataFrame:
    """The n tickers with the fewest and the n with the most bars; equal counts by ticker."""
    worst = coverage.orderBy("bars", "ticker").limit(n).withColumn("side", F.lit("worst"))
    best = coverage.orderBy(F.desc("bars"), "ticker").limit(n).withColumn("side", F.lit("best"))
    return worst.unionByName(best)


def coverage_diagnosis(coverage: DataFrame, trades: DataFrame, floor: int = 310) -> DataFrame:
    """Tickers by what became of them."""
    traded = trades.select("ticker").distinct().withColumn("_t", F.lit(True))
    label = F.when(F.col("bars") < floor, "too short").when(F.col("_t").isNull(), "empty").otherwise("ok")
    return coverage.join(traded, "ticker", "left").groupBy(label.alias("outcome")).count()


def usage_sessions(sessions: DataFrame) -> DataFrame:
    """Sessions per user. ``sessions``: uid, email, source, start, last_seen."""
    who = F.coalesce("uid", "email", F.lit("unknown"))
    seconds = F.greatest(F.unix_timestamp("last_seen") - F.unix_timestamp("start"), F.lit(0))
    return sessions.withColumns({"user": who, "seconds": seconds}).groupBy("user").agg(
        F.count("*").alias("sessions"), F.sum("seconds").alias("total_seconds"), F.avg("seconds").alias("avg_seconds"),
        F.count_if(F.col("source") == "web").alias("web"), F.count_if(F.col("source") == "desktop").alias("desktop"), F.max("last_seen").alias("last_seen"),
    )


def usage_report(sessions: DataFrame, stats: DataFrame) -> DataFrame:
    """E24 in full: usage per user with the user's stored trade statistics, the longest use first.

    Sessions without start or last sign are left out. ``stats``: uid, trade_count, trade_value, portfolio_value; a user may
    have several rows (one a client), which are summed; without one the sums are 0.
    """
    used = usage_sessions(sessions.where("start is not null and last_seen is not null"))
    sums = ("trade_count", "trade_value", "portfolio_value")
    stored = stats.where("uid is not null").groupBy(F.col("uid").alias("user")).agg(*[F.sum(c).alias(c) for c in sums])
    return used.join(stored, "user", "left").fillna(0, list(sums)).orderBy(F.desc("total_seconds"), "user")
