"""Picks, alerts and repairs of mis-dated rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clean as C

#: Target and slots by horizon, and the expected window in days. Fixed.
TARGETS = {"short": 3.0, "medium": 8.0, "long": 15.0}
SLOTS = {"short": 5, "medium": 3, "long": 3}
WINDOWS = {"short": (1, 3), "medium": (14, 45), "long": (60, 180)}


def by_horizon(values: dict, horizon: str | Column = "horizon") -> Column:
    pairs = [x for k, v in values.items() for x in (F.lit(k), F.lit(v))]
    return F.element_at(F.create_map(*pairs), F.col(horizon) if isinstance(horizon, str) else horizon)


def expected_window(picks: DataFrame) -> DataFrame:
    """I16."""
    lo, hi = ({k: v[i] for k, v in WINDOWS.items()} for i in (0, 1))
    return picks.withColumns(
        {
            "expected_from": F.date_add("pick_date", by_horizon(lo)), "expected_to": F.date_add("pick_date", by_horizon(hi)), "target_pct": by_horizon(TARGETS),
        }
    )


def with_prices(picks: DataFrame, prices: DataFrame) -> DataFrame:
    """Live price and the change since the pick. ``prices``: ticker, price."""
    df = picks.join(prices.select("ticker", "price"), "ticker", "left")
    return df.withColumn("pct_since", F.when(F.col("ref_price") > 0, (F.col("price") / F.col("ref_price") - 1) * 100))


def mark_achieved(picks: DataFrame, prices: DataFrame, session_date: str) -> DataFrame:
    """K10, first half: active picks that have reached their target."""
    df = with_prices(picks, prices)
    hit = F.coalesce((F.col("status") == "active") & (F.col("pct_since") >= by_horizon(TARGETS)), F.lit(False))
    return df.withColumns(
        {
            "status": F.when(hit, "achieved").otherwise(F.col("status")),
            "achieved_date": F.when(hit, F.lit(session_date).cast("date")).otherwise(F.col("achieved_date")),
            "achieved_price": F.when(hit, F.col("price")).otherwise(F.col("achieved_price")),
            "achieved_pct": F.when(hit, F.col("pct_since")).otherwise(F.col("achieved_pct")),
        }
    ).drop("price", "pct_since")


def refill(picks: DataFrame, pools: DataFrame, excluded: DataFrame, distressed: DataFrame, session_date: str, slots: dict[str, int] = SLOTS) -> DataFrame:
    """K10, second half, with D18 and D19: new picks for the free slots, short before medium before long.

    ``pools``: horizon, ticker, sector, rank, price, source. No ticker twice; at most one pre-breakout pick.
    """
    active = picks.where("status = 'active'").select("ticker", "horizon")
    taken = active.select("ticker").unionByName(excluded.where(F.col("excluded_date") == F.lit(session_date).cast("date")).select("ticker")).distinct()
    free = pools.join(taken, "ticker", "left_anti")
    bad = distressed.select("sector").distinct().withColumn("_bad", F.lit(True))
    free = free.join(bad, "sector", "left").where(F.col("_bad").isNull() | (F.col("horizon") != "medium")).drop("_bad")
    held = active.groupBy("horizon").count()
    out = None
    for horizon, n in slots.items():
        pool = free.where(F.col("horizon") == horizon)
        if out is not None:
            pool = pool.join(out.select("ticker"), "ticker", "left_anti")
        used = held.where(F.col("horizon") == horizon).agg(F.coalesce(F.max("count"), F.lit(0)).alias("_used"))
        pool = pool.withColumn("_pre", F.row_number().over(Window.partitionBy("source").orderBy("rank", "ticker")))
        pool = pool.where((F.col("source") != "pre_breakout") | (F.col("_pre") == 1))
        pool = pool.withColumn("_r", F.row_number().over(Window.partitionBy("horizon").orderBy("rank", "ticker"))).join(F.broadcast(used)).where(F.col("_r") <= n - F.col("_used"))
        rows = pool.select("ticker", "horizon", F.lit(session_date).cast("date").alias("pick_date"), F.col("price").alias("ref_price"), F.lit("active").alias("status"), "source")
        out = rows if out is None else out.unionByName(rows)
    return out


def alpha(picks: DataFrame) -> DataFrame:
    """Expects pct_since and benchmark_pct."""
    return picks.withColumn("alpha", F.col("pct_since") - F.col("benchmark_pct"))


def recent_achievements(picks: DataFrame, n: int) -> DataFrame:
    """G6."""
    return picks.where("status = 'achieved'").orderBy(F.desc("achieved_date"), F.desc("achieved_pct"), "ticker", "horizon").limit(n)


def achieved_within(picks: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """The trailing days."""
    day = F.lit(as_of).cast("date")
    return picks.where((F.col("status") == "achieved") & F.col("achieved_date").between(F.date_sub(day, days), day))


def retain_newest(picks: DataFrame, n: int = 500) -> DataFrame:
    """The newest n achieved picks, and all others."""
    done = F.col("status").eqNullSafe("achieved")
    return picks.where(~done).unionByName(picks.where(done).orderBy(F.desc("achieved_date"), F.desc("id")).limit(n))


def fired_dates(dates: str, days: int) -> Column:
    """Of a sorted array of distinct dates the first, and each that lies ``days`` or more behind the last taken."""

    def step(kept, x):
        return F.when(F.datediff(x, F.element_at(kept, -1)) >= days, F.concat(kept, F.array(x))).otherwise(kept)

    return F.aggregate(F.slice(dates, F.lit(2), F.size(dates)), F.slice(dates, 1, 1), step)


def dedupe_alerts(events: DataFrame, days: int) -> DataFrame:
    """L4, batch twin, and K18's gate: per key an event fires if the last that fired lies ``days`` or more back.

    ``events``: alert_key, event_date. A fold over each key's distinct dates.
    """
    grouped = events.select("alert_key", "event_date").distinct().groupBy("alert_key").agg(F.array_sort(F.collect_list("event_date")).alias("d"))
    return grouped.select("alert_key", F.explode(fired_dates("d", days)).alias("event_date"))


def alert_events(achieved: DataFrame, sectors: DataFrame, watchlist: DataFrame, divergence: DataFrame, session_date: str) -> DataFrame:
    """One row per event with its key and payload."""
    day = F.lit(session_date).cast("date").alias("event_date")

    def rows(df, kind, *key):
        return df.select(F.concat_ws(":", F.lit(kind), *key).alias("alert_key"), day, F.lit(kind).alias("kind"), F.to_json(F.struct(*df.columns)).alias("payload"))

    parts = [
        rows(achieved, "pick_achieved", "ticker", "horizon"),
        rows(sectors.where("sector_warning"), "concentration", "sector"),
        rows(watchlist.where("tier = 'High Confidence'"), "pre_breakout", "ticker"),
        rows(divergence.where("divergence in ('bullish', 'bearish')"), "divergence", "divergence"),
    ]
    return reduce(DataFrame.unionByName, parts)


# --- repairs ---------------------------------------------------------------------------------


def future_rows(bars: DataFrame, as_of: str) -> DataFrame:
    """C10, with the date that day and month swapped give."""
    return bars.where(F.col("date") > F.lit(as_of).cast("date")).withColumn("swapped", C.swap_day_month("date"))


def repair_future(bars: DataFrame, as_of: str) -> DataFrame:
    """K13 with D16: each future row with ``repaired``, ``collision`` or ``unfixable``."""
    bad = future_rows(bars, as_of)
    taken = bars.select("ticker", F.col("date").alias("swapped"), F.lit(True).alias("_taken"))
    valid = F.col("swapped").isNotNull() & (F.col("swapped") <= F.lit(as_of).cast("date"))
    df = bad.join(taken, ["ticker", "swapped"], "left")
    return df.withColumn("outcome", F.when(~F.coalesce(valid, F.lit(False)), "unfixable").when(F.col("_taken"), "collision").otherwise("repaired")).drop("_taken")


def apply_repair(bars: DataFrame, as_of: str) -> DataFrame:
    """The bars with repairable rows moved; other future rows stay."""
    fixed = repair_future(bars, as_of)
    moved = fixed.where("outcome = 'repaired'")
    rest = bars.join(moved.select("ticker", "date"), ["ticker", "date"], "left_anti")
    return rest.unionByName(moved.withColumn("date", F.col("swapped")).select(*bars.columns))


def purge_collisions(bars: DataFrame, as_of: str) -> DataFrame:
    """Without future rows whose swapped date exists."""
    bad = repair_future(bars, as_of).where("outcome = 'collision'").select("ticker", "date")
    return bars.join(bad, ["ticker", "date"], "left_anti")


def collision_pairs(bars: DataFrame, as_of: str) -> DataFrame:
    """E30."""
    out = repair_future(bars, as_of).where("outcome = 'collision'").groupBy("date", "swapped").count()
    return out.withColumn("single_incident", F.count("*").over(Window.partitionBy(F.lit(1))) == 1)


def future_by_date(bars: DataFrame, as_of: str, n: int = 5) -> DataFrame:
    """Rows per future date, and the first n of its tickers."""
    rows = bars.where(F.col("date") > F.lit(as_of).cast("date")).withColumn("_r", F.row_number().over(Window.partitionBy("date").orderBy("ticker")))
    return rows.groupBy("date").agg(F.count("*").alias("rows"), F.array_sort(F.collect_list(F.when(F.col("_r") <= n, F.col("ticker")))).alias("sample"))


def price_matches(bars: DataFrame, wanted: DataFrame, as_of: str, tol_pct: float = 0.5) -> DataFrame:
    """Bars of the ticker whose close lies within the tolerance, with their rank by nearness. ``wanted``: id, ticker, price."""
    df = bars.where(F.col("date") <= F.lit(as_of).cast("date")).join(wanted, "ticker")
    gap = F.abs(F.col("close") - F.col("price"))
    near = df.where(gap <= F.greatest(F.col("price") * tol_pct / 100, F.lit(1e-9))).withColumn("gap", gap)
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("gap", "date")))


def choose_candidate(matches: DataFrame, anchor_is_after: bool) -> DataFrame:
    """The only date there is, or the nearest on the right side of ``anchor``; null where neither exists."""
    side = F.col("date") <= F.col("anchor") if anchor_is_after else F.col("date") >= F.col("anchor")
    return matches.groupBy("id").agg(
        F.when(F.count_distinct("date") == 1, F.min("date")).otherwise(F.min_by(F.when(side, F.col("date")), F.when(side, F.struct(F.abs(F.datediff("date", "anchor")).alias("d"), "date")))).alias("chosen"),
        F.count_distinct("date").alias("candidates"),
    )


def repair_pick_dates(picks: DataFrame, bars: DataFrame, as_of: str, tol_pct: float = 0.5) -> DataFrame:
    """Pick dates from prices, anchored on the achieved date; ``review`` where no date can be chosen."""
    wanted = picks.select("id", "ticker", F.col("ref_price").alias("price"), F.col("achieved_date").alias("anchor"))
    chosen = choose_candidate(price_matches(bars, wanted, as_of, tol_pct), True)
    out = picks.join(chosen, "id", "left")
    return out.select(*picks.columns, F.col("chosen").alias("repaired_date"), F.col("chosen").isNull().alias("review"))


def repair_future_picks(picks: DataFrame, bars: DataFrame, as_of: str, tol_pct: float = 0.5) -> DataFrame:
    """K15 in full: pick dates, then achieved dates, that lie after ``as_of`` move to a day with their price.

    A pick date is sought before the achieved one (if that is good), an achieved one after the pick date as repaired.
    ``pick_action`` and ``achieved_action``: kept, repaired or review (no date can be chosen; it stays). ids are unique.
    """
    day = F.lit(as_of).cast("date")

    def moved(df, date, price, anchor, after):
        bad = F.coalesce(F.col(date) > day, F.lit(False))
        wanted = df.where(bad).select("id", "ticker", F.col(price).alias("price"), F.when(F.col(anchor) <= day, F.col(anchor)).alias("anchor"))
        found = choose_candidate(price_matches(bars, wanted, as_of, tol_pct), after).select("id", F.col("chosen").alias("_date"))
        action = F.when(~bad, "kept").when(F.col("_date").isNotNull(), "repaired").otherwise("review")
        out = df.join(found, "id", "left").withColumns({date.replace("_date", "_action"): action, date: F.coalesce("_date", date)})
        return out.drop("_date")

    return moved(moved(picks, "pick_date", "ref_price", "achieved_date", True), "achieved_date", "achieved_price", "pick_date", False)


def revert_picks(picks: DataFrame, targets: DataFrame) -> DataFrame:
    """Achieved picks of the targets become active again (``action`` revert) or go (delete). ``targets``: ticker, action, pick_date."""
    t = targets.select("ticker", "action", F.col("pick_date").alias("_date"))
    df = picks.join(t, "ticker", "left")
    back = (F.col("action") == "revert") & (F.col("status") == "achieved")
    back = F.coalesce(back, F.lit(False))
    df = df.where(~F.coalesce((F.col("action") == "delete") & (F.col("status") == "achieved"), F.lit(False)))
    return df.withColumns(
        {
            "status": F.when(back, "active").otherwise(F.col("status")),
            "pick_date": F.when(back & F.col("_date").isNotNull(), F.col("_date")).otherwise(F.col("pick_date")),
            **{c: F.when(~back, F.col(c)) for c in ("achieved_date", "achieved_price", "achieved_pct")},
        }
    ).drop("action", "_date")


def purge_rows(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Without the targets' rows; a target without a date takes all of its ticker. ``rows``: ticker, achieved_date."""
    t = targets.select("ticker", F.col("achieved_date").alias("_date"), F.lit(True).alias("_hit")).distinct()
    hit = rows.join(t, "ticker").where(F.col("_date").isNull() | (F.col("_date") == F.col("achieved_date"))).select("ticker", "achieved_date")
    return rows.join(hit.distinct(), ["ticker", "achieved_date"], "left_anti")


def list_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Tickers in one list only, and ranks at which the lists differ. Both: rank, ticker."""
    only = a.select("ticker").exceptAll(b.select("ticker")).withColumn("fault", F.lit("only in first"))
    only = only.unionByName(b.select("ticker").exceptAll(a.select("ticker")).withColumn("fault", F.lit("only in second")))
    order = a.select("rank", "ticker").join(b.select("rank", F.col("ticker").alias("other")), "rank").where("ticker <> other")
    return only.unionByName(order.select("ticker", F.lit("other position").alias("fault")))


def first_seen(versions: DataFrame) -> DataFrame:
    """Per ticker and horizon the first version, the first achieved one, the statuses; out-of-order dates are flagged."""
    done = F.col("status") == "achieved"
    out = versions.groupBy("ticker", "horizon").agg(
        F.min("version").alias("first_version"), F.min(F.when(done, F.col("version"))).alias("first_achieved"), F.array_sort(F.collect_set("status")).alias("statuses"),
        F.min("pick_date").alias("pick_date"), F.min(F.when(done, F.col("achieved_date"))).alias("achieved_date"),
    )
    return out.withColumn("disordered", F.coalesce(F.col("achieved_date") < F.col("pick_date"), F.lit(False)))


# --- names -----------------------------------------------------------------------------------


#: Names that hold a common token are compared by classes, not one by one.
COMMON = 1000


def _split_names(df: DataFrame, common: DataFrame, as_: str) -> DataFrame:
    """Key, number of tokens, and the tokens: the common ones and the others."""
    own = df.select("key", C.name_tokens("name").alias("tokens")).where("size(tokens) > 0")
    each = own.select("key", F.size("tokens").alias("n"), F.explode("tokens").alias("token")).join(common.withColumn("_common", F.lit(True)), "token", "left")
    seen = F.col("_common").isNotNull()
    out = each.groupBy("key", "n").agg(F.array_sort(F.collect_list(F.when(seen, F.col("token")))).alias("common"), F.collect_list(F.when(~seen, F.col("token"))).alias("others"))
    return out.select(F.col("key").alias(f"{as_}_key"), *[F.col(c).alias(f"{as_}_{c}") for c in ("n", "common", "others")])


def fuzzy_match(left: DataFrame, right: DataFrame, min_ratio: float = 0.5, common: int = COMMON) -> DataFrame:
    """Shared name tokens over the smaller set; the best of each left row, ties by the right key.

    Both: key, name; keys are unique. Names that share a token which at most ``common`` names of a side hold are
    compared as pairs. What names share besides lies in common tokens alone, so there it depends on a name's class
    only (its common tokens and its number of tokens), of which the least key stands for all: a token that a third of
    the names hold makes pairs of classes.
    """
    tokens = [x.select(F.explode(C.name_tokens("name")).alias("token")).groupBy("token").count().where(F.col("count") > common).select("token") for x in (left, right)]
    often = tokens[0].unionByName(tokens[1]).distinct()
    a, b = _split_names(left, often, "left"), _split_names(right, often, "right")
    smaller = F.least("left_n", "right_n")
    best = F.min(F.struct((-F.col("shared") / smaller).alias("back"), "right_key")).alias("best")

    pairs = a.withColumn("token", F.explode("left_others")).join(b.withColumn("token", F.explode("right_others")), "token")
    both = F.size(F.array_intersect("left_common", "right_common")) + F.size(F.array_intersect("left_others", "right_others"))
    near = pairs.withColumn("shared", both).groupBy("left_key").agg(best)

    ca = a.where("size(left_common) > 0").select("left_common", "left_n").distinct()
    cb = b.where("size(right_common) > 0").groupBy("right_common", "right_n").agg(F.min("right_key").alias("right_key"))
    classes = ca.withColumn("token", F.explode("left_common")).join(cb.withColumn("token", F.explode("right_common")), "token")
    far = classes.withColumn("shared", F.size(F.array_intersect("left_common", "right_common"))).groupBy("left_common", "left_n").agg(best)
    far = a.join(far, ["left_common", "left_n"]).select("left_key", "best")

    out = near.unionByName(far).groupBy("left_key").agg(F.min("best").alias("best"))
    ratio = -F.col("best.back")
    return out.select("left_key", F.col("best.right_key").alias("right_key"), ratio.alias("ratio"), (ratio >= min_ratio).alias("matched"))


def review_split(left: DataFrame, matches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """D3: the matched rows, and those that need a review with their best ratio."""
    df = left.join(matches, left["key"] == matches["left_key"], "left").drop("left_key")
    return df.where("matched"), df.where(~F.coalesce(F.col("matched"), F.lit(False)))


# --- slots -----------------------------------------------------------------------------------


def refill_slots(live: DataFrame, pools: DataFrame, excluded: DataFrame, distressed: DataFrame, session_date: str, slots: dict[str, int] = SLOTS) -> DataFrame:
    """K10, second half, with D18 and D19, over pools of any size: new picks for the free slots, in the order of ``slots``.

    ``live``: ticker, horizon of the picks that hold a slot; ``pools``: horizon, ticker, sector, score, price, source;
    ``excluded``: ticker, horizon, excluded_date; ``distressed``: sector. The best score first, pre-breakout candidates
    behind all others and one at most; no ticker twice, none that is live, none that was removed from its horizon today,
    in ``medium`` none of a distressed sector.

    Picks of one horizon can take tickers from the next, so of each horizon and kind as many candidates are needed as
    there are slots; each task keeps no more of them. The choice is a fold over these few rows.
    """
    best = F.max(F.struct("score", "price", "sector", "source")).alias("best")
    each = pools.where("score is not null").groupBy("horizon", "ticker").agg(best).select("horizon", "ticker", "best.*")
    each = each.join(live.select("ticker").distinct(), "ticker", "left_anti")
    today = excluded.where(F.col("excluded_date") == F.lit(session_date).cast("date")).select("ticker", "horizon").distinct()
    each = each.join(today, ["ticker", "horizon"], "left_anti")
    bad = distressed.select("sector", F.lit("medium").alias("horizon")).distinct()
    each = each.join(bad, ["sector", "horizon"], "left_anti").withColumn("pre", F.col("source").eqNullSafe("pre_breakout"))
    few = [
        each.where((F.col("horizon") == h) & (F.col("pre") == F.lit(pre))).orderBy(F.desc("score"), "ticker").limit(sum(slots.values()))
        for h in slots for pre in (False, True)
    ]
    held = live.groupBy("horizon").agg(F.count("*").alias("held"))
    turn = by_horizon({h: i for i, h in enumerate(slots)})
    rows = reduce(DataFrame.unionByName, few).join(held, "horizon", "left").withColumn("free", by_horizon(slots) - F.coalesce("held", F.lit(0)))
    item = F.struct(turn.alias("turn"), "pre", (-F.col("score")).alias("back"), "ticker", "horizon", "price", "source", "free")
    ordered = rows.agg(F.array_sort(F.collect_list(item)).alias("all"))

    def take(kept, x):
        own = F.filter(kept, lambda k: k["turn"] == x["turn"])
        fits = (F.size(own) < x["free"]) & ~F.exists(kept, lambda k: k["ticker"] == x["ticker"]) & ~(x["pre"] & F.exists(own, lambda k: k["pre"]))
        return F.when(fits, F.concat(kept, F.array(x))).otherwise(kept)

    chosen = ordered.select(F.explode(F.aggregate("all", F.slice("all", 1, 0), take)).alias("p"))
    return chosen.select("p.ticker", "p.horizon", F.lit(session_date).cast("date").alias("pick_date"), F.col("p.price").alias("ref_price"), F.lit("active").alias("status"), "p.source")
