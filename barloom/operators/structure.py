"""Swings, levels and chart patterns.

Reversals, triangles and channels are windows over the swing sequence. Poles are
windowed extremes with running counts of steps; the rest behind a pole and the
cup between two rims are slices of the ticker's bars.
A pattern row: ticker, pattern, direction, start_index, end_index, start_date,
end_date, levels, quality.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.layout import stored
from .indicators import every, w

EPSILON, ORDER = 0.03, 5


def numbered(bars: DataFrame) -> DataFrame:
    return bars.withColumns({"idx": F.row_number().over(w()) - 1, "n": F.count("*").over(every())})


def swings(bars: DataFrame, order: int = ORDER) -> DataFrame:
    """strict extremes of the close within ``order`` bars on either side; never the first or last bar."""
    before, after = w().rowsBetween(-order, -1), w().rowsBetween(1, order)
    df = numbered(bars)
    c = F.col("close")
    peak = (c > F.max("close").over(before)) & (c > F.max("close").over(after))
    trough = (c < F.min("close").over(before)) & (c < F.min("close").over(after))
    kind = F.when(peak, "P").when(trough, "T")
    return df.withColumn("kind", kind).where("kind is not null and idx > 0 and idx < n - 1").select("ticker", "date", "idx", F.col("close").alias("price"), "kind", "n")


def swings_inclusive(bars: DataFrame, order: int = 10) -> DataFrame:
    """ties and edges count."""
    before, after = w().rowsBetween(-order, -1), w().rowsBetween(1, order)
    c = F.col("close")
    peak = (c >= F.coalesce(F.max("close").over(before), c)) & (c >= F.coalesce(F.max("close").over(after), c))
    return numbered(bars).withColumn("peak", peak).where("peak").select("ticker", "date", "idx", F.col("close").alias("price"))


def alternating(swing: DataFrame) -> DataFrame:
    """of a run of swings of one kind the most extreme stays, the earlier on ties."""
    by = Window.partitionBy("ticker").orderBy("idx")
    new = F.coalesce(F.lag("kind").over(by) != F.col("kind"), F.lit(True)).cast("int")
    runs = swing.withColumn("_new", new).withColumn("_run", F.sum("_new").over(by))
    rank = F.when(F.col("kind") == "P", -F.col("price")).otherwise(F.col("price"))
    best = F.row_number().over(Window.partitionBy("ticker", "_run").orderBy(rank, "idx"))
    return runs.withColumn("_b", best).where("_b = 1").drop("_new", "_run", "_b")


def peak_divergence(a: DataFrame, b: DataFrame, order: int = 10, min_shared: int = 60) -> DataFrame:
    """the last two peaks of two aligned series move apart. One row: shared bars and the verdict."""
    both = a.select("date", F.col("close").alias("a")).join(b.select("date", F.col("close").alias("b")), "date")
    long = both.select("date", F.expr("stack(2, 'a', a, 'b', b) as (ticker, close)"))
    peaks = swings_inclusive(long, order)
    last = peaks.withColumn("_r", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("idx")))).where("_r <= 2")
    slope = last.groupBy("ticker").agg(
        F.when(F.count("*") == 2, F.signum(F.max(F.when(F.col("_r") == 1, F.col("price"))) - F.max(F.when(F.col("_r") == 2, F.col("price"))))).alias("s")
    )
    signs = slope.agg(F.max(F.when(F.col("ticker") == "a", F.col("s"))).alias("a"), F.max(F.when(F.col("ticker") == "b", F.col("s"))).alias("b"))
    out = signs.join(both.agg(F.count("*").alias("shared")))
    verdict = F.when(F.col("shared") < min_shared, "unavailable").when((F.col("a") > 0) & (F.col("b") < 0), "bearish").when((F.col("a") < 0) & (F.col("b") > 0), "bullish").otherwise("none")
    return out.select("shared", verdict.alias("divergence"))


def support_resistance(bars: DataFrame, lookback: int = 250, order: int = ORDER, tol_pct: float = 1.5, touches: int = 2, half_life: float = 120.0, levels: int = 3) -> DataFrame:
    """price zones that swings touch again and again; up to ``levels`` a side, the nearest first."""
    recent = bars.withColumn("_r", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date")))).where(F.col("_r") <= lookback)
    now = recent.groupBy("ticker").agg(F.max("date").alias("last_date"), F.max_by("close", "date").alias("price_now"), F.count("*").alias("bars")).where(F.col("bars") >= order * 4)
    points = swings(recent.drop("_r"), order).join(now, "ticker")
    by = Window.partitionBy("ticker", "kind").orderBy("price", "idx")
    before = F.lag("price").over(by)
    new = F.coalesce((F.col("price") - before) / before * 100 > tol_pct, F.lit(True)).cast("int")
    zones = points.withColumn("_new", new).withColumn("zone", F.sum("_new").over(by))
    age = F.greatest(F.datediff("last_date", "date"), F.lit(0))
    agg = zones.groupBy("ticker", "kind", "zone", "price_now").agg(
        F.avg("price").alias("level"), F.count("*").alias("touches"), F.sum(F.pow(F.lit(0.5), age / half_life)).alias("strength"), F.max("date").alias("last_touch")
    ).where(F.col("touches") >= touches)
    side = F.when((F.col("kind") == "P") & (F.col("level") > F.col("price_now")), "resistance").when((F.col("kind") == "T") & (F.col("level") < F.col("price_now")), "support")
    out = agg.withColumn("side", side).where("side is not null")
    near = Window.partitionBy("ticker", "side").orderBy(F.abs(F.col("level") - F.col("price_now")))
    return out.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= levels).select("ticker", "side", "rank", "level", "touches", "strength", "last_touch")


def pct_diff(a, b) -> Column:
    """Difference relative to the mean size."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    size = (F.abs(a) + F.abs(b)) / 2
    return F.when(size == 0, 0.0).otherwise(F.abs(a - b) / size)


def _quality(diffs: list[Column], tol: float) -> Column:
    return F.greatest(F.lit(0.0), 1 - sum(diffs[1:], diffs[0]) / len(diffs) / tol)


def _ahead(swing: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("ticker").orderBy("idx")
    cols = {}
    for i in range(1, k):
        cols |= {f"p{i}": F.lead("price", i).over(by), f"i{i}": F.lead("idx", i).over(by), f"d{i}": F.lead("date", i).over(by)}
    return swing.withColumns({"p0": F.col("price"), "i0": F.col("idx"), "d0": F.col("date"), **cols}).where(f"i{k - 1} is not null")


def _rows(df: DataFrame, name: str, direction, end: int, levels: dict[str, Column], quality: Column) -> DataFrame:
    pairs = [x for k, v in levels.items() for x in (F.lit(k), v)]
    return df.select(
        "ticker", F.lit(name).alias("pattern"), F.lit(direction).alias("direction"), F.col("i0").alias("start_index"), F.col(f"i{end}").alias("end_index"),
        F.col("d0").alias("start_date"), F.col(f"d{end}").alias("end_date"), F.create_map(*pairs).alias("levels"), F.bround(quality, 2).alias("quality"),
    )


def reversals(swing: DataFrame, eps: float = EPSILON) -> DataFrame:
    """J1 to J4, over alternating swings."""
    p = [F.col(f"p{i}") for i in range(5)]
    five, three = _ahead(swing, 5), _ahead(swing, 3)
    neck, sides = pct_diff(p[1], p[3]), pct_diff(p[0], p[4])
    shape = (sides <= eps) & (neck <= eps * 1.5)
    q5 = _quality([sides, neck], eps * 1.5)
    line = (p[1] + p[3]) / 2
    names = {"left_shoulder": p[0], "head": p[2], "right_shoulder": p[4], "neckline": line, "target": 2 * line - p[2]}
    top = five.where((F.col("kind") == "P") & (p[2] > p[0] * (1 + eps)) & (p[2] > p[4] * (1 + eps)) & shape)
    low = five.where((F.col("kind") == "T") & (p[2] < p[0] * (1 - eps)) & (p[2] < p[4] * (1 - eps)) & shape)
    same = pct_diff(p[0], p[2])
    mean = (p[0] + p[2]) / 2
    twin = F.abs(mean - p[1]) / mean >= eps * 1.5
    top2, low2 = ({f"first_{x}": p[0], f"second_{x}": p[2], "neckline": p[1], "target": 2 * p[1] - mean} for x in ("top", "bottom"))
    q3 = _quality([same], eps)
    return (
        _rows(top, "Head & Shoulders", "bearish", 4, names, q5)
        .unionByName(_rows(low, "Inverse Head & Shoulders", "bullish", 4, names, q5))
        .unionByName(_rows(three.where((F.col("kind") == "P") & (same <= eps) & twin), "Double Top", "bearish", 2, top2, q3))
        .unionByName(_rows(three.where((F.col("kind") == "T") & (same <= eps) & twin), "Double Bottom", "bullish", 2, low2, q3))
    )


def _fit(points: Column) -> tuple[Column, Column, Column]:
    """Slope, intercept and number of points of a least-squares line over an array of (idx, price)."""

    def total(f):
        return F.aggregate(points, F.lit(0.0), lambda acc, s: acc + f(s))

    n = F.size(points)
    x, y = total(lambda s: s["idx"].cast("double")), total(lambda s: s["price"])
    xx, xy = total(lambda s: s["idx"].cast("double") * s["idx"]), total(lambda s: s["idx"] * s["price"])
    slope = F.try_divide(n * xy - x * y, n * xx - x * x)
    return slope, F.try_divide(y - slope * x, n), n


def triangles_and_channels(swing: DataFrame, eps: float = EPSILON) -> DataFrame:
    """Lines through the peaks and troughs of 4 to 7 swings in a row."""
    by = Window.partitionBy("ticker").orderBy("idx")
    ahead = F.collect_list(F.struct("idx", "price", "kind", "date")).over(by.rowsBetween(0, 6))
    spans = swing.withColumn("_s", ahead).select("ticker", F.explode(F.sequence(F.lit(4), F.lit(7))).alias("k"), "_s").where("size(_s) >= k")
    spans = spans.select("ticker", F.slice("_s", F.lit(1), F.col("k")).alias("s"))
    peaks, troughs = F.filter("s", lambda x: x["kind"] == "P"), F.filter("s", lambda x: x["kind"] == "T")
    df = spans.withColumns({"peaks": peaks, "troughs": troughs}).where("size(peaks) >= 2 and size(troughs) >= 2")
    (ps, pi, pn), (ts, ti, tn) = _fit(F.col("peaks")), _fit(F.col("troughs"))
    first, last = F.col("s")[0], F.element_at("s", -1)
    mean = F.aggregate("s", F.lit(0.0), lambda a, x: a + x["price"]) / F.size("s")
    df = df.withColumns(
        {"ps": ps, "pi": pi, "ts": ts, "ti": ti, "i0": first["idx"], "d0": first["date"], "i1": last["idx"], "d1": last["date"], "mean": mean,
         "top": F.aggregate("peaks", F.lit(0.0), lambda a, x: a + x["price"]) / pn, "low": F.aggregate("troughs", F.lit(0.0), lambda a, x: a + x["price"]) / tn}
    )

    def way(slope):
        move = F.col(slope) * (F.col("i1") - F.col("i0")) / F.col("mean")
        return F.when(move > eps, "rising").when(move < -eps, "falling").otherwise("flat")

    df = df.withColumns({"pc": way("ps"), "tc": way("ts")})
    gap = F.col("ps") - F.col("ts")
    apex = F.when(F.abs(gap) >= 1e-9, (F.col("ti") - F.col("pi")) / gap)

    def flat(points, level):
        return F.greatest(F.lit(0.0), 1 - F.aggregate(points, F.lit(0.0), lambda a, x: a + pct_diff(x["price"], F.col(level))) / F.size(points) / eps)

    def at(slope, intercept, x):
        return F.col(slope) * F.col(x) + F.col(intercept)

    ends = {"resistance_start": at("ps", "pi", "i0"), "resistance_end": at("ps", "pi", "i1"), "support_start": at("ts", "ti", "i0"), "support_end": at("ts", "ti", "i1")}
    meet = {"apex_index": apex, "apex_price": F.col("ps") * apex + F.col("pi")}
    asc, desc = (F.col("pc") == "flat") & (F.col("tc") == "rising"), (F.col("pc") == "falling") & (F.col("tc") == "flat")
    sym = (F.col("pc") == "falling") & (F.col("tc") == "rising") & (apex.isNull() | (apex > F.col("i1")))
    channel = (F.col("pc") == F.col("tc")) & ((F.col("pc") == "flat") | (F.abs(gap) / (F.abs("ps") + F.abs("ts") + 1e-9) <= eps * 4))
    titled = F.initcap(F.col("pc"))
    parts = [
        (asc, F.lit("Ascending Triangle"), F.lit("bullish"), {"resistance": F.col("top"), "support_start": ends["support_start"], "support_end": ends["support_end"]} | meet, flat("peaks", "top")),
        (desc, F.lit("Descending Triangle"), F.lit("bearish"), {"support": F.col("low"), "resistance_start": ends["resistance_start"], "resistance_end": ends["resistance_end"]} | meet, flat("troughs", "low")),
        (sym, F.lit("Symmetrical Triangle"), F.lit("neutral"), ends | meet, F.lit(0.75)),
        (channel, F.concat(F.lit("Price Channel ("), titled, F.lit(")")), F.when(F.col("pc") == "rising", "bullish").when(F.col("pc") == "falling", "bearish").otherwise("neutral"), ends, F.lit(0.85)),
    ]
    found = [
        F.when(c, F.struct(name.alias("pattern"), way_.alias("direction"), F.create_map(*[x for k, v in levels.items() for x in (F.lit(k), v)]).alias("levels"), F.bround(q, 2).alias("quality")))
        for c, name, way_, levels, q in parts
    ]
    out = df.select("ticker", F.col("i0").alias("start_index"), F.col("i1").alias("end_index"), F.col("d0").alias("start_date"), F.col("d1").alias("end_date"), F.explode(F.array_compact(F.array(*found))).alias("m"))
    return out.select("ticker", "m.pattern", "m.direction", "start_index", "end_index", "start_date", "end_date", "m.levels", "m.quality")


def histories(bars: DataFrame, least: float = 0.08, longest: int = 15, steady: float = 0.75) -> DataFrame:
    """One row per ticker: its bars in order, with the signs of the steps to two bars on either side, and its poles.

    A pole leads from a bar to the first extreme of the ``longest`` bars from it
    on, three bars away or more; the move is ``least`` or more, and ``steady``
    of its steps go that way. Of two such moves the larger counts. Poles do not
    overlap: the next one starts at the end of the last or later.
    """
    c, ahead = F.col("price"), w().rowsBetween(0, longest - 1)
    df = numbered(bars).select("ticker", "date", "idx", F.col("close").alias("price"))
    step = F.signum(c - F.lag("price").over(w()))
    df = df.withColumns({f"{k}{i}": F.signum(c - f("price", i).over(w())) for k, f in (("back", F.lag), ("ahead", F.lead)) for i in (1, 2)})
    df = df.withColumn("_step", step)
    df = df.withColumns({"ups": F.count_if(F.col("_step") >= 0).over(w()), "downs": F.count_if(F.col("_step") <= 0).over(w())})
    at = F.struct("idx", "date", "price", "ups", "downs")
    df = df.withColumns({"_top": F.max_by(at, F.struct("price", -F.col("idx"))).over(ahead), "_low": F.min_by(at, F.struct("price", "idx")).over(ahead)})

    def pole(end: str, sign: int, steps: str) -> Column:
        bars_, move = F.col(f"{end}.idx") - F.col("idx"), F.try_divide(F.col(f"{end}.price"), c) - 1
        one_way = F.try_divide(F.col(f"{end}.{steps}") - F.col(steps), bars_) >= steady
        found = F.struct(F.col("idx").alias("i"), F.col(f"{end}.idx").alias("j"), move.alias("move"), c.alias("ci"), F.col(f"{end}.price").alias("cj"), F.col("date").alias("di"))
        return F.when((bars_ >= 3) & (c != 0) & (sign * move >= least) & one_way, found)

    up, down = pole("_top", 1, "ups"), pole("_low", -1, "downs")
    best = F.when(F.coalesce(F.abs(down["move"]) > F.abs(up["move"]), up.isNull()), down).otherwise(up)
    near = F.when((F.col("back1") > 0) & (F.col("ahead1") > 0), 1).when((F.col("back1") < 0) & (F.col("ahead1") < 0), -1).otherwise(0)
    own = F.struct("idx", "date", "price", near.alias("turn"), "back2", "ahead2")
    out = df.groupBy("ticker").agg(F.array_sort(F.collect_list(own)).alias("bars"), F.array_sort(F.collect_list(best)).alias("found"))
    start = F.struct(F.lit(0).alias("free"), F.slice("found", 1, 0).alias("kept"))

    def take(acc, x):
        return F.when(x["i"] >= acc["free"], F.struct(x["j"].alias("free"), F.concat(acc["kept"], F.array(x)).alias("kept"))).otherwise(acc)

    return out.select("ticker", "bars", F.aggregate("found", start, take, lambda acc: acc["kept"]).alias("poles"))


def flags_and_pennants(history: DataFrame, eps: float = EPSILON, longest: int = 20, tight: float = 0.6) -> DataFrame:
    """What the lines along the swings of the bars behind a pole say; a swing tops or bottoms two bars on either side."""
    # only the bars behind a pole leave the history's row
    rest = F.transform("poles", lambda p: F.struct(p.alias("p"), F.slice("bars", p["j"] + 1, F.lit(longest + 1)).alias("rest")))
    df = history.select("ticker", F.explode(rest).alias("x")).select("ticker", "x.p", "x.rest").withColumn("e", F.col("p.j") + F.size("rest") - 1)
    df = df.where(F.col("e") - F.col("p.j") >= 5)

    def turns(sign: int) -> Column:
        def turn(x):
            far = ((x["idx"] - 2 < F.col("p.j")) | (sign * x["back2"] > 0)) & ((x["idx"] + 2 > F.col("e")) | (sign * x["ahead2"] > 0))
            return (x["turn"] == sign) & (x["idx"] > F.col("p.j")) & (x["idx"] < F.col("e")) & far

        return F.filter("rest", turn)

    # exploded, so that they are made once: a condition on plain columns would be put in front and make them again
    df = df.select("*", F.explode(F.array(F.struct(turns(1).alias("tops"), turns(-1).alias("lows")))).alias("t")).select("*", "t.*").where("size(tops) >= 2 and size(lows) >= 2")
    prices = F.transform("rest", lambda x: x["price"])
    mean = F.try_divide(F.aggregate(prices, F.lit(0.0), lambda a, x: a + x), F.size("rest"))
    (ts, ti, _), (ls, li, _) = _fit(F.col("tops")), _fit(F.col("lows"))
    df = df.withColumns({"ts": ts, "ti": ti, "ls": ls, "li": li, "mean": mean, "range": F.array_max(prices) - F.array_min(prices)})

    def way(slope: str) -> Column:
        move = F.try_divide(F.col(slope) * (F.col("e") - F.col("p.j")), F.col("mean"))
        return F.when(move > eps, "rising").when(move < -eps, "falling").otherwise("flat")

    df = df.withColumns({"top": way("ts"), "low": way("ls"), "height": F.abs(F.col("p.cj") - F.col("p.ci")), "up": F.col("p.move") > 0})
    df = df.where((F.col("height") > 0) & (F.col("range") <= tight * F.col("height")))
    along = F.when(F.col("up"), "rising").otherwise("falling")
    flag = (F.col("top") == F.col("low")) & (F.col("top") != along)
    pennant = (F.col("top") == "falling") & (F.col("low") == "rising")
    ends = [F.col("ts") * F.col("e") + F.col("ti"), F.col("ls") * F.col("e") + F.col("li")]
    target = 2 * F.col("p.cj") - F.col("p.ci")

    def levels(prefix: str) -> Column:
        named = {"pole_start": F.col("p.ci"), "pole_end": F.col("p.cj"), f"{prefix}resistance_end": ends[0], f"{prefix}support_end": ends[1], "measured_move_target": target}
        return F.create_map(*[x for k, v in named.items() for x in (F.lit(k), v)])

    return df.where(flag | pennant).select(
        "ticker",
        F.when(pennant, "Pennant").when(F.col("up"), "Bull Flag").otherwise("Bear Flag").alias("pattern"),
        F.when(F.col("up"), "bullish").otherwise("bearish").alias("direction"),
        F.col("p.i").alias("start_index"),
        F.col("e").alias("end_index"),
        F.col("p.di").alias("start_date"),
        F.element_at("rest", -1)["date"].alias("end_date"),
        F.when(pennant, levels("")).otherwise(levels("flag_")).alias("levels"),
        F.bround(F.greatest(F.lit(0.0), 1 - F.try_divide("range", "height")), 2).alias("quality"),
    )


def cups(history: DataFrame, swing: DataFrame, eps: float = EPSILON, shortest: int = 20, longest: int = 150, depth: float = 0.12, handle: float = 0.5) -> DataFrame:
    """Two rims of like height, a bowl between them, a shallow handle behind.

    Rims are joined by the stretch of ``longest`` bars they lie in or border on.
    The bowl is a least-squares parabola, in closed form over equal steps.
    """
    rims = swing.where("kind = 'P'").select("ticker", F.col("idx").alias("i"), F.col("price").alias("p"), "date")
    left = rims.select("ticker", F.floor(F.col("i") / longest).alias("_b"), F.col("i").alias("l"), F.col("p").alias("pl"), F.col("date").alias("dl"))
    right = rims.select("ticker", F.explode(F.array(F.floor(F.col("i") / longest), F.floor(F.col("i") / longest) - 1)).alias("_b"), F.col("i").alias("r"), F.col("p").alias("pr"))
    # stored swings are a small file of many rows: by its size Spark would take all of them to the driver to broadcast them
    pairs = left.join(right.hint("merge"), ["ticker", "_b"]).drop("_b").withColumns({"wide": F.col("r") - F.col("l"), "differ": pct_diff("pl", "pr")})
    pairs = pairs.where(F.col("wide").between(shortest, longest) & (F.col("differ") <= eps))
    own = pairs.groupBy("ticker").agg(F.collect_list(F.struct("l", "r", "pl", "pr", "dl", "wide", "differ")).alias("rims"))
    behind = lambda wide: F.greatest(F.lit(5), F.floor(wide / 4).cast("int"))
    # only the bars from rim to handle leave the history's row
    reach = F.transform("rims", lambda x: F.struct(x.alias("x"), F.slice("bars", x["l"] + 1, x["wide"] + 1 + behind(x["wide"])).alias("span")))
    df = own.join(history.select("ticker", "bars"), "ticker").select("ticker", F.explode(reach).alias("y")).select("ticker", "y.x.*", "y.span")
    df = df.withColumns({"bowl": F.slice("span", F.lit(1), F.col("wide") + 1), "m": (F.col("wide") + 1).cast("double"), "mid": (F.col("l") + F.col("r")) / 2})
    square = (F.col("m") * F.col("m") - 1) / 12  # mean square of the centred steps

    def total(f) -> Column:
        return F.aggregate("bowl", F.lit(0.0), lambda a, x: a + f(x["idx"] - F.col("mid")) * x["price"])

    bend = total(lambda u: u * u - square) / (F.col("m") * (F.col("m") * F.col("m") - 1) * (F.col("m") * F.col("m") - 4) / 180)
    tilt = total(lambda u: u) / (F.col("m") * square)
    df = df.withColumns({"bend": bend, "tilt": tilt, "bottom": F.array_min(F.transform("bowl", lambda x: x["price"]))})
    lowest = (F.col("m") - 1) / 2 - F.try_divide("tilt", 2 * F.col("bend"))
    df = df.where((F.col("bend") > 0) & (lowest >= 0.25 * F.col("m")) & (lowest <= 0.75 * F.col("m")))
    df = df.withColumns({"rim": (F.col("pl") + F.col("pr")) / 2, "e": F.col("l") + F.size("span") - 1}).where(F.col("e") - F.col("r") >= 3)
    df = df.withColumn("tail", F.slice("span", F.col("wide") + 1, F.col("e") - F.col("r") + 1))
    df = df.withColumn("dip", F.array_min(F.transform("tail", lambda x: x["price"])))
    high, drop, deep = F.col("rim") - F.col("bottom"), F.col("pr") - F.col("dip"), F.greatest("pl", "pr")
    df = df.where((F.try_divide(high, F.col("rim")) >= depth) & (drop > 0) & (drop <= handle * high) & (F.col("dip") >= (F.col("rim") + F.col("bottom")) / 2))
    named = {"left_rim": F.col("pl"), "right_rim": F.col("pr"), "cup_bottom": F.col("bottom"), "handle_low": F.col("dip"), "breakout_level": deep, "target": deep + high}
    return df.select(
        "ticker",
        F.lit("Cup & Handle").alias("pattern"),
        F.lit("bullish").alias("direction"),
        F.col("l").alias("start_index"),
        F.col("e").alias("end_index"),
        F.col("dl").alias("start_date"),
        F.element_at("tail", -1)["date"].alias("end_date"),
        F.create_map(*[x for k, v in named.items() for x in (F.lit(k), v)]).alias("levels"),
        F.bround(F.greatest(F.lit(0.0), 1 - F.col("differ") / eps), 2).alias("quality"),
    )


def scanned(bars: DataFrame, eps: float = EPSILON, order: int = ORDER) -> DataFrame:
    """Flags, pennants and cups."""
    history = histories(bars)
    return flags_and_pennants(history, eps).unionByName(cups(history, alternating(swings(bars, order)), eps))


def dedupe_overlaps(patterns: DataFrame) -> DataFrame:
    """H6: of overlapping matches of a pattern the better (quality, then span) stays, against the last one kept.

    Matches that begin behind the end of all before them start anew, so the fold is one over each such stretch.
    """
    by = Window.partitionBy("ticker", "pattern").orderBy("start_index", "end_index")
    far = F.max("end_index").over(by.rowsBetween(Window.unboundedPreceding, -1))
    patterns = patterns.withColumn("_new", F.coalesce(F.col("start_index") > far, F.lit(True)).cast("int")).withColumn("_stretch", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    item = F.struct("start_index", "end_index", "quality", "direction", "start_date", "end_date", "levels")
    key = F.struct(F.col("start_index"), F.col("end_index"))
    grouped = patterns.groupBy("ticker", "pattern", "_stretch").agg(F.collect_list(F.struct(key.alias("k"), item.alias("v"))).alias("all"))
    ordered = F.transform(F.array_sort("all", lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0)), lambda x: x["v"])

    def step(kept, r):
        last = F.element_at(kept, -1)
        better = (r["quality"] > last["quality"]) | ((r["quality"] == last["quality"]) & (r["end_index"] - r["start_index"] > last["end_index"] - last["start_index"]))
        others = F.slice(kept, F.lit(1), F.size(kept) - 1)
        overlap = r["start_index"] <= last["end_index"]
        return F.when(overlap & better, F.concat(others, F.array(r))).when(overlap, kept).otherwise(F.concat(kept, F.array(r)))

    kept = F.aggregate(F.slice("s", F.lit(2), F.size("s")), F.slice("s", 1, 1), step)
    out = grouped.select("ticker", "pattern", ordered.alias("s")).select("ticker", "pattern", F.explode(kept).alias("v"))
    return out.select("ticker", "pattern", "v.direction", "v.start_index", "v.end_index", "v.start_date", "v.end_date", "v.levels", "v.quality")


class Prepared:
    """What detectors share, each made once: the bars by ticker, their alternating swings, and the histories with poles."""

    def __init__(self, bars: DataFrame):
        self.bars = stored(bars, "bars")

    @cached_property
    def swing(self) -> DataFrame:
        return stored(alternating(swings(self.bars)), "swings")

    @cached_property
    def history(self) -> DataFrame:
        return stored(histories(self.bars), "histories")


#: M1: detectors by name; each maps what is prepared to pattern rows. Add an entry and detect_all runs it.
DETECTORS = {
    "reversals": lambda p: reversals(p.swing),
    "triangles_and_channels": lambda p: triangles_and_channels(p.swing),
    "flags_and_pennants": lambda p: flags_and_pennants(p.history),
    "cups": lambda p: cups(p.history, p.swing),
}


def detect_all(bars: DataFrame | Prepared, dedupe: bool = True, detectors=None) -> DataFrame:
    """Every detector's matches, without overlaps. Bars that are prepared already are not stored again."""
    prepared, out = bars if isinstance(bars, Prepared) else Prepared(bars), None
    for f in (detectors or DETECTORS).values():
        rows = f(prepared)
        out = rows if out is None else out.unionByName(rows)
    return dedupe_overlaps(out) if dedupe else out


def pattern_filter(patterns: DataFrame, bars: DataFrame, min_bars: int = 40, min_quality: float = 0.75) -> DataFrame:
    """J15."""
    long = bars.groupBy("ticker").count().where(F.col("count") >= min_bars).select("ticker")
    return patterns.where(F.col("quality") >= min_quality).join(long, "ticker", "left_semi")


def pattern_summary(patterns: DataFrame) -> DataFrame:
    """Counts by pattern and by direction."""
    out = patterns.groupingSets([[F.col("pattern")], [F.col("direction")]], "pattern", "direction").agg(F.count("*").alias("matches"))
    return out.select(F.when(F.col("pattern").isNotNull(), "pattern").otherwise("direction").alias("by"), F.coalesce("pattern", "direction").alias("name"), "matches")


def best_pattern(patterns: DataFrame) -> DataFrame:
    """Per ticker, bullish first, then the quality; ties by the latest end and the name."""
    rank = F.struct((F.col("direction") == "bullish").cast("int").alias("b"), "quality", "end_index", "pattern")
    return patterns.groupBy("ticker").agg(F.max_by(F.struct("pattern", "direction", "quality"), rank).alias("best")).select("ticker", "best.*")


def long_term_setup(bars: DataFrame, patterns: DataFrame, rise_pct: float = 3.0, min_quality: float = 0.75, min_bars: int = 40) -> DataFrame:
    """A higher low, and a good bullish pattern; with the reasons."""
    low = alternating(swings(bars)).where("kind = 'T'")
    by = Window.partitionBy("ticker").orderBy(F.desc("idx"))
    two = low.withColumn("_r", F.row_number().over(by)).where("_r <= 2").groupBy("ticker").agg(
        F.max(F.when(F.col("_r") == 1, F.col("price"))).alias("last"), F.max(F.when(F.col("_r") == 2, F.col("price"))).alias("before")
    )
    best = patterns.where("direction = 'bullish'").groupBy("ticker").agg(F.max("quality").alias("quality"), F.max_by("pattern", F.struct("quality", "end_index", "pattern")).alias("pattern"))
    out = bars.groupBy("ticker").count().join(two, "ticker", "left").join(best, "ticker", "left")
    up = F.coalesce(F.col("last") >= F.col("before") * (1 + rise_pct / 100), F.lit(False))
    good = F.coalesce(F.col("quality") >= min_quality, F.lit(False))
    reasons = F.array(
        F.when(up, "Higher-low swing structure confirmed").otherwise("No confirmed higher-low swing structure yet"),
        F.when(good, F.concat("pattern", F.lit(" match"))).otherwise("No bullish pattern match at required quality"),
    )
    return out.select("ticker", ((F.col("count") >= min_bars) & up & good).alias("confirmed"), reasons.alias("reasons"))


def analog_match(bars: DataFrame, window: int = 15, horizon: int = 5, min_sim: float = 0.6, top: int = 5, min_bars: int = 25) -> DataFrame:
    """The latest window against all earlier ones of the ticker, z-scored; what followed the best of them.

    One row per ticker with a match: confidence, projected_pct, sample_size, dispersion and percentiles.
    """
    at = range(window)
    total = lambda xs: reduce(lambda s, x: s + x, xs, F.lit(0.0))
    df = numbered(bars).withColumns({f"_x{i}": F.lag("close", window - 1 - i).over(w()) for i in at} | {"_future": F.lead("close", horizon).over(w())})
    df = df.where((F.col("idx") >= window - 1) & (F.col("n") >= max(window + horizon, min_bars)))
    df = df.withColumn("_m", total(F.col(f"_x{i}") for i in at) / window)
    df = df.withColumn("_sd", F.sqrt(total((F.col(f"_x{i}") - F.col("_m")) * (F.col(f"_x{i}") - F.col("_m")) for i in at) / window) + 1e-8)
    z = F.array(*[(F.col(f"_x{i}") - F.col("_m")) / F.col("_sd") for i in at])
    df = df.withColumn("_now", F.first(F.when(F.col("idx") == F.col("n") - 1, z), ignorenulls=True).over(every()))
    # neither the window nor what followed it may reach into the latest window
    past = df.where(F.col("idx") + horizon < F.col("n") - window)
    sim = total((F.col(f"_x{i}") - F.col("_m")) / F.col("_sd") * F.col("_now")[i] for i in at) / window
    past = past.select("ticker", "idx", sim.alias("sim"), ((F.col("_future") - F.col("close")) / F.col("close")).alias("ret"))
    ranked = past.withColumn("_r", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("sim"), "idx"))).where((F.col("_r") <= top) & (F.col("sim") >= min_sim))
    out = ranked.groupBy("ticker").agg(
        F.avg("sim").alias("avg_sim"), F.avg("ret").alias("avg_ret"), F.stddev_pop("ret").alias("dispersion"), F.count("*").alias("sample_size"),
        F.sqrt(F.avg(F.pow(F.least("ret", F.lit(0.0)), 2))).alias("downside"), F.percentile("ret", 0.05).alias("low"), F.percentile("ret", 0.95).alias("high"),
    )
    agreement = F.greatest(F.lit(0.0), 1 - F.least(F.col("dispersion") * 5, F.lit(0.5)))
    penalty = F.greatest(F.lit(0.5), 1 - F.col("downside") * 5)
    return out.select(
        "ticker", (F.col("avg_sim") * 100 * agreement * penalty).alias("confidence"), (F.col("avg_ret") * 100).alias("projected_pct"), "sample_size",
        (F.col("dispersion") * 100).alias("dispersion_pct"), (F.col("low") * 100).alias("lower_95_pct"), (F.col("high") * 100).alias("upper_95_pct"),
    )
