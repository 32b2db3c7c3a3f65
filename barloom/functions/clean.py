"""Cleaning of text fields: prices, volumes, dates, names (Column builders)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import NO_SECTOR


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def number(x) -> Column:
    """Commas and percent signs removed, blanks null, sign kept."""
    # of the cells that mean "no value" (empty, -, --, nan, none, n/a) only nan would be read as a number
    return F.nanvl(F.trim(F.translate(_c(x).cast("string"), ",%", "")).try_cast("double"), F.lit(None).cast("double"))


def positive(x) -> Column:
    n = _c(x)
    return F.when(n > 0, n)


def price(x) -> Column:
    """B1: as ``number``; zero and below are null."""
    return positive(number(x))


def volume(x) -> Column:
    """B2: as ``number``; null and negative are 0."""
    return F.greatest(F.coalesce(number(x), F.lit(0.0)), F.lit(0.0))


#: B4, fixed.
RATINGS = {"strong sell": -2, "sell": -1, "neutral": 0, "buy": 1, "strong buy": 2}


def rating(x) -> Column:
    pairs = [v for k, s in RATINGS.items() for v in (F.lit(k), F.lit(s))]
    return F.element_at(F.create_map(*pairs), F.lower(F.trim(_c(x))))


def consensus(*scores) -> Column:
    """Mean of the scores there are, to three places."""
    have = F.array_compact(F.array(*[_c(s).cast("double") for s in scores]))
    return F.when(F.size(have) > 0, F.bround(F.aggregate(have, F.lit(0.0), lambda a, x: a + x) / F.size(have), 3))


def feed_date(x, as_of) -> Column:
    """Spreadsheet serials (30001 to 69999), ISO dates, then month-first dates; beyond as-of + 2 days null (L2)."""
    t = F.trim(_c(x).cast("string"))
    n = t.try_cast("double")
    serial = F.when((n > 30_000) & (n < 70_000), F.date_add(F.lit("1899-12-30").cast("date"), n.cast("int")))
    # no number is an ISO date: most cells need one look
    other = F.when(n.isNotNull(), serial).otherwise(F.coalesce(F.try_to_date(t, "M/d/yyyy"), F.try_to_date(t, "d/M/yyyy")))
    day = F.coalesce(F.try_to_date(t, "yyyy-MM-dd"), other)
    return F.when(day <= F.date_add(F.lit(as_of).cast("date"), 2), day)


def us_date(x) -> Column:
    """Strictly month/day/year."""
    t = F.trim(_c(x))
    return F.when(t.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date(t, "M/d/yyyy"))


def suffixed_volume(x) -> Column:
    """263.53K is 263530; K, M and B; anything else 0."""
    t = F.upper(F.trim(F.regexp_replace(_c(x).cast("string"), ",", "")))
    n = F.regexp_extract(t, r"^([0-9]*\.?[0-9]+)([KMB]?)$", 1).try_cast("double")
    unit = F.regexp_extract(t, r"^([0-9]*\.?[0-9]+)([KMB]?)$", 2)
    scale = F.when(unit == "K", 1e3).when(unit == "M", 1e6).when(unit == "B", 1e9).otherwise(1.0)
    return F.coalesce(F.rint(n * scale), F.lit(0.0))


def sanitize(x, longest: int = 200) -> Column:
    """No control or direction marks, no markup, no formula prefix; at most ``longest`` characters."""
    t = F.regexp_replace(_c(x), r"(?is)<script.*?>.*?</script>", "")
    t = F.regexp_replace(t, r"(?i)javascript:", "")
    t = F.regexp_replace(t, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F‎‏‪-‮⁦-⁩]", "")
    t = F.regexp_replace(t, r"[<>`]", "")
    t = F.replace(F.replace(F.replace(t, F.lit("'"), F.lit("’")), F.lit('"'), F.lit("'")), F.lit("&"), F.lit("and"))
    t = F.trim(t)
    return F.substring(F.when(t.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), t)).otherwise(t), 1, longest)


def symbol(x) -> Column:
    """Upper case; short ones without a dot get the market's suffix."""
    t = F.upper(F.trim(_c(x)))
    return F.when((F.length(t) <= 6) & ~t.contains("."), F.concat(t, F.lit(".CA"))).otherwise(t)


#: The first rule with a matching word wins. Fixed, in this order.
SECTOR_RULES = (
    (("food+beverag",), "Food, Beverages & Tobacco"),
    (("textile", "durables"), "Textiles & Durables"),
    (("it,", "communication", "media", "technology"), "IT, Media & Communication Services"),
    (("industrial goods", "automobiles"), "Industrial Goods, Services & Automobiles"),
    (("construction", "contracting", "engineering"), "Construction & Engineering"),
    (("health", "pharma", "medical"), "Health Care & Pharmaceuticals"),
    (("basic resources", "mining", "steel"), "Basic Resources"),
    (("building materials", "cement", "porcelain"), "Building Materials"),
    (("travel", "leisure", "hotels", "tourism"), "Travel & Leisure"),
    (("shipping", "transportation", "cargo"), "Shipping & Transportation Services"),
    (("trade", "distributor"), "Trade & Distributors"),
    (("energy", "support services", "oil"), "Energy & Support Services"),
    (("education",), "Education Services"),
    (("paper", "packaging"), "Paper & Packaging"),
    (("banks", "banking"), "Banks"),
    (("real estate", "housing", "development"), "Real Estate"),
    (("chemical", "fertilizer"), "Chemicals"),
    (("utilities", "gas"), "Utilities"),
)


#: Spellings that are made one before the rules are looked at. Fixed, in this order.
SECTOR_SPELLINGS = (
    (" and ", " & "),
    (" And ", " & "),
    ("Textile &", "Textiles &"),
    ("Non-bank", "Non-Bank"),
    ("financial services", "Financial Services"),
    ("Contracting & Construction", "Construction"),
)


def sector_name(x) -> Column:
    t = F.trim(_c(x))
    blank = t.isNull() | F.lower(t).isin("", "nan", "none", "n/a", "null")
    t = F.regexp_replace(t, r"(?U)\s+,\s+", ", ")
    for old, new in SECTOR_SPELLINGS:
        t = F.replace(t, F.lit(old), F.lit(new))
    low = F.lower(t)
    out = F.when(blank, NO_SECTOR)
    out = out.when(low.rlike("^(non[- ]bank )?financial services$"), "Non-Bank Financial Services")
    for words, name in SECTOR_RULES:
        hit = F.lit(False)
        for w in words:
            every = F.lit(True)
            for part in w.split("+"):
                every = every & low.contains(part)
            hit = hit | every
        out = out.when(hit, name)
    return out.otherwise(t)


#: Words that company names share. Fixed.
NAME_STOPS = ("s.a.e", "sae", "co", "company", "egypt", "egyptian", "for", "and", "of", "the", "in", "holding", "group")


def name_tokens(x) -> Column:
    """B12."""
    low = F.replace(F.replace(F.lower(_c(x)), F.lit("_"), F.lit(" ")), F.lit("s.a.e"), F.lit("sae"))
    words = F.split(F.trim(F.regexp_replace(low, r"[^\p{L}\p{N}]+", " ")), " +")
    return F.array_except(F.array_distinct(F.filter(words, lambda w: w != "")), F.array(*[F.lit(s) for s in NAME_STOPS]))


def filename_key(x) -> Column:
    """B13."""
    t = F.regexp_replace(F.lower(_c(x)), r"\.csv$", "")
    t = F.regexp_replace(F.replace(t, F.lit("_"), F.lit(" ")), r"stock price history.*$", "")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def pattern_key(x) -> Column:
    """Parenthesis dropped, snake case."""
    t = F.lower(F.trim(F.regexp_replace(_c(x), r"\(.*?\)", "")))
    return F.regexp_replace(F.regexp_replace(F.replace(t, F.lit("&"), F.lit("and")), r"[^a-z0-9]+", "_"), r"^_|_$", "")


def swap_day_month(x) -> Column:
    """Null where the swapped date does not exist."""
    d = _c(x)
    return F.try_to_date(F.format_string("%04d-%02d-%02d", F.year(d), F.dayofmonth(d), F.month(d)), "yyyy-MM-dd")


def or_default(x, default: float) -> Column:
    """B17."""
    return F.coalesce(_c(x).try_cast("double"), F.lit(default))


def sane(x) -> Column:
    """NaN and infinities are null."""
    c = _c(x)
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
