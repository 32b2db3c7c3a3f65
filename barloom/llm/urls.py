"""URL filters: host/path rules, then pattern rules behind a token index.

Host and path rules are prefix rules on the parsed URL; the longest rule that
fits decides. URLs without such a rule go to pattern rules. A pattern rule names
literal tokens that each URL it matches must contain, as groups of alternatives:
of each group the URL holds at least one. It is indexed by the group that is
rarest in the URLs at hand. The index is a hash table of tokens in one constant
of the plan: a URL's tokens fetch the numbers of the candidate rules from it,
and only those run their regular expression. Without a token there is no
candidate, so a rule without tokens is an error.

DataFrame functions only, one path for any number of rules, no join and no
shuffle of URLs. The rules are an argument, held by the driver; above
``MAX_RULE_BYTES`` of text they are refused, as they travel with the plan.

Edge cases: a null URL, or one without ``://``, has an empty host and path, fits
no host rule and is allowed unless a pattern rule matches its text. Repeated
rows, and rows with equal or null keys, are judged each; an empty table gives no
rows; of several matching pattern rules the first in the list decides; a very
long URL is read whole; other columns may have any name.
"""

from __future__ import annotations

import json
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import ascii_lower

#: Patterns and tokens of a rule set, in bytes, at most.
MAX_RULE_BYTES = 16_000_000


@dataclass(frozen=True)
class HostRule:
    action: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class PatternRule:
    """``tokens``: groups of lower-case alphanumeric tokens; a matching URL holds one of each group (a string is a group of one)."""

    action: str
    pattern: str
    tokens: tuple[str | tuple[str, ...], ...]

    @property
    def groups(self) -> list[tuple[str, ...]]:
        return [(t,) if isinstance(t, str) else tuple(t) for t in self.tokens]


HOST_RULES = (
    HostRule("block", "net", "/"),
    HostRule("allow", "example.net", "/en/"),
    HostRule("block", "example.com", "/de/"),
    HostRule("allow", "org", "/fr/"),
)
PATTERN_RULES = (
    PatternRule("block", r"[?&]utm_(source|medium|campaign)=", ("utm", ("source", "medium", "campaign"))),
    PatternRule("block", r"/ads?/(banner|click)[/.]", (("ad", "ads"), ("banner", "click"))),
    PatternRule("block", r"[?&]sessionid=[0-9a-f]+", ("sessionid",)),
    PatternRule("block", r"^https?://([^/]*\.)?doubleclick\.net/", ("doubleclick", "net")),
    PatternRule("block", r"\.(exe|zip|iso)([?#]|$)", (("exe", "zip", "iso"),)),
    PatternRule("block", r"/wp-login\.php", ("wp", "login", "php")),
)


def parse_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def host_rule(host: Column, path: Column, rules=HOST_RULES) -> tuple[Column, Column]:
    """Text and action of the longest rule that fits; null where none does."""
    text, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, action = F.when(fits, F.lit(r.text)).otherwise(text), F.when(fits, F.lit(r.action)).otherwise(action)
    return text, action


def url_tokens(url: Column) -> Column:
    return F.array_remove(F.array_distinct(F.split(ascii_lower(F.coalesce(url, F.lit(""))), "[^a-z0-9]+")), "")


def rarest_token_index(urls: DataFrame, url_col: str, rules) -> list[tuple[str, ...]]:
    """Each rule's rarest group of tokens.

    The counts cover all URLs; only the rules' own tokens are counted, so the
    result that reaches the driver has at most one row per rule token.
    """
    if any(not r.groups or not all(r.groups) for r in rules):
        raise ValueError("a pattern rule needs a token that its URLs hold")
    wanted = sorted({t for r in rules for g in r.groups for t in g})
    counts: dict[str, int] = {}
    if any(len(r.groups) > 1 for r in rules):
        held = F.array_intersect(url_tokens(F.col(url_col)), F.lit(wanted))
        counts = {r["token"]: r["count"] for r in urls.select(F.explode(held).alias("token")).groupBy("token").count().collect()}
    return [min(r.groups, key=lambda g: (sum(counts.get(t, 0) for t in g), g)) for r in rules]


def _constant(value, ddl: str) -> Column:
    """A nested constant; the optimizer folds it once."""
    return F.from_json(F.lit(json.dumps(value)), ddl)


def pattern_action(url: Column, rules, index: list[tuple[str, ...]]) -> Column:
    """The action of the first rule, in list order, that matches; null if none. Only rules that the URL's tokens fetch are run."""
    if not rules:
        return F.lit(None).cast("string")
    entries: dict[str, list[int]] = {}
    for i, tokens in enumerate(index):
        for t in tokens:
            entries.setdefault(t, []).append(i)
    slots = 1 << max(2 * len(entries), 1).bit_length()
    places: list[list] = [[] for _ in range(slots)]
    for t, own in entries.items():
        places[zlib.crc32(t.encode()) % slots].append({"t": t, "r": own})
    if sum(len(r.pattern) for r in rules) + sum(map(len, entries)) > MAX_RULE_BYTES:
        raise ValueError(f"rules over {MAX_RULE_BYTES} bytes: pass them in parts")
    held = _constant(places, "array<array<struct<t:string,r:array<int>>>>")
    texts = _constant([{"p": r.pattern, "a": r.action} for r in rules], "array<struct<p:string,a:string>>")

    def fetched(token: Column) -> Column:
        place = F.get(held, F.crc32(token.cast("binary")) % slots)
        return F.flatten(F.transform(F.filter(place, lambda e: e["t"] == token), lambda e: e["r"]))

    candidates = F.array_sort(F.array_distinct(F.flatten(F.transform(url_tokens(url), fetched))))
    hits = F.filter(candidates, lambda i: F.rlike(url, F.get(texts, i)["p"]))
    return F.get(texts, F.get(hits, F.lit(0)))["a"]


def judge_urls(df: DataFrame, key: str = "page_id", url_col: str = "url", host_rules=HOST_RULES, pattern_rules=PATTERN_RULES) -> DataFrame:
    """Key, host, path, rule and verdict of every row."""
    slim = df.select(F.col(key).alias("_k"), F.col(url_col).cast("string").alias("_u"))
    index = rarest_token_index(slim, "_u", pattern_rules)
    host, path = parse_url(F.col("_u"))
    parsed = slim.select("_k", "_u", host.alias("host"), path.alias("path"))
    rule, action = host_rule(F.col("host"), F.col("path"), host_rules)
    verdict = F.coalesce(action, pattern_action(F.col("_u"), pattern_rules, index), F.lit("allow"))
    return parsed.select(F.col("_k").alias(key), "host", "path", rule.alias("rule"), verdict.alias("verdict"))


def op8_url_rules(spark, sf_dir: str) -> DataFrame:
    from ._common import table

    return judge_urls(table(spark, sf_dir, "pages"))


def _sql() -> str:
    fits = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    longest = sorted(HOST_RULES, key=lambda r: -len(r.text))
    rule = " ".join(f"WHEN {fits(r)} THEN '{r.text}'" for r in longest)
    verdict = " ".join(f"WHEN {fits(r)} THEN '{r.action}'" for r in longest)
    patterns = " ".join(f"WHEN regexp_matches(url, '{r.pattern}') THEN '{r.action}'" for r in PATTERN_RULES)
    return f"""
WITH a AS (
  SELECT page_id, coalesce(url, '') AS url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), b AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a
)
SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} {patterns} ELSE 'allow' END AS verdict FROM b
"""


OP8_SQL = _sql()
