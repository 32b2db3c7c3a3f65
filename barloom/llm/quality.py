"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

A document's own evidence is a logistic model over measures of its text; one of
the measures is the strongest entry of a lexicon of words that mark rejected
documents, itself shrunk toward the global rate. Its soft votes are summed by
host and by path (grouped aggregation over all documents); each path's rate is
shrunk toward its host's, each host's toward the global rate, by a prior
strength taken from the spread of the rates. A document's verdict adds the
log-odds of its path (without its own vote) to its evidence.

Model and lexicon are fitted on at most ``SAMPLE`` labelled rows, chosen by a
hash of the id; everything else covers all rows.

Edge cases: null texts, empty ones and those of white space alone are rejected;
a null host or path is a site of its own; unlabelled tables, or labels of one
class only, keep every document that has a word; documents without a label are
judged like all others. Repeated rows vote and are judged each; a very long text
is measured whole; an empty table gives no rows; log-odds of 0 reject; columns
of any name are carried, ``_judged`` and ``_measures`` apart.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import WORD, materialize, small_batches, table

#: Labelled rows that are used for fitting, at most.
SAMPLE = 20_000
#: Words of the lexicon, at most; the strongest are taken.
LEXICON = 5_000
#: Labelled documents with different texts that must hold a word.
SUPPORT = 8
#: Weight, in documents, of the global rate in a word's rate.
WORD_PRIOR = 10.0
#: Sites up to this many (about 60 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_SITES = 100_000

FEATURES = ("upper", "symbols", "digits", "distinct", "top_word", "repeats", "marks", "pipes", "word_len", "log_words", "lexicon")
_WORD = re.compile(WORD)
_EDGE = ".,;:!?\"'()[]"


def measures(text: str, lexicon: dict[str, float]) -> list[float]:
    words = _WORD.findall(text)
    n, chars = len(words), max(len(text), 1)
    if not n:
        return [0.0] * len(FEATURES)
    counts = Counter(words)
    letters = sum(map(str.isalpha, text)) or 1
    lower = [w.strip(_EDGE).lower() for w in counts]
    marks = sum(c for w, c in counts.items() if len(w) > 2 and not w[-1].isalnum() and not w[-2].isalnum())
    return [
        sum(map(str.isupper, text)) / letters,
        (chars - letters - sum(map(str.isspace, text))) / chars,
        sum(map(str.isdigit, text)) / chars,
        len(counts) / n,
        max(counts.values()) / n if n >= 10 else 0.0,
        sum(a == b for a, b in zip(words, words[1:])) / n,
        marks / n,
        counts.get("|", 0) / n,
        min(len(text) / n, 30.0) / 10,
        float(np.log1p(n)) / 10,
        max((lexicon.get(w, 0.0) for w in lower), default=0.0),
    ]


def _measured(text: Column, lexicon) -> Column:
    """The array of measures; ``lexicon`` is a broadcast dict."""

    @F.pandas_udf("array<double>")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = lexicon.value
        for texts in batches:
            yield pd.Series([measures(t, words) if isinstance(t, str) else [0.0] * len(FEATURES) for t in texts])

    return udf(text)


class Classifier:
    """Fitted document model: weights over ``FEATURES``, intercept, lexicon."""

    def __init__(self, spark, weights, intercept: float, lexicon: dict[str, float], base: float):
        self.weights, self.intercept, self.base = weights, intercept, base
        self.lexicon = spark.sparkContext.broadcast(lexicon)

    def evidence(self, measured: Column, text: Column) -> Column:
        logit = F.lit(float(self.intercept))
        for i, w in enumerate(self.weights):
            logit = logit + measured[i] * F.lit(float(w))
        empty = ~F.coalesce(text, F.lit("")).rlike(WORD)
        return F.when(empty, F.lit(-20.0)).otherwise(F.greatest(F.least(logit, F.lit(20.0)), F.lit(-20.0)))


def fit_lexicon(labelled: DataFrame, base: float) -> dict[str, float]:
    """Words that mark rejected documents, with their shrunk log-odds over the global rate.

    ``labelled``: text, good. Equal texts count once.
    """
    texts = labelled.groupBy(F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"), F.min("good").alias("good"))
    words = F.transform(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: F.lower(F.btrim(w, F.lit(_EDGE))))
    rows = texts.select("good", F.explode(F.array_distinct(words)).alias("word")).where("word <> ''")
    counts = rows.groupBy("word").agg(F.count("*").alias("n"), F.sum(1 - F.col("good")).alias("bad")).where(F.col("n") >= SUPPORT)
    rate = (F.col("bad") + WORD_PRIOR * (1 - base)) / (F.col("n") + WORD_PRIOR)
    odds = F.log(rate / (1 - rate)) - float(np.log((1 - base) / base))
    best = counts.select("word", odds.alias("odds")).where("odds > 1.0").orderBy(F.desc("odds"), "word").limit(LEXICON)
    return {r["word"]: r["odds"] for r in best.collect()}


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Classifier:
    """A document is good if its quality label is 1 and it is not labelled toxic."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    spark = docs.sparkSession
    small_batches(spark)
    good = ((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).cast("int")
    marked = labels.where("quality is not null").select(F.col(id_col).alias("id"), good.alias("good"))
    n, of = marked.agg(F.count("*"), F.sum("good")).head()
    if not n or not of or of == n:
        return Classifier(spark, [0.0] * len(FEATURES), 5.0, {}, 0.5)
    span = 1 << 20
    part = marked.where(F.pmod(F.xxhash64("id"), F.lit(span)) < int(min(1.0, sample / n) * span))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = materialize(texts.join(F.broadcast(part), "id").select("text", "good"), "labelled")  # at most about SAMPLE ids
    found, right = rows.agg(F.count("*"), F.sum("good")).head()  # labels may be of other documents
    if not found or not right or right == found:
        return Classifier(spark, [0.0] * len(FEATURES), 5.0, {}, 0.5)
    base = of / n
    model = Classifier(spark, [], 0.0, fit_lexicon(rows, base), base)
    data = rows.select(array_to_vector(_measured(F.col("text"), model.lexicon)).alias("features"), F.col("good").cast("double").alias("label"))
    data = materialize(data, "features").coalesce(4)
    lr = LogisticRegression(maxIter=60, regParam=1e-4, standardization=True).fit(data)
    model.weights, model.intercept = lr.coefficients.toArray().tolist(), float(lr.intercept)
    return model


def _strength(rates: DataFrame, mean: float) -> float:
    """Prior strength in documents: the spread of the sites' rates beyond that of their size."""
    v = rates.agg(
        F.sum(F.col("n") * (F.col("votes") / F.col("n") - mean) ** 2).alias("between"),
        F.sum("n").alias("n"),
        F.sum(F.lit(1)).alias("sites"),
        F.sum(F.col("spread")).alias("spread"),
    ).head()
    if not v["n"] or v["sites"] < 2:
        return 1e6
    within = max(v["spread"] / v["n"], 1e-9)  # variance of one vote
    extra = (v["between"] - within * (v["sites"] - 1)) / v["n"]
    return float(min(max(within / extra, 2.0), 1e6)) if extra > 0 else 1e6


def site_rates(votes: DataFrame) -> tuple[DataFrame, float, float]:
    """Sites (host, path, n, votes, host_rate), the global rate and the strength of a path's prior.

    ``votes``: host, path, vote.
    """
    sums = [F.count("*").alias("n"), F.sum("vote").alias("votes"), F.sum(F.col("vote") ** 2).alias("squares")]
    paths = materialize(votes.groupBy("host", "path").agg(*sums), "sites")
    spread = F.greatest(F.col("squares") - F.col("votes") ** 2 / F.col("n"), F.lit(0.0)).alias("spread")
    total = paths.agg(F.sum("votes"), F.sum("n")).head()
    mean = total[0] / total[1] if total[1] else 0.5
    by_host = paths.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("n", "votes", "squares")])
    host_prior = _strength(by_host.select("n", "votes", spread), mean)
    path_prior = _strength(paths.select("n", "votes", spread), mean)
    hosts = by_host.select(F.col("host").alias("h"), ((F.col("votes") + host_prior * mean) / (F.col("n") + host_prior)).alias("host_rate"))
    sites = paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).select("host", "path", "n", "votes", "host_rate")
    return materialize(sites, "rates"), mean, path_prior


def judge(docs: DataFrame, model: Classifier, host: Column, path: Column, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` of ``docs`` (all if None) with a struct ``_judged``: evidence, host_rate, path_rate, p_good, keep.

    The evidence is computed in one pass over the texts and written beside the
    carried columns; sites are summed from what is written and joined to it.
    """
    small_batches(docs.sparkSession)
    carry = docs.columns if carry is None else carry
    text = F.col(text_col).cast("string")
    own = [docs[c] for c in carry]
    mine = F.struct(model.evidence(F.col("_measures"), text).alias("evidence"), host.cast("string").alias("host"), path.cast("string").alias("path"))
    voted = materialize(docs.withColumn("_measures", _measured(text, model.lexicon)).select(*[c.alias(f"c{i}") for i, c in enumerate(own)], mine.alias("m")), "evidence")
    vote = 1 / (1 + F.exp(-F.col("m.evidence")))
    sites, mean, prior = site_rates(voted.select("m.host", "m.path", vote.alias("vote")))
    if sites.count() <= BROADCAST_SITES:
        sites = F.broadcast(sites)
    both = voted.join(sites, F.col("m.host").eqNullSafe(F.col("host")) & F.col("m.path").eqNullSafe(F.col("path")), "left")
    path_rate = (F.col("votes") - vote + prior * F.col("host_rate")) / (F.col("n") - 1 + prior)
    path_rate = F.least(F.greatest(path_rate, F.lit(1e-6)), F.lit(1 - 1e-6))
    mean = min(max(mean, 1e-6), 1 - 1e-6)
    site = F.log(path_rate / (1 - path_rate)) - float(np.log(mean / (1 - mean)))
    logit = F.col("m.evidence") + site  # bounded by the site's own size: its rate is shrunk by the prior
    judged = F.struct(
        F.col("m.evidence").alias("evidence"),
        F.col("host_rate").alias("host_rate"),
        path_rate.alias("path_rate"),
        (1 / (1 + F.exp(-logit))).alias("p_good"),
        (logit > 0).alias("keep"),
    )
    return both.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], judged.alias("_judged"))


def op6_site_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    model = fit(docs, table(spark, sf_dir, "labels"))
    out = judge(docs, model, F.col("source"), F.col("lang"), carry=["doc_id", "source", "lang"])
    return out.select("doc_id", F.col("source").alias("host"), F.col("lang").alias("path"), "_judged.*")
