"""Corpus pipeline: quality, near duplicates, benchmark leaks, secrets, packing.

Every stage works on all documents that its predecessor kept. Stages 1 to 4
return the columns of the input; the last returns packed pieces.

* quality: documents that the site quality classifier rejects go (empty texts
  among them); without usable labels all others stay.
* near_duplicates: of documents connected by a similarity of 0.8 or more over
  five-word shingles, the one with the smallest doc_id stays; documents without
  words stay. Repeated rows (equal doc_id and text) are copies: one stays.
* decontaminate: documents whose text holds a benchmark item go.
* secrets: findings are replaced by a mark in the text, n_chars follows.
* packing: token windows, as in the packing operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm._common import materialize, small_batches, table
from barloom.llm.decontaminate import drop_contaminated
from barloom.llm.jaccard import jaccard_components
from barloom.llm.packing import pack_documents, vocabulary
from barloom.llm.quality import fit, judge
from barloom.llm.secrets import redact_secrets


#: Words that the tokenizer of the last stage remembers: its workers have run the other stages, too.
KEEP_WORDS = 250_000
#: Removed ids up to this many (8 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = fit(docs, table(spark, sf_dir, "labels"))
    judged = judge(docs, model, F.col("source"), F.col("lang"))
    return judged.where("_judged.keep").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    classes = materialize(jaccard_components(docs.select("doc_id", "text"), shingle=5, percent=80), "components")
    gone = classes.where("doc_id <> component_id").select("doc_id").distinct()
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    again = materialize(classes.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if again.isEmpty():
        return kept
    once = kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(again, "doc_id", "left_anti").unionByName(once).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    clean = docs.withColumn("text", redact_secrets(F.col("text")))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, vocabulary(), keep_words=KEEP_WORDS)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("secrets", secrets),
    ("packing", packing),
]
#: SQL cannot express the classifier, the alignment, the entropy scan or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
