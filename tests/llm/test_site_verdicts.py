"""Verdicts of the site quality classifier that a site changes."""

from pyspark.sql import functions as F

from barloom.llm import quality


def test_a_site_rejected_throughout_takes_a_fair_document_with_it(spark):
    weights = [16.0 if f == "digits" else 0.0 for f in quality.FEATURES]
    model = quality.Classifier(spark, weights, -8.0, {}, 0.5)
    bad, fair, good = "a" * 8, "1" * 5 + "a" * 3, "1" * 8  # evidence -8, 2 and 8
    rows = [(i, "junk", bad) for i in range(300)] + [(1000 + i, "fine", good) for i in range(300)]
    rows += [(1, "junk", fair), (2, "fine", fair), (3, "new", fair)]
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = quality.judge(docs, model, F.col("source"), F.lit("en")).where("doc_id >= 600").orderBy("doc_id").select("source", "_judged.*").collect()
    assert [(r["source"], round(r["evidence"], 6)) for r in out] == [("junk", 2.0), ("fine", 2.0), ("new", 2.0)]
    assert [r["keep"] for r in out] == [False, True, True]
