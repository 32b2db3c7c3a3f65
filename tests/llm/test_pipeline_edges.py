"""The pipeline's stages on null, empty, repeated and very long texts, and on an empty table."""

import corpus_pipeline as cp

SF = "/root/testdata/sf0.001"


def test_stages_on_odd_documents(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 60").head()["text"]
    prose = [r["text"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1 and toxic = 0").join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").orderBy("doc_id").limit(12).select("text").collect()]
    long = " ".join(prose * 40)
    rows = [(1, None), (2, ""), (3, " \n "), (4, long), (5, long), (6, prose[0]), (6, prose[0]), (7, f"{prose[1]} {item} {prose[2]}"), (8, f"{prose[3]} password = Zx9Qw3Rt7Yp1Lk5J")]
    docs = spark.createDataFrame([(i, t, None, None, len(t or ""), 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, component_id int")
    stages = dict(cp.STAGES)
    judged = stages["quality"](spark, docs, SF)
    assert judged.columns == docs.columns and not {1, 2, 3} & {r["doc_id"] for r in judged.collect()}
    near = stages["near_duplicates"](spark, docs, SF)
    assert near.columns == docs.columns and sorted(r["doc_id"] for r in near.collect()) == [1, 2, 3, 4, 6, 7, 8]
    clean = stages["decontaminate"](spark, docs, SF)
    assert clean.columns == docs.columns and 7 not in {r["doc_id"] for r in clean.collect()} and clean.where("doc_id = 6").count() == 2
    hidden = {r["doc_id"]: r["text"] for r in stages["secrets"](spark, docs, SF).collect()}
    assert hidden[1] is None and hidden[8].endswith("[SECRET]") and hidden[6] == prose[0]
    packed = stages["packing"](spark, docs, SF).groupBy("doc_id").count().collect()
    assert {r["doc_id"] for r in packed} == set(range(1, 9))


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0, name
