import corpus_pipeline
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_only_what_they_should(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = "Now these plain words talk about a river and the town beside it where people walked every morning"
    extra = spark.createDataFrame([(9001, "1234 !!", "en", "s", 7), (9002, None, "en", "s", 0), (9003, clean, "en", "s", 98), (9003, clean, "en", "s", 98)], docs.schema)
    docs = docs.unionByName(extra).withColumn("score", F.lit(1)).cache()
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == corpus_pipeline.COLUMNS, name
        counts.append(docs.count())
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert not {9001, 9002} & ids
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.5 * counts[0]
    assert docs.where("doc_id = 9003").count() == 1
    assert docs.where("text = ''").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in docs.collect()}
