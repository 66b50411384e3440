from pyspark.sql import functions as F

from sylvaframe.llm.labelled import labelled_sample


def test_labels_of_other_documents_take_no_places(spark):
    docs = spark.range(0, 1000, 50).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    docs = docs.union(docs.limit(2)).union(spark.createDataFrame([(None, "x")], "doc_id bigint, text string"))
    labels = spark.range(1000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("toxic"))
    got = [r.doc_id for r in labelled_sample(docs, labels, "toxic", F.lit(True), 20).select("doc_id").collect()]
    assert set(got) == set(range(0, 1000, 50)) and len(got) == 20
    few = labelled_sample(docs, labels, "toxic", F.lit(True), 7).select("doc_id").distinct()
    least = labels.where("doc_id % 50 = 0").orderBy(F.xxhash64("doc_id")).limit(7)
    assert {r.doc_id for r in few.collect()} == {r.doc_id for r in least.collect()}


def test_rows_that_share_an_id_are_one_example(spark):
    docs = spark.range(500).select(F.lit(7).alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    labels = spark.createDataFrame([(7, 1)], "doc_id bigint, toxic int")
    got = labelled_sample(docs, labels, "toxic", F.lit(True), 1).collect()
    assert [(r.doc_id, r.label) for r in got] == [(7, 1)]
    assert got[0].text == docs.orderBy(F.xxhash64("text")).head().text
