from pyspark.sql import functions as F

from storyloom.llm.labelled import sample


def test_repeated_ids_do_not_multiply(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (1, None)] * 20 + [(2, "c"), (3, "d"), (None, "e"), (4, "f" * 99)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)] * 20 + [(2, 0), (3, 0), (3, 1), (None, 1), (4, 1)], "doc_id long, toxic int")
    got = sample(docs, labels, "toxic", F.lit(True), 10, 50)
    assert sorted(zip(got.texts, got.labels)) in ([("a", 1), ("c", 0)], [("b", 1), ("c", 0)])
    assert got.counts == (1, 2)
    assert sample(docs, labels, "toxic", F.lit(True), 0, 50).texts == []
