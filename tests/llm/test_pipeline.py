import corpus_pipeline as C

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_shrink(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    columns, sizes = docs.columns, [docs.count()]
    everything = {tuple(r) for r in docs.collect()}
    for _, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns
        sizes.append(docs.count())
        assert {tuple(r) for r in docs.collect()} <= everything
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.5 * sizes[0]
    packed = C.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_nulls_and_repeats(spark):
    text = "word other thing " + " ".join(f"tok{i} and more" for i in range(40))
    rows = [(1, text, "en", "a", 1), (1, text, "en", "a", 1), (None, text, None, None, 1), (None, text + " x", None, None, 1), (3, None, "en", "a", 0), (4, "", "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = C.keep_by_rules(spark, docs, SF)
    assert kept.count() == 4
    left = C.keep_one_of_each_group(spark, kept, SF)
    assert [r.doc_id for r in left.collect()] == [1]
    assert C.drop_leaks(spark, left, SF).count() == 1
    none = docs.limit(0)
    for _, stage in C.STAGES:
        assert stage(spark, none, SF).count() == 0
