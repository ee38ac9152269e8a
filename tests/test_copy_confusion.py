"""Copies in groups of any size count, as in the SQL."""

import duckdb

from storyloom.operators import metrics as M
from storyloom.plans.registry import QUERIES, SQL


def test_groups_of_more_than_fifty_copies_count(spark, tmp_path):
    texts = ["the same long report"] * 60 + ["match alpha", "match alpha", "match alpha beta", None, None]
    # Pairs are sought within a kind of event, which the view deals by sixes: the last rows are of one kind.
    rows = [(i if i < 60 else 6 * i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["truth_pair_confusion"](spark, str(tmp_path)).first()
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert (got.tp, got.fp, got.fn) == c.execute(SQL["truth_pair_confusion"]).fetchone() == (1, 2, 1770)


def test_nulls_repeats_and_nothing(spark):
    owners = spark.createDataFrame([("a", "x"), ("b", "x"), ("b", "x"), ("c", "x"), ("d", None), ("e", None), (None, "x")], "article_id string, h string")
    pairs = spark.createDataFrame([("a", "b"), ("a", "b"), ("d", "e"), ("a", "z")], "a_id string, b_id string")
    assert tuple(M.copy_confusion(pairs, owners).first()) == (1, 2, 2)
    assert tuple(M.copy_confusion(pairs.limit(0), owners.limit(0)).first()) == (0, 0, 0)
