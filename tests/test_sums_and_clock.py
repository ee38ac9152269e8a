"""Sums that must not depend on the order of rows, and a clock that must not stand within a long table."""

import duckdb
import pytest
from pyspark.sql import functions as F

from storyloom.plans import facts, reports  # noqa: F401
from storyloom.plans.registry import QUERIES, SQL

#: Added one after the other, in doubles, both come out a little under 217.8 and 250.05.
HALF, NET = (67.42, 35.05, 61.73, 53.6), (48.53, 24.93, 16.47, 63.85, 41.54, 54.73)


def events(spark, folder, values):
    rows = [(i, u, "view", v) for u, vs in enumerate((values, sorted(values), sorted(values, reverse=True))) for i, v in enumerate(vs)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_a_mean_on_a_half_is_the_same_in_any_order(spark, tmp_path):
    got = QUERIES["run_metrics"](spark, events(spark, tmp_path, HALF)).collect()
    assert [r["mean"] for r in got] == [54.5] * 3


def test_a_net_on_a_bound_is_the_same_in_any_order(spark, tmp_path):
    got = QUERIES["learned_levels"](spark, events(spark, tmp_path, NET)).collect()
    want = duckdb.connect().execute("SELECT abs(round_even(250.05::DOUBLE / 100 - 3, 3)) >= 0.5").fetchone()[0]
    assert len(got) == (3 if want else 0)


def test_values_that_fit_no_decimal_are_summed_as_they_are(spark):
    from storyloom.functions.columns import exact_sum

    rows = [("a", 1.5), ("a", None), ("b", 1e300), ("b", 1.0), ("c", float("inf")), ("d", None), ("e", float("nan"))]
    df = spark.createDataFrame(rows, "k string, v double").groupBy("k").agg(exact_sum(F.col("v")).alias("s"))
    got = {r.k: r.s for r in df.collect()}
    assert got.pop("e") != got.get("e") and got == {"a": 1.5, "b": 1e300, "c": float("inf"), "d": None}


@pytest.mark.parametrize("last", [10, 400_000])
def test_no_article_is_recent_after_the_last_one(spark, tmp_path, last):
    rows = [(i, "text", "en", "s", 4) for i in (0, 1, 175_300, last)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.article_id, r.fallback) for r in QUERIES["recent_or_all"](spark, str(tmp_path)).collect())
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert len(got) == 4 and got == sorted(c.execute(SQL["recent_or_all"]).fetchall())
