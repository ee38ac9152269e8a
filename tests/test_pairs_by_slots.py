"""Pairs found slot by slot equal those found by holding every article against every other."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from storyloom.operators import similarity as P

BASE = datetime(2024, 1, 1)
SCHEMA = "article_id string, event_type string, published_at timestamp, room string, tokens array<string>"


def articles(n=150, words=40):
    rng = random.Random(7)
    rows = []
    for i in range(n):
        hours = rng.choice((0, 48, 96, -48, 12, 13, 300)) + rng.choice((0, 0, 1, -1))
        rows.append((f"x{rng.randrange(10**6):06}", rng.choice(("signing", "injury")), BASE + timedelta(hours=hours), rng.choice("pq"), sorted({f"w{int(rng.random() ** 2 * words)}" for _ in range(rng.randrange(9))})))
    rows += [("none", None, BASE, "p", ["w1"]), ("when", "injury", None, "p", ["w1", "w2"]), (None, "injury", BASE, "p", ["w1"]), ("null", "injury", BASE, "p", None)]
    return [*rows, rows[3]]  # one article twice


def wanted(rows, most_df, ratio, generic, least):
    df = {}
    for r in rows:
        for t in r[4] or []:
            df[t] = df.get(t, 0) + 1
    rare = {t for t, k in df.items() if (k <= most_df or k <= len(rows) * ratio) and t not in generic}
    met = [(a, b) for a in rows for b in rows if None not in (a[0], b[0], a[1], a[2], b[2]) and a[1] == b[1] and a[0] < b[0] and abs(a[2] - b[2]) <= timedelta(hours=48)]
    n_rare = {}
    for a, b in met:
        n_rare[a[0], b[0]] = n_rare.get((a[0], b[0]), 0) + len(rare & set(a[4] or []) & set(b[4] or []))
    out = []
    for a, b in met:
        shared, union = len(set(a[4] or []) & set(b[4] or [])), len(set(a[4] or []) | set(b[4] or []))
        if n_rare[a[0], b[0]] and (not least or shared / union >= least):
            out.append((a[0], b[0], n_rare[a[0], b[0]], shared, len(a[4]), len(b[4]), a[3], b[3], a[2], b[2]))
    return sorted(out)


@pytest.mark.parametrize("most_met,words,least", [(2048, 40, 0.0), (5, 40, 0.0), (1, 30, 0.3), (2048, 400, 0.25)])
def test_pairs_equal_all_against_all(spark, most_met, words, least):
    rows = articles(words=words)
    df = spark.createDataFrame(rows, SCHEMA)
    got = P.candidate_pairs(df, most_df=20, df_ratio=0.05, generic=("w5", "w7"), least=least, kept=("room",), most_met=most_met)
    got = got.select("a_id", "b_id", "n_rare", "shared", "n_a", "n_b", "a.room", F.col("b.room"), "a.published_at", F.col("b.published_at"))
    want = wanted(rows, 20, 0.05, ("w5", "w7"), least)
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 5


def test_no_row_per_token_or_pair_is_shuffled(spark):
    plan = P.candidate_pairs(spark.createDataFrame(articles(), SCHEMA))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode(words" not in plan and "Inner" not in plan


def test_a_prefixed_generic_word_is_generic(spark):
    rows = [("a", "injury", BASE, "p", ["והליגה"]), ("b", "injury", BASE, "p", ["והליגה"])]
    df = spark.createDataFrame(rows, SCHEMA)
    assert P.candidate_pairs(df).count() == 1
    assert P.candidate_pairs(df, generic=("הליגה",)).count() == 0
