"""Operators on small frames: order, ties, nulls, invariance, and plain versions of what SQL does not say."""

import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from storyloom.functions.columns import case, decision_rank, jaccard, language_of_url, title_tokens
from storyloom.operators import articles as A
from storyloom.operators import graph as G
from storyloom.operators import learning as L
from storyloom.operators import metrics as M
from storyloom.operators import scoring as S
from storyloom.sources.tables import append_snapshot, flat_items
from storyloom.streaming.feed import append_new

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def test_columns(spark):
    row = spark.createDataFrame([("Ünïted 2-1 WIN, a win!", "https://x.org/fr/1", None)], "t string, u string, n string").select(
        title_tokens(F.col("t")).alias("t"),
        title_tokens(F.col("n")).alias("none"),
        language_of_url(F.col("u")).alias("l"),
        jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c"))).alias("j"),
        decision_rank(F.lit("push")).alias("r"),
        case(F.lit("z"), {"a": 1}, 9).alias("c"),
    ).first()
    assert (row.t, row.none, row.l, round(row.j, 4), row.r, row.c) == (["win", "ünïted"], [], "fr", 0.3333, 4, 9)


def test_dedup_keeps_the_smallest_and_counts(spark):
    rows = [(3, "a"), (1, "a"), (2, None), (5, None), (4, "")]
    got = sorted((r.id, r.n_copies) for r in A.dedup(spark.createDataFrame(rows, "id long, t string"), "t", "id").collect())
    assert got == [(1, 2), (2, 2), (4, 1)]


def test_components_of_a_long_chain_whatever_the_order(spark):
    ids = [f"n{i:03}" for i in range(60)]
    edges = list(zip(ids, ids[1:])) + [("z1", "z2"), ("z2", "z3"), ("z1", "z3")]
    random.Random(2).shuffle(edges)
    got = {r.article_id: r.component for r in G.components(spark.createDataFrame(edges, "a_id string, b_id string")).collect()}
    assert got == {**dict.fromkeys(ids, "n000"), "z1": "z1", "z2": "z1", "z3": "z1"}


def test_authority_and_guarded_levels(spark):
    rows = [(1, "team", "x", -1, "calibration", 9), (1, "team", "x", 1, "learned", 1), (1, "team", "x", 2, "learned", 2), (1, "team", "y", 0, "explicit", 0), (1, "team", "y", 2, "learned", 5)]
    got = sorted((r.target, r.level) for r in L.effective(spark.createDataFrame(rows, "user_id int, scope string, target string, level int, origin string, pos int")).collect())
    assert got == [("x", 2), ("y", 0)]
    ratings = [("a", -2), ("a", -2), ("b", -2), ("b", -2), ("b", 0), ("c", 2), ("c", 2), ("c", 2), ("c", -1), ("c", -1), ("d", 1)]
    got = {r.k: (r.n, r.enough, r.level) for r in L.calibration_stats(spark.createDataFrame(ratings, "k string, rating int"), ["k"]).collect()}
    assert got == {"a": (2, True, -2), "b": (3, True, -1), "c": (5, True, 1), "d": (1, False, 1)}


def test_streaks_latest_and_outcomes(spark):
    runs = spark.createDataFrame([("s", 1, True), ("s", 2, False), ("s", 3, True), ("s", 4, True), ("t", 1, True), ("u", 1, False)], "k string, at int, bad boolean").withColumn("tie", F.col("at"))
    assert {r.k: r.streak for r in M.failure_streak(runs, "k", "at", "tie", F.col("bad")).collect()} == {"s": 2, "t": 1, "u": 0}
    assert {r.k: r["at"] for r in M.latest(runs, "k", "at", "tie").collect()} == {"s": 4, "t": 1, "u": 1}
    codes = spark.createDataFrame([(200, None), (403, None), (429, None), (503, None), (None, "connect"), (None, "timeout")], "c int, e string")
    assert [r[0] for r in codes.select(M.delivery_outcome(F.col("c"), F.col("e"))).collect()] == ["sent", "failed", "retryable", "retryable", "retryable", "unknown"]


def test_outbox_and_retention(spark):
    stories = spark.createDataFrame([("s1", 1, ["a", "b"]), ("s2", 2, ["b", "c"]), ("s3", 3, ["x"]), ("s4", 4, ["d"])], "story_id string, first_at int, members array<string>")
    told = spark.createDataFrame([("x",)], "article_id string")
    assert sorted(r.story_id for r in A.plan_stories(stories, told).collect()) == ["s1", "s4"]
    art = spark.createDataFrame([("a", T0), ("b", T0 - timedelta(days=40)), ("c", T0 - timedelta(days=40)), ("d", T0 - timedelta(days=40))], "article_id string, published_at timestamp")
    members = spark.createDataFrame([("k", "a"), ("k", "b"), ("m", "d")], "cluster_id string, article_id string")
    got = {r.article_id: r.retained_because for r in A.retention(art, members, told.union(spark.createDataFrame([("c",)], "article_id string")), T0).collect()}
    assert got == {"a": "fresh", "b": "live_cluster", "c": "feedback", "d": None}


def test_snapshot_diff_and_cards(spark):
    b = spark.createDataFrame([("1", "feed"), ("2", "feed"), ("3", "push")], "id string, d string")
    a = spark.createDataFrame([("2", "push"), ("3", "push"), ("4", "feed")], "id string, d string")
    assert sorted((r.id, r.change) for r in S.snapshot_diff(b, a, "id", "d").collect()) == [("1", "removed"), ("2", "changed"), ("4", "added")]
    scored = spark.createDataFrame([("k", "x", "s1", T0, "feed"), ("k", "y", "s2", T0, "push"), ("k", "z", "s3", T0, "hidden"), ("h", "w", "s1", T0, "hidden")], "cluster_id string, article_id string, source string, published_at timestamp, decision string")
    assert [(r.cluster_id, r.displayed, r.decision, r.n_sources, r.n_visible) for r in S.cards(scored).collect()] == [("k", "y", "push", 2, 2)]


def test_landed_items(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"Data": {"Articles": {"Items": [{"url": "u1", "title": "t"}, {"url": "", "title": "t"}]}, "Categories": [{"Items": [{"url": "u2", "title": "v", "is_video": true}, {"url": "u1", "title": "t"}, {"url": "u3", "title": "w"}]}]}}\n')
    item = "array<struct<url:string,title:string,is_video:boolean>>"
    payload = spark.read.schema(f"Data struct<Articles:struct<Items:{item}>,Categories:array<struct<Items:{item}>>>").json(str(tmp_path))
    assert sorted(r.url for r in flat_items(payload).collect()) == ["u1", "u3"]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"a{i % 7}", T0 + timedelta(hours=i)) for i in range(20)]
    df = spark.createDataFrame(rows, "article_id string, published_at timestamp")
    land, history = str(tmp_path / "land"), str(tmp_path / "history")
    for k in range(2):  # the second run brings what the first has seen, and one more
        append_snapshot((df if k == 0 else df.union(spark.createDataFrame([("new", T0)], df.schema))).coalesce(1), land)
        stream = spark.readStream.schema(df.schema).parquet(land)
        append_new(stream, history, str(tmp_path / "checkpoint")).awaitTermination()
    got = sorted(r.article_id for r in spark.read.parquet(history).collect())
    assert got == sorted({a for a, _ in rows} | {"new"})


def test_aliases_are_claimed_longest_first(spark):
    from storyloom.operators.evidence import alias_spans

    texts = spark.createDataFrame([(1, "Real Madrid beat Real and Madrid City"), (2, None), (3, "surreal Madrids"), (4, "Madrid, Real Madrid")], "article_id long, text string")
    got = {r.article_id: r.entities for r in alias_spans(texts, {"real madrid": "team:rm", "real": None, "Madrid": "city:m", "madrid city": "team:mc"}).collect()}
    assert got == {1: ["team:rm", "team:mc"], 2: [], 3: [], 4: ["city:m", "team:rm"]}
