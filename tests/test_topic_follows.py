"""What users follow holds for all their topics, and is not multiplied by them."""

from storyloom.operators import topics as T


def test_follows_by_user_equal_follows_by_topic(spark):
    arts = spark.createDataFrame(
        [(1, "s1", "signing", "very_high", ["t1", "t2"]), (2, "s1", "injury", "low", ["t3"]), (3, "s2", "match_result", "medium", []), (4, "s2", "signing", "medium", ["t3", "t1"])],
        "article_id long, sport string, event_type string, importance string, entities array<string>",
    )
    topics = spark.createDataFrame(
        [(u, f"{k}{u}", scope, target, mode, 70, i) for u in (1, 2) for i, (k, scope, target, mode) in enumerate((("a", "sport", "s1", "followed_entities_only"), ("b", "competition", "c1", "all"), ("c", "entity", "t3", "followed_entities_only")))],
        "user_id int, topic_id string, scope string, target string, mode string, priority int, pos int",
    )
    comps = spark.createDataFrame([(1, "c1", "membership"), (3, "c1", "explicit"), (4, "c1", "membership")], "article_id long, competition string, kind string")
    rules = spark.createDataFrame([("b1", None, "signing", "high_feed"), ("b2", None, "signing", "high_feed"), ("a1", "t2", "signing", "feed"), ("c2", None, T.CATCH_ALL, "high_feed")], "topic_id string, entity string, event_type string, decision string")
    users = spark.createDataFrame([(1, "t1"), (2, "t3"), (2, "t3")], "user_id int, entity string")
    by_topic = topics.join(users, "user_id").select("topic_id", "entity")
    shown = lambda follows: sorted(tuple(r) for r in T.topic_decisions(arts, topics, comps, rules, follows).collect())
    got = shown(users)
    assert got == shown(by_topic)
    assert got == [
        (1, 1, "a1", "high_feed", "entity_event"), (1, 2, "a1", "hidden", "fallback"), (1, 3, "b1", "feed", "fallback"), (1, 4, "b1", "high_feed", "event"),
        (2, 1, "b2", "feed", "event"), (2, 2, "c2", "high_feed", "fallback"), (2, 3, "b2", "feed", "fallback"), (2, 4, "b2", "high_feed", "event"),
    ]
