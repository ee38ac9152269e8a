import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from storyloom.functions.columns import WINDOW_HOURS
from storyloom.operators import gates as T
from storyloom.operators import names as N

BASE = datetime(2024, 1, 1)
ARTICLES = "article_id string, title string, subtitle string, event_type string, sport string, published_at timestamp, source string"


def articles(spark, *rows):
    """Rows of (id, title, subtitle) or with event, sport, hours and source."""
    full = [(r + ("signing", "basketball", 0, f"s{i}")[len(r) - 3 :]) for i, r in enumerate(rows)]
    return spark.createDataFrame([(a, t, s, e, p, BASE + timedelta(hours=h), src) for a, t, s, e, p, h, src in full], ARTICLES)


def found(spark, df, **more):
    rows = N.candidates(df, N.hebrew_vocabulary(spark, ("יורוליג",)), **more).collect()
    return {(r.article_id, r.source, r.token_start, r.anchor): r for r in rows}


def anchors(rows):
    return {(a, x) for a, _, _, x in rows}


def test_two_words_that_are_no_vocabulary_are_a_name_and_money_is_not(spark):
    rows = found(spark, articles(spark, ("a", "מכבי ת\"א נפרדה מזאק הנקינס", None), ("b", "מיליון דולר בעונה: בשיחות על חוזה לשלוש שנים", ""), ("c", None, None), ("d", "יורוליג יורוליג", "")))
    assert ("a", "מזאק הנקינס") in anchors(rows)
    assert {a for a, _ in anchors(rows)} == {"a"}
    pair = next(r for r in rows.values() if r.anchor == "מזאק הנקינס")
    assert (pair.generation_rule, pair.confidence, pair.role, pair.left_context) == ("name_bigram", "strong", "unknown", ["מכבי", "נפרדה"])
    assert pair.token_end == pair.token_start + 2


def test_a_lone_mention_needs_an_article_that_the_gates_admit(spark):
    lone, whole = "מכבי נפרדה מהנקינס", "נפרדה מזאק הנקינס"
    known = lambda *other: ("x", "מהנקינס") in anchors(found(spark, articles(spark, ("x", lone, ""), other)))
    assert known("y", whole, "")
    assert known("y", whole, "", "signing", "unknown", 24)
    assert not known("y", whole, "", "signing", "basketball", 25)
    assert not known("y", whole, "", "injury", "basketball", 0)
    assert not known("y", whole, "", "signing", "football", 0)
    assert not known("y", whole + " מחצית", "", "signing", "basketball", 0)
    assert not known("y", "נפרדה מהנקינס", "", "signing", "basketball", 0)


def test_spelling_variants_meet_by_their_skeleton(spark):
    rows = found(spark, articles(spark, ("x", "האריך עם סטרונסקי", ""), ("y", "תומאש סטורנסקי", "")))
    lone = next(r for (a, _, _, x), r in rows.items() if (a, x) == ("x", "סטרונסקי"))
    assert lone.generation_rule == "corroborated_single" and not lone.population_corroborated


def test_kinds_that_are_never_grouped_have_no_population(spark):
    df = articles(spark, ("x", "נפרדה מהנקינס", "", "preview"), ("y", "מזאק הנקינס", "", "preview"))
    assert ("x", "מהנקינס") not in anchors(found(spark, df))


def test_roles_and_named_entities(spark):
    df = articles(spark, ("a", "הקבוצה של דימיטריס איטודיס", ""), ("b", "ניצחה מול דימיטריס איטודיס", ""), ("c", "המאמן דימיטריס איטודיס", ""))
    named = spark.createDataFrame([("a", "title", "coach:itoudis", "coach"), ("b", "title", "team:x", "team")], "article_id string, source string, entity_id string, taxonomy_kind string")
    rows = found(spark, df, resolved=named)
    roles = {(a, x): r.role for (a, _, _, x), r in rows.items() if r.generation_rule != "corroborated_single"}
    assert roles == {("a", "דימיטריס איטודיס"): "role_holder", ("b", "דימיטריס איטודיס"): "opponent", ("c", "דימיטריס איטודיס"): "role_holder", ("a", "coach:itoudis"): "role_holder", ("b", "team:x"): "unknown"}
    single = {(a, x): r.role for (a, _, _, x), r in rows.items() if r.generation_rule == "corroborated_single"}
    assert single[("c", "איטודיס")] == "role_holder" and single[("b", "איטודיס")] == "unknown"


def candidate_rows(spark, *rows):
    schema = "article_id string, source string, token_start int, token_end int, anchor string, generation_rule string, confidence string, role string, population_corroborated boolean, entity_id string"
    return spark.createDataFrame([(a, s, i, i + 1, x, rule, "weak", role, False, e) for a, s, i, x, rule, role, e in rows], schema)


def test_validation_takes_the_most_ordinary_form_and_abstains_between(spark):
    df = candidate_rows(
        spark,
        ("a", "title", 0, "נשאר אדום", "name_bigram", "unknown", None),
        ("a", "title", 2, "בצהוב", "corroborated_single", "unknown", None),
        ("a", "title", 3, "מדר", "corroborated_single", "unknown", None),
        ("a", "title", 4, "ספק", "corroborated_single", "unknown", None),
        ("a", "title", 5, "abc", "corroborated_single", "unknown", None),
        ("a", "title", -1, "player:x", "canonical_taxonomy", "unknown", "player:x"),
        ("a", "title", 6, "אוטורו", "corroborated_single", "unknown", None),
    )
    zipf = spark.createDataFrame([("נשאר", 5.11), ("אדום", 4.99), ("בצהוב", 3.38), ("צהוב", 4.45), ("מדר", 3.25), ("ספק", 4.0)], "word string, zipf double")
    got = {r.anchor: (r.decision, r.reason_code, r.max_zipf) for r in N.validated(df, zipf).collect()}
    assert got == {
        "נשאר אדום": ("rejected", "ordinary_word", 5.11), "בצהוב": ("rejected", "ordinary_word", 4.45), "מדר": ("accepted", "rare_in_language", 3.25),
        "ספק": ("abstained", "uncertain_band", 4.0), "abc": ("abstained", "no_tokens", None), "player:x": ("accepted", "canonical_taxonomy", None), "אוטורו": ("accepted", "rare_in_language", 0.0),
    }
    got = {r.anchor: (r.decision, r.reason_code) for r in N.validated(df, None).collect()}
    assert got["מדר"] == ("abstained", "resource_unavailable") and got["player:x"] == ("accepted", "canonical_taxonomy")


def test_stored_anchors_are_the_first_accepted_and_no_role_holders(spark):
    df = candidate_rows(
        spark,
        ("a", "subtitle", 0, "מדר", "name_bigram", "unknown", None),
        ("a", "title", 5, "מדר", "corroborated_single", "unknown", None),
        ("a", "title", 1, "הנקינס", "corroborated_single", "opponent", None),
        ("a", "subtitle", 4, "הנקינס", "corroborated_single", "unknown", None),
        ("b", "title", 1, "איטודיס", "corroborated_single", "role_holder", None),
    )
    kept = N.story_anchors(N.validated(df, spark.createDataFrame([], "word string, zipf double")))
    assert sorted((r.article_id, r.anchor, r.source) for r in kept.collect()) == [("a", "הנקינס", "subtitle"), ("a", "מדר", "title")]
    keys = {(r.article_id, r.key): r.in_title for r in N.anchor_keys(kept).collect()}
    assert keys == {("a", "הנקינס"): False, ("a", "נקינס"): False, ("a", "translit:הנקנס"): False, ("a", "מדר"): True, ("a", "translit:מדר"): True}


def test_pairs_need_a_headlined_name_a_person_state_two_newsrooms_and_the_gates(spark):
    df = articles(
        spark,
        ("a", "", "", "signing", "basketball", 0, "ynet"), ("b", "", "", "signing", "unknown", 20, "walla"), ("c", "", "", "signing", "football", 1, "one"),
        ("d", "", "", "news", "basketball", 1, "two"), ("e", "", "", "signing", "basketball", 1, "ynet"), ("f", "", "", "signing", "basketball", 30, "five"),
    )
    rows = [(i, "הנקינס", "title" if i == "a" else "subtitle") for i in "abcdef"]
    keys = N.anchor_keys(spark.createDataFrame(rows, "article_id string, anchor string, source string"))
    assert [(r.a_id, r.b_id) for r in N.subject_pairs(keys, df).collect()] == [("a", "b")]


def test_counts_over_bands_equal_pairs(spark):
    rng = random.Random(4)
    kinds, sports = ("signing", "injury", "match_result", "preview"), ("basketball", "football", "tennis", "unknown", "chess")
    rows = [(f"x{i}", rng.choice(("", "live now")), "", rng.choice(kinds), rng.choice(sports), rng.choice((0, 1, 12, 24, 36)) + rng.randint(-40, 40), "s") for i in range(150)]
    df = articles(spark, *rows).withColumn("tokens", F.array(F.concat(F.lit("t"), (F.length("article_id") % 3).cast("string")), F.substring("article_id", 2, 1)))
    own = {r.article_id: r for r in df.collect()}

    def admitted(x, p):
        near = abs((p.published_at - x.published_at).total_seconds()) <= WINDOW_HOURS[x.event_type] * 3600
        clash = x.sport in T.PROVEN_SPORTS and p.sport in T.PROVEN_SPORTS and x.sport != p.sport
        return p.event_type == x.event_type and "live" not in p.title and near and not clash

    want = set()
    for x in own.values():
        if x.event_type in WINDOW_HOURS:
            population = [p for p in own.values() if admitted(x, p)]
            for t in x.tokens:
                n = sum(t in p.tokens for p in population)
                want.add((x.article_id, t, n, len(population), (n <= 2 or n <= 0.2 * len(population)) and t != "1"))
    got = T.scoped_frequency(df, spark.createDataFrame([("1",), ("1",)], "token string"), most=2, ratio=0.2)
    assert {tuple(r) for r in got.select("article_id", "token", "df", "population", "evidence").collect()} == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "NestedLoop" not in plan and "Cross" not in plan
    assert T.scoped_frequency(df.limit(0)).count() == 0


def test_only_articles_of_another_version_are_found_anew(spark):
    df = articles(spark, ("a", "", ""), ("b", "", ""), ("c", "", ""))
    stored = spark.createDataFrame([("a", "v1"), ("b", "v2")], "article_id string, validator_version string")
    assert sorted(r.article_id for r in N.refreshed(df, stored, "v2").collect()) == ["a", "c"]
    assert N.refreshed(df, stored, "v2", force=True).count() == 3


def test_in_play_in_either_language(spark):
    rows = [("שידור חי", True), ("חי בלייב", True), ("בן חי נבחר", True), ("חיים", False), ("LIVE: x", True), (None, False), ("מחצית ראשונה", True)]
    df = spark.createDataFrame(rows, "title string, want boolean")
    assert all(r.got == r.want for r in df.select("want", T.in_play(F.col("title"), F.lit("")).alias("got")).collect())
