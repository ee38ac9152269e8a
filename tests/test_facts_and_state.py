"""Edge cases of the operators that the queries' SQL does not reach."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from storyloom.operators import articles as A
from storyloom.operators import facts as E
from storyloom.operators import reports as T
from storyloom.operators import selection as C
from storyloom.operators import similarity as P
from storyloom.operators import state as U


def test_dedup_keeps_one_row_of_repeated_and_null_ids(spark):
    rows = [(1, "a"), (1, "b"), (1, "a"), (None, "c"), (None, "c"), (4, "c"), (5, None), (None, None)]
    got = A.dedup(spark.createDataFrame(rows, "doc_id long, text string"), "text", "doc_id").collect()
    assert sorted(((r.doc_id, r.text, r.n_copies) for r in got), key=repr) == sorted([(1, "a", 2), (1, "b", 1), (4, "c", 3), (5, None, 2)], key=repr)
    assert A.dedup(spark.createDataFrame([], "doc_id long, text string"), "text", "doc_id").count() == 0


def test_hebrew_words_take_prefixes_but_no_suffixes(spark):
    texts = ["מכבי ניצחה", "במכבי היום", "מכביסטים", "אמכבי", "ולמכבי.", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.m for r in df.select("i", E.by_rules(F.col("t"), (E.WordRule("yes", (E.whole_word("מכבי"),)),), "no").alias("m")).collect()}
    assert got == {0: "yes", 1: "yes", 2: "no", 3: "no", 4: "yes", 5: "no"}


def test_longer_competition_names_claim_first(spark):
    names = {"ibl": ("super league basketball",), "league": ("super league",), "nba": ("nba",)}
    texts = ["Super League Basketball before the NBA", "nba, super league, super league basketball", "", None]
    got = [r.n for r in spark.createDataFrame([(t,) for t in texts], "t string").select(E.competitions_named(F.col("t"), names).alias("n")).collect()]
    assert got == [["ibl", "nba"], ["nba", "league", "ibl"], [], []]


@pytest.mark.parametrize(
    "found, current, want",
    [
        ([], "tennis", ("tennis", None)),
        ([(80, "title_keyword", "football")], "tennis", ("football", "weighted_evidence_override")),
        ([(80, "title_keyword", "football"), (80, "title_keyword", "tennis")], "tennis", ("tennis", "equal_weight_tie_kept")),
        ([(80, "title_keyword", "football"), (80, "title_keyword", "tennis")], "unknown", ("unknown", "equal_weight_tie_abstain")),
        ([(80, "title_keyword", "football"), (20, "llm", "tennis")], "football", ("football", "title_keyword_outweighs")),
        ([(40, "entity_derived", "football"), (20, "llm", "tennis")], "tennis", ("tennis", "llm_outweighs")),
        ([(80, "title_keyword", "football")], "football", ("football", None)),
    ],
)
def test_resolved_sport(spark, found, current, want):
    df = spark.createDataFrame([(found, current)], "found array<struct<weight:int,source:string,sport:string>>, current string")
    r = df.select(E.resolved_sport(F.col("found"), F.col("current")).alias("r")).first().r
    assert (r.sport, r.rule) == want


def test_proposals_that_cannot_be_read_are_null(spark):
    raw = [None, "", "no object", '{"sport": "golf", "confidence": 1.7}', '{"confidence": -1, "sport": "tennis"}', '{"sport": "tennis"} {"sport": "golf"}', '{"sport": "tennis", "confidence": 0.9']
    df = spark.createDataFrame([(r,) for r in raw], "raw string").select(E.parsed_proposal(F.col("raw"), ("tennis",), ()).alias("s"))
    assert [(r.s.sport, r.s.confidence) if r.s else None for r in df.collect()] == [None, None, None, ("unknown", 0.0), ("tennis", 0.0), ("tennis", 0.0), None]


def test_answers_are_mended_and_cut(spark):
    raw = ['Here: {"sport:": "tennis", "confidence": "0.8", "league": "ATP", "importance": "urgent", "entities": ["a", null, "b", "c"], "reason": {"x": 1}} done }', '{"sport": 5, "entities": "a", "confidence": "much"}', "{broken: json,}"]
    df = spark.createDataFrame([(r,) for r in raw], "raw string").select(E.parsed_proposal(F.col("raw"), ("tennis",), (), 2, 5, ("ATP",)).alias("s"))
    got = [r.s for r in df.collect()]
    assert (got[0].sport, got[0].league, got[0].importance, got[0].confidence, got[0].entities, got[0].reason) == ("tennis", "ATP", "medium", 0.8, ["a", "b"], '{"x":')
    assert (got[1].sport, got[1].entities, got[1].confidence) == ("unknown", [], 0.0) and got[2] is None


SAID = "said struct<sport:string,league:string,event_type:string,importance:string,confidence:double>"
RULES = "sport string, league string, event_type string, certainty string, importance string, unsupported boolean, football_club boolean, committed string, hint string, borne array<struct<event:string,certainty:string>>"


def test_guardrails_correct_the_model_in_order(spark):
    rules = ("football", "LaLiga", "signing", "probable", "high", False, False, None, None, [("signing", "probable"), ("injury", "weak")])

    def row(said, **to):
        names = [c.split()[0] for c in RULES.split(", ") if not c.startswith("certainty:")]
        return (said, *[to.get(n, v) for n, v in zip(names, rules)])

    cases = [
        (row(None), ("football", "LaLiga", "signing", "probable", "high", "rules", "")),
        (row(("tennis", None, "injury", "low", 0.6)), ("football", "LaLiga", "signing", "probable", "high", "rules", "")),
        (row(("football", "LaLiga", "injury", "very_high", 0.65)), ("football", "LaLiga", "injury", "weak", "very_high", "model", "")),
        (row(("football", "X", "news", "low", 0.9), unsupported=True, hint="tennis"), ("unknown", "LaLiga", "signing", "confirmed", "high", "model_guarded", "unsupported,rules_league,rules_event,importance")),
        (row(("basketball", "NBA", "title_win", "high", 0.9), football_club=True), ("football", "LaLiga", "signing", "probable", "high", "model_guarded", "football_club,evidence")),
        (row(("football", "LaLiga", "signing", "high", 0.9), committed="basketball", hint="tennis"), ("basketball", "LaLiga", "signing", "confirmed", "high", "model_guarded", "committed,rules_league")),
        (row(("unknown", "NBA", "title_win", "high", 0.9), event_type="news", borne=[], hint="tennis"), ("tennis", "NBA", "news", "confirmed", "high", "model_guarded", "rules_sport,evidence,league_sport,hint")),
    ]
    df = spark.createDataFrame([c for c, _ in cases], f"{SAID}, {RULES}")
    got = E.guarded(df, {"NBA": "basketball"}).collect()
    assert [(r.final_sport, r.final_league, r.final_event, r.final_certainty, r.final_importance, r.classified_by, ",".join(r.guards)) for r in got] == [w for _, w in cases]


def test_streaks_and_health_of_empty_tables(spark):
    none = spark.createDataFrame([], "cycle_id long, status string, requested_at timestamp, finished_at timestamp")
    r = T.scheduler_health(none, datetime(2024, 1, 1)).first()
    assert (r.last_attempted, r.consecutive_failures, r.stale, r.degraded) == (None, 0, False, False)


def test_recent_rows_need_no_fallback(spark):
    df = spark.createDataFrame([(1, datetime(2024, 1, 1)), (2, datetime(2023, 1, 1)), (3, None)], "id int, published_at timestamp")
    assert [(r.id, r.fallback) for r in C.recent_or_all(df, datetime(2024, 1, 1, 12)).collect()] == [(1, False)]
    assert C.recent_or_all(df, datetime(2030, 1, 1)).filter("fallback").count() == 3
    assert C.recent_or_all(df.limit(0), datetime(2030, 1, 1)).count() == 0


def test_protected_tables_are_not_replaced(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    U.refuse_overwrite(spark, path)
    spark.range(1).write.parquet(path)
    with pytest.raises(FileExistsError):
        U.refuse_overwrite(spark, path)
    U.refuse_overwrite(spark, path, force=True)


def test_common_tokens_count_as_rare_in_a_large_corpus(spark):
    rows = [(f"{i:04d}", "news", datetime(2024, 1, 1), ["shared"] if i < 9 else [f"w{i}"]) for i in range(900)]
    df = spark.createDataFrame(rows, "article_id string, event_type string, published_at timestamp, tokens array<string>")
    assert P.candidate_pairs(df).count() == 36
    assert P.candidate_pairs(df.limit(800)).count() == 0
    assert P.candidate_pairs(df, generic=("shared",)).count() == 0
