"""The topic scorer: which topics of a profile an article falls under, and the best decision that one of them gives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import DECISIONS, case, decision_rank
from .graph import joined, saved
from .rules import first_match

# Events that say which team, or which competition, an article is about.
TEAM_EVENTS = ("signing", "major_signing", "negotiation", "candidate", "release", "injury", "major_trade", "star_trade", "major_transfer")
COMPETITION_EVENTS = (
    "match_result", "regular_season_result", "playoff_result", "finals_result", "title_win", "schedule", "pre_match", "generic_preview",
    "generic_regular_season_result", "friendly_match", "final_four", "major_match_result", "match_summary",
)
#: Least priority and decision by importance, tried in order; what fits none is hidden.
FALLBACK = (("very_high", 80, "high_feed"), ("high", None, "feed"), ("medium", 70, "feed"), ("medium", None, "low_feed"), ("low", 70, "low_feed"))


def fallback(importance: Column, priority: Column) -> Column:
    """A decision by importance and priority alone."""
    return first_match([((importance == i) & (F.lit(True) if p is None else priority >= p), d) for i, p, d in FALLBACK], "hidden")


def raised(decision: Column, when: Column) -> Column:
    """One rank higher, up to high_feed; hidden stays."""
    up = case(decision, {"low_feed": "feed", "feed": "high_feed"})
    return F.when(when & up.isNotNull(), up).otherwise(decision)


def competition_matches(articles: DataFrame, reach: DataFrame, inferred: DataFrame) -> DataFrame:
    """article_id, competition, kind of every competition an article can stand for: explicit (named), else inferred from its
    participants for competition events but friendlies, else by membership of its entities for team events.

    ``articles``: article_id, competitions (array), event_type; ``reach`` and ``inferred``: article_id, competition."""
    named = articles.select("article_id", F.explode("competitions").alias("competition"), F.lit(1).alias("tier"))
    events = lambda *e: articles.filter(F.col("event_type").isin(*e)).select("article_id")
    by_play = inferred.join(events(*[e for e in COMPETITION_EVENTS if e != "friendly_match"]), "article_id", "left_semi").select("article_id", "competition", F.lit(3).alias("tier"))
    by_team = reach.join(events(*TEAM_EVENTS), "article_id", "left_semi").select("article_id", "competition", F.lit(4).alias("tier"))
    best = named.union(by_play).union(by_team).groupBy("article_id", "competition").agg(F.min("tier").alias("tier"))
    return best.withColumn("kind", case(F.col("tier"), {1: "explicit", 3: "participant_inference", 4: "membership"})).drop("tier")


#: The event of a topic's rule for all that is written about an entity that is followed.
CATCH_ALL = "followed_entity_news"


def with_aliases(rules: DataFrame, aliases: dict[str, tuple[str, ...]]) -> DataFrame:
    """The rules (topic_id, entity, event_type, decision), and for every event without one of its own that of its first
    alias that has one."""
    own = rules.withColumn("place", F.lit(0))
    for event, others in aliases.items():
        for i, other in enumerate(others):
            own = own.unionByName(rules.filter(F.col("event_type") == other).withColumn("event_type", F.lit(event)).withColumn("place", F.lit(i + 1)))
    return own.groupBy("topic_id", "entity", "event_type").agg(F.min_by("decision", "place").alias("decision"))


def topic_decisions(articles: DataFrame, topics: DataFrame, competitions: DataFrame, rules: DataFrame, follows: DataFrame | None = None, aliases: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """user_id, article_id, topic_id, decision, rule: of the topics an article falls under the best decision, the topic of
    highest priority of equals, then the earliest; pairs without a topic are hidden and left out.

    ``articles``: article_id, sport, event_type, importance, entities (array); ``topics``: user_id, topic_id, scope (sport,
    competition, entity), target, mode, priority, pos; ``competitions`` as from ``competition_matches``; ``rules``: topic_id,
    entity (null: any), event_type, decision; ``follows``: entity and topic_id, or user_id for all topics of a user (without
    it, any entity counts as followed).  A topic that is hidden for an event falls back to importance where only importance counts, and to its catch-all rule, or
    feed, where followed entities count.  Topics meet articles by equal keys, never all against all."""
    rules = with_aliases(rules, aliases or {})
    facts = articles.select("article_id", "sport", "event_type", "importance", "entities")
    about = ["article_id", "event_type", "importance", "entities"]
    keys = (
        facts.select(*about, F.lit("sport").alias("scope"), F.col("sport").alias("target"), F.lit("explicit").alias("kind"))
        .union(facts.select(*about, F.lit("entity"), F.explode("entities"), F.lit("explicit")))
        .union(competitions.join(facts, "article_id").select(*about, F.lit("competition"), "competition", "kind"))
    )
    # What a topic says of events goes with the topic: topics are few beside what they meet.
    own = rules.filter("entity IS NULL").groupBy("topic_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "decision"))).alias("by_events"))
    named = rules.filter("entity IS NOT NULL").select("topic_id", "event_type", F.col("entity").alias("of"), decision_rank(F.col("decision")).alias("r"))
    own = topics.join(own, "topic_id", "left").join(named.select("topic_id", F.lit(True).alias("names")).distinct(), "topic_id", "left")
    said = lambda event: F.element_at("by_events", event)
    catch = F.when(said(F.lit(CATCH_ALL)) != "hidden", said(F.lit(CATCH_ALL)))
    met = joined(keys, saved(own.withColumn("catch_all", catch)), ["scope", "target"]).withColumn("by_event", said(F.col("event_type")))
    each = met.filter("names").select("topic_id", "article_id", "event_type", F.explode(F.array_distinct("entities")).alias("of"))
    by_entity = each.join(named, ["topic_id", "event_type", "of"]).groupBy("topic_id", "article_id").agg(F.max("r").alias("r"))
    met = met.withColumn("any_entity", F.size("entities") > 0)
    slim = met.select("user_id", "topic_id", "article_id", "scope", "kind", "mode", "priority", "pos", "importance", "by_event", "catch_all", "any_entity").join(by_entity, ["topic_id", "article_id"], "left")
    entity_rule = case(F.col("r"), dict(enumerate(DECISIONS)))
    if follows is None:
        met = slim.withColumn("followed", F.col("any_entity"))
    else:
        # Asked only where it counts: for topics of followed entities, and for membership, which is held back without one.
        asked = met.filter((F.col("mode") == "followed_entities_only") | (F.col("kind") == "membership"))
        by = "user_id" if "user_id" in follows.columns else "topic_id"
        hits = asked.select("user_id", "topic_id", "article_id", F.explode("entities").alias("entity")).join(follows.select(by, "entity").distinct(), [by, "entity"], "left_semi")
        met = slim.join(hits.select("topic_id", "article_id", F.lit(True).alias("followed")).distinct(), ["topic_id", "article_id"], "left").withColumn("followed", F.coalesce("followed", F.lit(False)))
    event_rule, mode, big = F.col("by_event"), F.col("mode"), F.col("importance") == "very_high"
    plain = fallback(F.col("importance"), F.col("priority"))
    visible = F.when(event_rule != "hidden", event_rule)
    decision = (
        F.when(mode == "muted", "hidden")
        .when(mode.isin("titles_only", "major_only"), F.coalesce(visible, F.lit("hidden")))
        .when((mode == "high_importance_only") & F.col("importance").isin("low", "very_low"), "hidden")
        .when(mode == "high_importance_only", F.coalesce(visible, plain))
        .when((mode == "followed_entities_only") & ~F.col("followed"), "hidden")
        .when(mode == "followed_entities_only", F.coalesce(raised(entity_rule, big), visible, F.col("catch_all"), F.lit("feed")))
        .otherwise(F.coalesce(raised(entity_rule, big), F.when(event_rule == "hidden", "hidden").otherwise(raised(event_rule, big | ((F.col("scope") == "entity") & (event_rule == "feed")))), plain))
    )
    rule = F.when(mode == "muted", "topic_muted").when(entity_rule.isNotNull() & ~mode.isin("titles_only", "major_only", "high_importance_only"), "entity_event").when(F.when(mode.isin("high_importance_only", "followed_entities_only"), visible).otherwise(event_rule).isNotNull(), "event").otherwise("fallback")
    # Reach by membership alone, without an entity that is followed, justifies feed at most.
    met = met.withColumn("decision", decision).withColumn("rule", rule).withColumn("rank", decision_rank(F.col("decision")))
    capped = (F.col("kind") == "membership") & ~F.col("followed") & (F.col("rank") > 2)
    met = met.withColumn("decision", F.when(capped, "feed").otherwise(F.col("decision"))).withColumn("rank", F.when(capped, 2).otherwise(F.col("rank")))
    by = Window.partitionBy("user_id", "article_id").orderBy(F.col("rank").desc(), F.col("priority").desc(), "pos", "topic_id")
    return met.withColumn("place", F.row_number().over(by)).filter("place = 1").select("user_id", "article_id", "topic_id", "decision", "rule")
