"""The affinity scorer in full: constraints, scopes, boosts, event deltas, importance, ceiling, overrides; and what is learned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rules import first_match

# How narrow a scope is, and other names under which an event's delta may be kept, in order.
NARROW = {"team": 3, "player": 3, "competition": 2, "sport": 1}
ALIASES = (
    ("regular_season_result", "match_result", 1), ("match_result", "regular_season_result", 1),
    ("major_signing", "signing", 1), ("signing", "major_signing", 1),
    ("major_trade", "star_trade", 1), ("star_trade", "major_trade", 1),
    ("major_transfer", "major_signing", 1), ("major_transfer", "major_trade", 2),
    ("match_summary", "match_result", 1), ("match_summary", "regular_season_result", 2),
)
POSITIVE, NEGATIVE = ("more_like_this",), ("less_like_this", "not_interested", "never_show")


def article_keys(articles: DataFrame) -> DataFrame:
    """article_id, scope, target and match_kind (explicit, or membership for competitions that only members reach).

    ``articles``: article_id, sport, competition, entities (array of structs scope, target), reach (array of competitions)."""
    one = lambda scope, target, kind: F.struct(F.lit(scope).alias("scope"), target.alias("target"), F.lit(kind).alias("match_kind"))
    entities = F.transform("entities", lambda e: F.struct(e["scope"].alias("scope"), e["target"].alias("target"), F.lit("explicit").alias("match_kind")))
    reach = F.transform(F.array_except("reach", F.array("competition")), lambda c: one("competition", c, "membership"))
    own = F.array(one("sport", F.col("sport"), "explicit"), one("competition", F.col("competition"), "explicit"))
    return articles.select("article_id", F.explode(F.concat(own, entities, reach)).alias("k")).select("article_id", "k.*").filter("target IS NOT NULL").distinct()


def score(articles: DataFrame, affinities: DataFrame, deltas: DataFrame, overrides: DataFrame, muted: DataFrame) -> DataFrame:
    """user_id, article_id, base (target), score, decision and reason of every pair of a user and an article that a scope
    or a rule of the user touches; all others are hidden for want of a matching scope.

    Articles as in ``article_keys`` with source, event_type and importance; ``affinities``: user_id, scope, target, level
    (-2 excludes), pos; ``deltas``: user_id, scope_ref (null: any), event_type, delta, authority, pos; ``overrides``:
    user_id, kind (mute, never_show, always_push), scope, target, event_type (null: any); ``muted``: user_id, kind (source, topic),
    value.  All sides are shuffled by (scope, target), which AQE may split; no user's articles are gathered."""
    keys = article_keys(articles)
    narrow = first_match([(F.col("scope") == s, str(n)) for s, n in NARROW.items()]).cast("int")
    met = keys.join(affinities, ["scope", "target"]).withColumn("narrow", narrow).withColumn("followed", F.col("scope").isin("team", "player"))
    points = F.col("level") + 1
    open_ = F.col("level") > -2
    best = F.max(F.when(open_, F.struct(points.alias("points"), (-F.col("narrow")).alias("broad"), (-F.col("pos")).alias("early"), "scope", "target", "match_kind")))
    agg = met.groupBy("user_id", "article_id").agg(
        best.alias("base"),
        F.max(F.when(~open_, F.col("narrow"))).alias("shut_at"),
        F.max(F.when(open_, F.col("narrow"))).alias("open_at"),
        F.max(open_ & F.col("followed") & (F.col("level") >= 0)).alias("backed"),
        F.max(open_ & F.col("followed") & (F.col("level") >= 1)).alias("boosted"),
    )
    facts = articles.select("article_id", "source", "sport", "competition", "event_type", "importance")
    rules = keys.join(overrides.withColumnRenamed("event_type", "only"), ["scope", "target"]).join(facts.select("article_id", "event_type"), "article_id").filter("only IS NULL OR only = event_type")
    ruled = rules.groupBy("user_id", "article_id").agg(F.max(F.col("kind").isin("mute", "never_show")).alias("shown_never"), F.max(F.col("kind") == "always_push").alias("pushed"))
    both = agg.join(ruled, ["user_id", "article_id"], "full_outer").join(facts, "article_id")
    asked = both.filter("base IS NOT NULL").select("user_id", "article_id", F.col("base.target").alias("target"), "event_type")
    both = both.join(_delta(asked, deltas), ["user_id", "article_id"], "left")
    sources = muted.filter("kind = 'source'").select("user_id", F.col("value").alias("source"), F.lit(True).alias("source_muted")).distinct()
    topics = muted.filter("kind = 'topic'").select("user_id", F.col("value").alias("topic"), F.lit(True).alias("t")).distinct()
    both = both.join(sources, ["user_id", "source"], "left")
    for c in ("sport", "competition"):
        both = both.join(topics.select("user_id", F.col("topic").alias(c), F.col("t").alias(f"{c}_muted")), ["user_id", c], "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    boost = F.when(yes("boosted") & F.col("base.scope").isin("competition", "sport"), 1).otherwise(0)
    before = F.col("base.points") + boost + F.coalesce("delta", F.lit(0))
    total = before + F.when((F.col("importance") == "very_high") & (before >= 1), 1).when(F.col("importance").isin("low", "very_low"), -1).otherwise(0)
    reason = first_match(
        [
            (yes("source_muted"), "muted_source"), (yes("sport_muted") | yes("competition_muted"), "muted_topic"), (yes("shown_never"), "never_show_override"),
            (F.col("shut_at").isNotNull() & (F.coalesce("open_at", F.lit(0)) <= F.col("shut_at")), "excluded_scope"), (F.col("base").isNull(), "no_matching_scope"),
        ]
    )
    scored = both.withColumn("reason", reason).withColumn("score", F.when(F.col("reason").isNull(), total))
    plain = F.when(F.col("score") <= 0, "hidden").when(F.col("score") == 1, "low_feed").when((F.col("score") == 2) | ((F.col("base.match_kind") == "membership") & ~yes("backed")), "feed").otherwise("high_feed")
    decision = F.when(F.col("reason").isNotNull(), "hidden").when((plain != "hidden") & yes("pushed"), "push").otherwise(plain)
    why = F.coalesce("reason", F.when(decision == "push", "always_push").otherwise("affinity_score"))
    return scored.select("user_id", "article_id", F.col("base.target").alias("base"), F.col("score").cast("int").alias("score"), decision.alias("decision"), why.alias("reason"))


def _delta(asked: DataFrame, deltas: DataFrame) -> DataFrame:
    """The delta for each (user_id, article_id, target, event_type): of the base scope before any scope, the event's own
    name before its other names in order, then by authority and place."""
    names = asked.sparkSession.createDataFrame(list(ALIASES), "event_type string, alias string, ord int")
    each = asked.withColumn("alias", F.col("event_type")).withColumn("ord", F.lit(0)).unionByName(asked.join(F.broadcast(names), "event_type"))
    own = deltas.select("user_id", "scope_ref", F.col("event_type").alias("alias"), "delta", "authority", F.col("pos").alias("d_pos"))
    met = each.join(own, ["user_id", "alias"]).filter("scope_ref IS NULL OR scope_ref = target")
    order = F.struct(F.col("scope_ref").isNull().cast("int").alias("wide"), "ord", (-F.col("authority")).alias("authority"), "d_pos")
    return met.groupBy("user_id", "article_id").agg(F.min_by("delta", order).alias("delta"))


def attributed(clicks: DataFrame) -> DataFrame:
    """Adds feature: what a click teaches about, the boosting entity, else an entity base, else (base, event type).

    ``clicks``: boost (entity or null), base, base_scope, event_type."""
    feature = F.coalesce(F.concat(F.lit("entity:"), "boost"), F.when(F.col("base_scope").isin("team", "player"), F.concat(F.lit("entity:"), "base")), F.concat(F.lit("event:"), "base", F.lit("|"), "event_type"))
    return clicks.withColumn("feature", feature)


def learned_levels(nets: DataFrame, affinities: DataFrame) -> DataFrame:
    """user_id, target, level of what active nets teach: one step from the present level (0 if there is none) in the net's
    direction, within -1 and 2.  ``nets``: user_id, target, net, active; ``affinities``: user_id, target, level."""
    step = F.coalesce("level", F.lit(0)) + F.signum("net").cast("int")
    return nets.filter("active").join(affinities, ["user_id", "target"], "left").select("user_id", "target", F.greatest(F.lit(-1), F.least(F.lit(2), step)).alias("level"))


def never_show_rule(articles: DataFrame) -> DataFrame:
    """article_id, scope, target and event_type of the rule that "never show" makes: the first team, else the first player
    or coach, else competition and event, else sport and event; nulls where nothing is known.

    ``articles``: article_id, teams, people (arrays), competition, sport, event_type."""
    first = lambda c: F.get(F.coalesce(c, F.array().cast("array<string>")), F.lit(0))
    team, person = first(F.col("teams")), first(F.col("people"))
    known = F.when(F.col("sport") != "unknown", F.col("sport"))
    rule: Column = F.coalesce(
        F.when(team.isNotNull(), F.struct(F.lit("team").alias("scope"), team.alias("target"), F.lit(None).cast("string").alias("event_type"))),
        F.when(person.isNotNull(), F.struct(F.lit("player").alias("scope"), person.alias("target"), F.lit(None).cast("string").alias("event_type"))),
        F.when(F.col("competition").isNotNull(), F.struct(F.lit("competition").alias("scope"), F.col("competition").alias("target"), F.col("event_type"))),
        F.when(known.isNotNull(), F.struct(F.lit("sport").alias("scope"), known.alias("target"), F.col("event_type"))),
    )
    return articles.select("article_id", rule.alias("r")).select("article_id", "r.scope", "r.target", "r.event_type")
