"""Ordered rule ladders: health, gates, importance, constraints, lookups, dispatch."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import rate
from .similarity import alike


def first_match(rules: list[tuple[Column, str]], default: str | None = None) -> Column:
    """The name of the first rule that holds; a rule that is null does not hold."""
    out = F.lit(default)
    for holds, name in reversed(rules):
        out = F.when(holds, F.lit(name)).otherwise(out)
    return out


def source_health(sources: DataFrame, runs: DataFrame, now: datetime) -> DataFrame:
    """health of each source: disabled, never_run, error (its last run failed), stale (older than twice its interval) or
    healthy.  ``sources``: source_id, enabled, interval_minutes; ``runs``: source_id, at, run_id, ok."""
    last = runs.groupBy("source_id").agg(F.max_by(F.struct("at", "ok"), F.struct("at", "run_id")).alias("r"))
    age = (F.unix_micros(F.lit(now)) - F.unix_micros("r.at")) / 60e6
    ladder = [(~F.col("enabled"), "disabled"), (F.col("r").isNull(), "never_run"), (~F.col("r.ok"), "error"), (age > 2 * F.col("interval_minutes"), "stale")]
    return sources.join(last, "source_id", "left").select("source_id", first_match(ladder, "healthy").alias("health"))


def gate(df: DataFrame, enabled: bool = True) -> DataFrame:
    """Adds call (whether a model is asked) and why, by the first reason that holds.  ``df``: ambiguous, sport, league,
    event_type, n_entities, confidence, keyword (boolean), hint."""
    c, league, entities = F.col("confidence"), F.col("league").isNotNull(), F.col("n_entities") > 0
    hinted = (F.col("hint") == F.col("sport")) & (c >= 0.65)
    rules = [
        (F.lit(not enabled), "call:gating_disabled"),
        (F.col("ambiguous"), "call:ambiguous_club"),
        (F.col("sport") == "unknown", "call:sport_unknown"),
        (c < 0.55, "call:low_confidence"),
        (league & (c >= 0.65) & F.col("keyword"), "skip:league_keyword"),
        (hinted & (league | entities | (F.col("event_type") != "news")), "skip:hint"),
        (hinted, "call:hint_only"),
        (league & (c >= 0.80), "skip:league"),
        (entities & (F.col("event_type") != "news") & (c >= 0.75), "skip:entities"),
    ]
    verdict = F.split(first_match(rules, "call:default"), ":")
    return df.withColumn("call", verdict[0] == "call").withColumn("why", verdict[1])


def confidence(sport: Column, sure_source: Column, league: Column, n_entities: Column, event_type: Column) -> Column:
    """Additive confidence, capped at 0.95, to two places."""
    parts = F.lit(0.40) + F.when(sport != "unknown", 0.15).otherwise(0.0) + F.when(sure_source, 0.05).otherwise(0.0)
    parts = parts + F.when(league.isNotNull(), 0.15).otherwise(0.0) + F.when(n_entities > 0, 0.15).otherwise(0.0) + F.when(event_type != "news", 0.10).otherwise(0.0)
    return F.bround(F.least(F.lit(0.95), parts), 2)


def importance(event_type: Column, certainty: Column, tracked: Column, league: Column) -> Column:
    big = event_type.isin("grand_slam_winner", "finals_result", "title_win")
    deal = event_type.isin("signing", "negotiation", "injury", "major_trade", "major_transfer")
    return first_match(
        [
            (big & (certainty == "confirmed"), "very_high"),
            (big, "high"),
            (deal & (tracked | league.isin("NBA", "EuroLeague")), "high"),
            (deal, "medium"),
            (event_type.isin("schedule", "early_round_result"), "low"),
            ((event_type == "news") & ~tracked, "low"),
        ],
        "medium",
    )


def gating_benchmark(df: DataFrame) -> DataFrame:
    """Per source: calls without and with the gate, share skipped, change in unknown sports, and whether that passes
    (0.40 skipped or more, no new unknowns).  ``df``: source, call, base_unknown, gated_unknown."""
    skip = rate(F.count_if(~F.col("call")), F.count(F.lit(1)))
    more = F.count_if("gated_unknown") - F.count_if("base_unknown")
    return df.groupBy("source").agg(F.count(F.lit(1)).alias("n_base"), F.count_if("call").alias("n_gated"), skip.alias("skip_rate"), more.alias("unknown_change"), ((skip >= 0.40) & (more <= 0)).alias("passed"))


def constraint(source: Column, sport: Column, league: Column, disabled: tuple[str, ...], muted: tuple[str, ...], topics: tuple[str, ...]) -> Column:
    """The first hard constraint that hides an article, or null."""
    return first_match([(source.isin(*disabled), "source_disabled"), (source.isin(*muted), "source_muted"), (sport.isin(*topics) | league.isin(*topics), "topic_muted")])


def event_delta(requests: DataFrame, deltas: DataFrame, aliases: DataFrame) -> DataFrame:
    """The delta for each (request_id, scope, event_type): that of the scope for the event or, in order, one of its
    aliases, then the same without a scope; null if there is none.

    ``deltas``: scope (null: any), event_type, delta; ``aliases``: event_type, alias, pos (from 1)."""
    names = aliases.union(requests.select("event_type", F.col("event_type").alias("alias"), F.lit(0).alias("pos")).distinct())
    asked = requests.select("request_id", "scope", "event_type").join(names, "event_type")
    own = deltas.select(F.col("scope").alias("d_scope"), F.col("event_type").alias("alias"), "delta")
    scoped = asked.join(own.filter("d_scope IS NOT NULL"), (F.col("scope") == F.col("d_scope")) & (asked["alias"] == own["alias"])).select("request_id", F.lit(0).alias("wide"), "pos", "delta")
    anywhere = asked.join(own.filter("d_scope IS NULL").drop("d_scope"), "alias").select("request_id", F.lit(1).alias("wide"), "pos", "delta")
    best = scoped.union(anywhere).groupBy("request_id").agg(F.min(F.struct("wide", "pos", "delta")).alias("b"))
    return requests.join(best, "request_id", "left").select("request_id", F.col("b.delta").alias("delta"))


def as_of(rows: DataFrame, marks: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """Each row with the value of the latest mark of its key at or before its time, by one sort of both per key (no
    range join); of marks at one time the largest value counts.  Null before the first mark."""
    both = rows.withColumn("is_mark", F.lit(0)).unionByName(marks.select(by, at, F.col(value).alias("mark"), F.lit(1).alias("is_mark")), allowMissingColumns=True)
    upto = Window.partitionBy(by).orderBy(F.col(at), F.col("is_mark").desc(), "mark").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn(value, F.last("mark", ignorenulls=True).over(upto)).filter("is_mark = 0").drop("mark", "is_mark")


def dispatch(outbox: DataFrame, now: datetime, most: int = 10, base_minutes: int = 5, attempts: int = 5) -> DataFrame:
    """The oldest ``most`` events that are pending or retryable, with what to do: send, wait (its backoff, doubled by each
    attempt, is not over) or give_up.  Waiting events take places of the batch, as the limit comes first."""
    batch = outbox.filter(F.col("status").isin("pending", "retryable")).orderBy("created_at", "event_id").limit(most)
    passed = (F.unix_micros(F.lit(now)) - F.unix_micros("created_at")) / 60e6
    wait = F.lit(base_minutes) * F.pow(F.lit(2.0), F.col("attempts") - 1)
    return batch.withColumn("todo", first_match([(F.col("attempts") >= attempts, "give_up"), ((F.col("status") == "retryable") & (passed < wait), "wait")], "send"))


def disagreements(pairs: DataFrame, facts: DataFrame, least: float = 0.30) -> DataFrame:
    """Pairs of different sources with much in common whose facts differ: similarity and kinds (sorted).

    ``pairs`` as from ``candidate_pairs``, with source kept; ``facts``: article_id, sport, event_type, league."""
    side = lambda s: facts.select(F.col("article_id").alias(f"{s}_id"), F.struct("sport", "event_type", "league").alias(f"f{s}"))
    j = alike()
    both = pairs.filter((F.col("a.source") != F.col("b.source")) & (j >= least)).join(side("a"), "a_id").join(side("b"), "b_id")
    known = (F.col("fa.sport") != "unknown") & (F.col("fb.sport") != "unknown")
    kinds = F.array_compact(
        F.array(
            F.when(F.col("fa.event_type") != F.col("fb.event_type"), "event"),
            F.when(~F.col("fa.league").eqNullSafe(F.col("fb.league")), "league"),
            F.when(known & (F.col("fa.sport") != F.col("fb.sport")), "sport"),
            F.when(~known & (F.col("fa.sport") != F.col("fb.sport")), "sport_unknown"),
        )
    )
    return both.withColumn("kinds", F.array_join(kinds, ",")).filter("kinds <> ''").select("a_id", "b_id", F.round(j, 4).alias("similarity"), "kinds")


def replace_managed(rows: DataFrame, new: DataFrame, managed: Column) -> DataFrame:
    """The rows that are not managed here, and the new ones."""
    return rows.filter(~F.coalesce(managed, F.lit(False))).unionByName(new)


def presets(deltas: DataFrame, groups: DataFrame) -> DataFrame:
    """less or more per (user_id, group) if every event type of the group has that delta, else mixed.

    ``deltas``: user_id, event_type, delta; ``groups``: group, event_type."""
    size = groups.groupBy("group").agg(F.count_distinct("event_type").alias("n_types"))
    each = deltas.join(groups, "event_type").groupBy("user_id", "group").agg(F.count_distinct("event_type").alias("n"), F.min("delta").alias("low"), F.max("delta").alias("high")).join(size, "group")
    every = F.col("n") == F.col("n_types")
    return each.select("user_id", "group", first_match([(every & (F.col("high") == -1) & (F.col("low") == -1), "less"), (every & (F.col("low") == 1) & (F.col("high") == 1), "more")], "mixed").alias("preset"))
