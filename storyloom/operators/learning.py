"""Learning from feedback, preference authority and calibration."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def learned_features(events: DataFrame, weights: dict[str, float], now: datetime, half_life_days: float = 90.0, active_from: float = 3.0) -> DataFrame:
    """Decayed net weight per (user_id, feature), rounded to 3 places; active is tested on the rounded net.

    ``events``: user_id, feature, event_type, ts; ages below zero count as zero, events without weight do not count."""
    w = F.lit(None).cast("double")
    for kind, value in weights.items():
        w = F.when(F.col("event_type") == kind, F.lit(float(value))).otherwise(w)
    age = F.greatest(F.lit(0.0), (F.unix_micros(F.lit(now)) - F.unix_micros("ts")) / F.lit(86400e6))
    net = F.bround(F.sum(w * F.pow(F.lit(0.5), age / half_life_days)), 3)
    out = events.filter(w.isNotNull()).groupBy("user_id", "feature").agg(net.alias("net"), F.count(F.lit(1)).alias("n_events"))
    return out.withColumn("active", F.abs("net") >= active_from)


def effective(affinities: DataFrame) -> DataFrame:
    """The affinity that counts per (user_id, scope, target): explicit over learned over calibration, the last of equals.

    ``affinities``: user_id, scope, target, level, origin, pos."""
    authority = F.when(F.col("origin") == "explicit", 3).when(F.col("origin") == "learned", 2).otherwise(1)
    by = Window.partitionBy("user_id", "scope", "target").orderBy(authority.desc(), F.col("pos").desc())
    return affinities.withColumn("place", F.row_number().over(by)).filter("place = 1").drop("place")


def calibration_stats(ratings: DataFrame, keys: list[str], value: str = "rating", least: int = 2, contradictory: float = 1.2) -> DataFrame:
    """n, mean, sample deviation (0 for one rating), whether there is enough, whether ratings contradict each other, and
    the guarded level: the half-even rounded median within -2..2, -2 only if two ratings are -2 and none is 0 or more, and one
    step towards 0 if both camps have two."""
    v = F.col(value)
    low, high = F.count_if(v < 0), F.count_if(v > 0)
    level = F.greatest(F.lit(-2), F.least(F.lit(2), F.bround(F.percentile(v, F.lit(0.5)), 0).cast("int")))
    out = ratings.groupBy(*keys).agg(
        F.count(v).alias("n"),
        F.avg(v).alias("mean"),
        F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("spread"),
        level.alias("median_level"),
        F.count_if(v == -2).alias("n_never"),
        F.count_if(v >= 0).alias("n_not_negative"),
        low.alias("n_low"),
        high.alias("n_high"),
    )
    strict = F.when((F.col("median_level") == -2) & ~((F.col("n_never") >= 2) & (F.col("n_not_negative") == 0)), F.lit(-1)).otherwise(F.col("median_level"))
    split = (F.col("n_low") >= 2) & (F.col("n_high") >= 2)
    guarded = F.when(split & (strict > 0), strict - 1).when(split & (strict < 0), strict + 1).otherwise(strict)
    return out.select(*keys, "n", F.bround("mean", 4).alias("mean"), F.bround("spread", 4).alias("spread"), (F.col("n") >= least).alias("enough"), (F.col("spread") >= contradictory).alias("contradictory"), guarded.alias("level"))


def event_deltas(ratings: DataFrame, scope: str, kind: str, value: str = "rating", least: int = 2) -> DataFrame:
    """delta per (scope, kind): mean of the kind less mean of the scope, half-even, within -2..2; zeros are left out."""
    by_scope = ratings.groupBy(scope).agg(F.avg(value).alias("scope_mean"))
    each = ratings.groupBy(scope, kind).agg(F.avg(value).alias("kind_mean"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    delta = F.greatest(F.lit(-2), F.least(F.lit(2), F.bround(F.bround(F.col("kind_mean") - F.col("scope_mean"), 9), 0).cast("int")))
    return each.join(by_scope, scope).select(scope, kind, "n", delta.alias("delta")).filter("delta <> 0")


def participants(entities: DataFrame, memberships: DataFrame) -> DataFrame:
    """article_id and the one competition all of an article's entities (two at least) are members of.

    ``entities``: article_id, entity; ``memberships``: entity, competition.  Articles whose entities share none or more
    than one abstain."""
    own = entities.select("article_id", "entity").distinct()
    size = own.groupBy("article_id").agg(F.count(F.lit(1)).alias("n_entities")).filter("n_entities >= 2")
    shared = own.join(memberships.select("entity", "competition").distinct(), "entity").groupBy("article_id", "competition").agg(F.count(F.lit(1)).alias("n"))
    common = shared.join(size, "article_id").filter("n = n_entities")
    return common.groupBy("article_id").agg(F.min("competition").alias("competition"), F.count(F.lit(1)).alias("n")).filter("n = 1").select("article_id", "competition")
