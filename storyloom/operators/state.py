"""State kept as tables: what the latest of several rows says, tombstones, seeding, planned and planted events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The row with the largest ``order`` of each key: upserts and set/clear overrides as appended rows."""
    by = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return df.withColumn("place", F.row_number().over(by)).filter("place = 1").drop("place")


def effective_enabled(sources: DataFrame, overrides: DataFrame) -> DataFrame:
    """source_id, enabled (its latest override, else its own default) and whether it is overridden; an override of null
    clears the one before.  ``sources``: source_id, enabled; ``overrides``: source_id, enabled, at."""
    own = latest(overrides, ["source_id"], "at").select("source_id", F.col("enabled").alias("set_to"))
    return sources.join(own, "source_id", "left").select("source_id", F.coalesce("set_to", "enabled").alias("enabled"), F.col("set_to").isNotNull().alias("overridden"))


def active_events(events: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Events that their own user has not retracted (a tombstone of another user does nothing)."""
    return events.join(tombstones.select("user_id", "event_id").distinct(), ["user_id", "event_id"], "left_anti")


def responses(answers: DataFrame, version: int) -> DataFrame:
    """The latest answer per (user_id, item_id) of one version of the items; older versions are not read."""
    return latest(answers.filter(F.col("version") == version), ["user_id", "item_id"], "at", "answer_id")


def seeded(existing: DataFrame, seed: DataFrame) -> DataFrame:
    """``existing`` if it has any row, else ``seed``."""
    return seed if existing.isEmpty() else existing


def pushed(cards: DataFrame, members: DataFrame) -> DataFrame:
    """cluster_id, displayed and all members (sorted), hidden ones too, of the cards whose decision is push."""
    own = members.join(cards.filter("decision = 'push'").select("cluster_id", "displayed"), "cluster_id")
    return own.groupBy("cluster_id", "displayed").agg(F.array_sort(F.collect_set("article_id")).alias("members"))


def governing(stories: DataFrame, lineage: DataFrame) -> DataFrame:
    """story_id, the event that governs it, the earliest of those that claim one of its members (the smallest id of
    equals), and how many claim any.  ``stories``: story_id, article_id; ``lineage``: article_id, event_id, created_at."""
    met = stories.join(lineage, "article_id").select("story_id", "event_id", "created_at").distinct()
    return met.groupBy("story_id").agg(F.min(F.struct("created_at", "event_id")).getField("event_id").alias("governing"), F.count_distinct("event_id").alias("n_events"))


def planted(stories: DataFrame, events: DataFrame, status: str = "suppressed_watermark") -> DataFrame:
    """story_id and status of an event for every story that has none yet, so that only later stories are told; a second
    run plants nothing."""
    return stories.select("story_id").distinct().join(events.select("story_id").distinct(), "story_id", "left_anti").withColumn("status", F.lit(status))


def refuse_overwrite(spark: SparkSession, path: str, force: bool = False) -> None:
    """Raises if there is anything at ``path``, unless forced."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not force and place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        raise FileExistsError(f"{path} holds a protected table; force to replace it")


def repaired(members: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clusters, members) after articles have gone: clusters of fewer than two are removed, and the earliest survivor is
    anchor and representative.  ``members``: cluster_id, article_id, published_at."""
    left = members.join(gone.select("article_id").distinct(), "article_id", "left_anti")
    first = F.min(F.struct("published_at", "article_id")).getField("article_id")
    clusters = left.groupBy("cluster_id").agg(first.alias("anchor"), F.count(F.lit(1)).alias("n_members")).filter("n_members > 1").withColumn("representative", F.col("anchor"))
    return clusters, left.join(clusters.select("cluster_id"), "cluster_id", "left_semi")


def window_with_closure(articles: DataFrame, members: DataFrame, new: DataFrame, hours: int = 48) -> DataFrame:
    """article_id of the articles within ``hours`` of the new ones' first and last times, and of all members of clusters
    that these touch.  The times of the new articles are two values; null times are outside."""
    span = new.agg(F.min("published_at").alias("lo"), F.max("published_at").alias("hi"))
    near = articles.join(F.broadcast(span), F.col("published_at").between(F.col("lo") - F.expr(f"INTERVAL {int(hours)} HOURS"), F.col("hi") + F.expr(f"INTERVAL {int(hours)} HOURS"))).select("article_id")
    touched = members.join(near, "article_id", "left_semi").select("cluster_id").distinct()
    return near.union(members.join(touched, "cluster_id", "left_semi").select("article_id")).distinct()
