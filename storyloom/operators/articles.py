"""Filters and de-duplication of articles."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import language_of_url


def dedup(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the smallest ``order`` of each ``key``, with the number of rows of that key (n_copies); of rows that
    share key and order one stays, and a null order stands behind all others.

    Keys are grouped by a digest, so that a hot or very long key moves no text, and partly before the shuffle; null keys
    form one group."""
    k = F.coalesce(F.concat(F.lit("+"), F.sha2(F.col(key).cast("string"), 256)), F.lit("-"))
    at = F.col(order)
    marked = df.withColumn("dedup_digest", k).withColumn("dedup_row", F.monotonically_increasing_id())
    firsts = marked.groupBy("dedup_digest").agg(F.min(F.struct(at.isNull().alias("none"), at.alias("at"), "dedup_row")).alias("f"), F.count(F.lit(1)).alias("n_copies"))
    return marked.join(firsts.select("dedup_digest", F.col("f.dedup_row").alias("dedup_row"), "n_copies"), ["dedup_digest", "dedup_row"]).drop("dedup_digest", "dedup_row")


def new_only(df: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in the history."""
    return df.join(seen.select(key).distinct(), key, "left_anti")


def fresh(df: DataFrame, now: datetime, hours: int = 36, at: str = "published_at") -> DataFrame:
    """Rows published at ``now`` less ``hours`` or later, the bound included; the future is fresh, null is not."""
    return df.filter(F.col(at) >= F.lit(now) - F.expr(f"INTERVAL {int(hours)} HOURS"))


def normalised_time(df: DataFrame, now: datetime, slack_minutes: int = 15, at: str = "published_at") -> DataFrame:
    """Adds at_used and at_note: a missing time becomes ``now`` (ingest_fallback), one over ``slack_minutes`` ahead of it
    is clamped to it (clamped_future)."""
    ahead = F.col(at) > F.lit(now) + F.expr(f"INTERVAL {int(slack_minutes)} MINUTES")
    return df.withColumn("at_used", F.when(F.col(at).isNull() | ahead, F.lit(now)).otherwise(F.col(at))).withColumn(
        "at_note", F.when(F.col(at).isNull(), "ingest_fallback").when(ahead, "clamped_future")
    )


def source_filter(df: DataFrame, blocked: tuple[str, ...] = (), allowed: tuple[str, ...] = (), languages: tuple[str, ...] = (), url: str = "url") -> DataFrame:
    """URLs that hold no blocked part, one of the allowed parts if there are any, and an allowed language if there are."""
    u = F.coalesce(F.col(url), F.lit(""))
    keep = F.lit(True)
    for part in blocked:
        keep = keep & ~u.contains(part)
    if allowed:
        one = F.lit(False)
        for part in allowed:
            one = one | u.contains(part)
        keep = keep & one
    if languages:
        keep = keep & language_of_url(F.col(url)).isin(*languages)
    return df.filter(keep)


def without_dismissed(df: DataFrame, feedback: DataFrame, actions=("less_like_this", "not_interested", "never_show")) -> DataFrame:
    """Articles without an active (not retracted) negative feedback event."""
    gone = feedback.filter(F.col("action").isin(*actions) & ~F.coalesce("retracted", F.lit(False))).select("article_id").distinct()
    return df.join(gone, "article_id", "left_anti")


def retention(df: DataFrame, members: DataFrame, referenced: DataFrame, now: datetime, days: int = 30) -> DataFrame:
    """Adds retained_because to each article: fresh, live_cluster (a member of its cluster is fresh), feedback, or null if
    it may go.  ``days`` below 7 count as 7."""
    cutoff = F.lit(now) - F.expr(f"INTERVAL {max(7, int(days))} DAYS")
    kept = df.filter(F.col("published_at") >= cutoff)
    live = members.join(kept.select("article_id"), "article_id", "left_semi").select("cluster_id").distinct()
    safe = members.join(live, "cluster_id", "left_semi").select("article_id").distinct().withColumn("in_live", F.lit(True))
    used = referenced.select("article_id").distinct().withColumn("in_feedback", F.lit(True))
    return (
        df.join(safe, "article_id", "left")
        .join(used, "article_id", "left")
        .withColumn("retained_because", F.when(F.col("published_at") >= cutoff, "fresh").when(F.col("in_live"), "live_cluster").when(F.col("in_feedback"), "feedback"))
        .drop("in_live", "in_feedback")
    )


def plan_stories(stories: DataFrame, lineage: DataFrame) -> DataFrame:
    """Stories none of whose members was told before; of new stories that share a member only the one with the smallest
    (first_at, story_id) is planned.  ``stories``: story_id, first_at, members (array); ``lineage``: article_id."""
    each = stories.select("story_id", "first_at", F.explode("members").alias("article_id"))
    claimed = each.join(lineage.select("article_id").distinct(), "article_id", "left_semi").select("story_id").distinct()
    new = each.join(claimed, "story_id", "left_anti")
    first = new.groupBy("article_id").agg(F.min(F.struct("first_at", "story_id")).alias("f")).select("article_id", F.col("f.story_id").alias("winner"))
    losing = new.join(first, "article_id").filter("winner <> story_id").select("story_id").distinct()
    return stories.join(claimed, "story_id", "left_anti").join(losing, "story_id", "left_anti")
