"""Decisions about articles, feeds of them, and reports that compare decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import decision_rank


def label_decision(quality: Column, toxic: Column, lang: Column, home: str = "en") -> Column:
    """A decision by an ordered ladder; what is not known is low_feed, never taken for a zero."""
    return (
        F.when(toxic == 1, "hidden")
        .when(quality.isNull(), "low_feed")
        .when(quality == 0, "hidden")
        .when(lang == home, "high_feed")
        .otherwise("feed")
    )


def importance_decision(importance: Column, priority: Column) -> Column:
    """The fallback ladder by importance and topic priority; very_high below priority 80 is hidden."""
    return (
        F.when((importance == "very_high") & (priority >= 80), "high_feed")
        .when((importance == "high") & (priority >= 80), "feed")
        .when((importance == "medium") & (priority >= 70), "feed")
        .when(importance == "high", "feed")
        .when(importance == "medium", "low_feed")
        .when((importance == "low") & (priority >= 70), "low_feed")
        .otherwise("hidden")
    )


def affinity_decision(articles: DataFrame, affinities: DataFrame) -> DataFrame:
    """Score of each (user, article) from matching scopes: the base is the scope with most points, the broader of equals,
    a followed entity adds one to a broader base; 0 or less is hidden, 1 low_feed, 2 feed, 3 and more high_feed.

    ``articles``: article_id, sport, competition, entity; ``affinities``: user_id, scope (sport, competition, team),
    target, level.  A scope with level -2 excludes unless a narrower scope that matches does not."""
    keyed = articles.select("article_id", F.explode(F.array(*[F.struct(F.lit(s).alias("scope"), F.col(c).alias("target"), F.lit(n).alias("narrow")) for s, c, n in (("sport", "sport", 1), ("competition", "competition", 2), ("team", "entity", 3))])).alias("k")).select("article_id", "k.*")
    met = affinities.join(keyed, ["scope", "target"])
    points = F.when(F.col("level") >= 0, F.col("level") + 1).otherwise(F.lit(0))
    best = F.max(F.when(F.col("level") > -2, F.struct(points.alias("points"), (-F.col("narrow")).alias("broad"))))
    out = met.groupBy("user_id", "article_id").agg(
        best.alias("best"),
        F.max(F.when(F.col("level") == -2, F.col("narrow"))).alias("excluded_at"),
        F.max(F.when(F.col("level") > -2, F.col("narrow"))).alias("allowed_at"),
        F.max((F.col("scope") == "team") & (F.col("level") >= 1)).alias("followed"),
    )
    excluded = F.col("excluded_at").isNotNull() & (F.coalesce("allowed_at", F.lit(0)) <= F.col("excluded_at"))
    boost = F.when(F.col("followed") & (F.col("best.broad") > -3), 1).otherwise(0)
    score = F.when(excluded, F.lit(0)).otherwise(F.coalesce(F.col("best.points"), F.lit(0)) + boost)
    decision = F.when(score <= 0, "hidden").when(score == 1, "low_feed").when(score == 2, "feed").otherwise("high_feed")
    return out.select("user_id", "article_id", score.cast("int").alias("score"), decision.alias("decision"))


def ranked(df: DataFrame, most: int | None = None) -> DataFrame:
    """Feed order: decision, then time, both falling, then id; a top-k report if ``most`` is given."""
    out = df.orderBy(decision_rank(F.col("decision")).desc(), F.col("published_at").desc(), F.col("article_id"))
    return out.limit(most) if most is not None else out


def cards(scored: DataFrame) -> DataFrame:
    """One row per visible cluster: the best decision, distinct visible sources, latest time, visible members and the
    displayed member.  ``scored``: cluster_id, article_id, source, published_at, decision; a cluster all of whose members
    are hidden gives none."""
    seen = scored.filter("decision <> 'hidden'").withColumn("rank", decision_rank(F.col("decision")))
    by = Window.partitionBy("cluster_id").orderBy(F.col("rank").desc(), F.col("published_at").desc(), "article_id")
    first = seen.withColumn("place", F.row_number().over(by)).filter("place = 1").select("cluster_id", F.col("article_id").alias("displayed"), "decision")
    rest = seen.groupBy("cluster_id").agg(F.count_distinct("source").alias("n_sources"), F.max("published_at").alias("sort_at"), F.count(F.lit(1)).alias("n_visible"))
    return first.join(rest, "cluster_id")


def shadow_report(both: DataFrame) -> DataFrame:
    """Agreement of two decisions per row (old, new): counts, rate to 4 places, promoted, demoted and pushes."""
    old, new = decision_rank(F.col("old")), decision_rank(F.col("new"))
    n = F.count(F.lit(1))
    return both.agg(
        n.alias("n"),
        F.count_if(old == new).alias("n_same"),
        F.bround(F.count_if(old == new) / n, 4).alias("same_rate"),
        F.count_if(new > old).alias("n_promoted"),
        F.count_if(new < old).alias("n_demoted"),
        F.count_if(F.col("old") == "high_feed").alias("n_high_old"),
        F.count_if(F.col("new") == "high_feed").alias("n_high_new"),
    )


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """What a full outer join of two snapshots shows: removed, added or changed keys; equal ones are left out."""
    b, a = before.select(key, F.col(value).alias("before")), after.select(key, F.col(value).alias("after"))
    kind = F.when(F.col("after").isNull(), "removed").when(F.col("before").isNull(), "added").otherwise("changed")
    return b.join(a, key, "full_outer").filter(~F.col("before").eqNullSafe(F.col("after"))).select(key, "before", "after", kind.alias("change"))
