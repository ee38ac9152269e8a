"""What a reader picks and sees: filters, the edition, selectable interests and suggestions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import decision_rank


def any_of(df: DataFrame, filters: dict[str, Column], active: list[str]) -> DataFrame:
    """Rows that one of the active filters lets through; "all", or none active, lets every row through."""
    if not active or "all" in active:
        return df
    keep = F.lit(False)
    for name in active:
        keep = keep | F.coalesce(filters[name], F.lit(False))
    return df.filter(keep)


def edition(df: DataFrame) -> DataFrame:
    """Adds section and place of each visible article in its feed order (``at`` of df): the first push leads and the
    other pushes are bulletins; without a push the first high_feed leads; feed is the stream, low_feed the briefs."""
    seen = df.filter(F.col("decision") != "hidden").withColumn("rank", decision_rank(F.col("decision")))
    top = seen.agg(F.max("rank").alias("top"))
    by = Window.partitionBy("rank").orderBy("at")
    placed = seen.withColumn("place", F.row_number().over(by)).join(F.broadcast(top))
    leads = (F.col("rank") == F.col("top")) & (F.col("rank") >= 3) & (F.col("place") == 1)
    section = F.when(leads, "lead").when(F.col("rank") == 4, "bulletins").when(F.col("rank") == 3, "editorial").when(F.col("rank") == 2, "stream").otherwise("briefs")
    return placed.withColumn("section", section).drop("rank", "top")


def recent_or_all(df: DataFrame, now: datetime | Column, hours: int = 24, at: str = "published_at") -> DataFrame:
    """The rows of the last ``hours``, or all rows if there are none, with ``fallback`` saying which."""
    cut = F.lit(now) - F.expr(f"INTERVAL {int(hours)} HOURS")
    some = df.agg(F.coalesce(F.max(F.col(at) >= cut), F.lit(False)).alias("some"))
    return df.join(F.broadcast(some)).filter(~F.col("some") | (F.col(at) >= cut)).withColumn("fallback", ~F.col("some")).drop("some")


def suspicious(df: DataFrame, broad: tuple[str, ...], sport: str, signals: tuple[str, ...]) -> DataFrame:
    """Articles of broad sources that were given ``sport`` though their title holds a signal of another one."""
    title = F.lower(F.coalesce("title", F.lit("")))
    hit = F.lit(False)
    for s in signals:
        hit = hit | title.contains(s)
    return df.filter(F.col("source").isin(*broad) & (F.col("sport") == sport) & hit)


def selectable(targets: DataFrame, catalog: DataFrame, sports: tuple[str, ...], closed: tuple[str, ...]) -> DataFrame:
    """Adds selectable to (scope, target): listed sports, competitions of the catalog that are not closed, and teams and
    players of the catalog.  ``catalog``: kind (competition, team, player), target."""
    known = catalog.select(F.col("kind").alias("scope"), "target").distinct().withColumn("known", F.lit(True))
    found = F.coalesce("known", F.lit(False))
    allowed = F.when(F.col("scope") == "sport", F.col("target").isin(*sports)).when(F.col("scope") == "competition", found & ~F.col("target").isin(*closed)).when(F.col("scope").isin("team", "player"), found).otherwise(False)
    return targets.join(known, ["scope", "target"], "left").withColumn("selectable", F.coalesce(allowed, F.lit(False))).drop("known")


def offered_teams(teams: DataFrame, members: DataFrame, follows: DataFrame) -> DataFrame:
    """user_id and team: teams of a competition that the user follows, and of followed sports in whose name the user
    follows no competition.  ``teams``: team, sport; ``members``: team, competition, sport; ``follows``: user_id, scope, target."""
    comps = follows.filter("scope = 'competition'").select("user_id", F.col("target").alias("competition"))
    by_comp = members.join(comps, "competition").select("user_id", "team", "sport")
    covered = members.join(comps, "competition").select("user_id", "sport").distinct()
    sports = follows.filter("scope = 'sport'").select("user_id", F.col("target").alias("sport")).join(covered, ["user_id", "sport"], "left_anti")
    return by_comp.select("user_id", "team").union(teams.join(sports, "sport").select("user_id", "team")).distinct()


def suggestions(follows: DataFrame, parents: DataFrame, most: int = 4) -> DataFrame:
    """user_id, scope, target and place of broader interests of what a user follows, in the order of the follows, without
    those followed already and without repeats, the first ``most``.

    ``follows``: user_id, scope, target, pos; ``parents``: scope, target, p_scope, p_target, ord."""
    met = follows.join(parents, ["scope", "target"]).groupBy("user_id", "p_scope", "p_target").agg(F.min(F.struct("pos", "ord")).alias("first"))
    new = met.select("user_id", F.col("p_scope").alias("scope"), F.col("p_target").alias("target"), "first").join(follows.select("user_id", "scope", "target"), ["user_id", "scope", "target"], "left_anti")
    by = Window.partitionBy("user_id").orderBy("first", "scope", "target")
    return new.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= most).drop("first")


def curated_order(df: DataFrame, curated: DataFrame, key: str, then: str) -> DataFrame:
    """Adds place: curated rows by their position, the others behind them by ``then`` and key."""
    by = Window.orderBy(F.coalesce("pos", F.lit(1 << 30)), F.col(then), F.col(key))
    return df.join(F.broadcast(curated.select(key, "pos")), key, "left").withColumn("place", F.row_number().over(by)).drop("pos")


def first_of_each(*lists: Column) -> Column:
    """The lists one behind the other, each value where it stands first; null lists are empty."""
    return F.array_distinct(F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in lists]))
