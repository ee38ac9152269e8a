"""Status reports, coverage and before/after comparisons; each is one or two aggregations."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import rate

# Statuses of notification events and of scheduler cycles.
FAILED_DELIVERY = ("failed_retryable", "failed_final", "unknown")
STATUSES = ("pending", "sent", "failed_final", "failed_retryable", "unknown", "claimed", "suppressed_watermark")
FAILED_CYCLE, SKIPPED, RUNNING = ("failed", "abandoned"), "skipped_active_run", "running"
SUCCEEDED = ("succeeded", "succeeded_with_warnings")


def _age(now: datetime, at: Column) -> Column:
    return (F.unix_micros(F.lit(now)) - F.unix_micros(at)) / F.lit(1e6)


def leading_failures(rows: DataFrame, order: list[Column], failed: Column, most: int = 20) -> DataFrame:
    """consecutive_failures: how many of the newest ``most`` rows fail before the first that does not (a top-k report)."""
    newest = rows.select(failed.alias("failed"), *[c.alias(f"o{i}") for i, c in enumerate(order)]).orderBy(*[F.col(f"o{i}").desc() for i in range(len(order))]).limit(most)
    upto = Window.orderBy(*[F.col(f"o{i}").desc() for i in range(len(order))]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return newest.withColumn("broken", F.sum((~F.col("failed")).cast("int")).over(upto)).agg(F.count_if(F.col("broken") == 0).alias("consecutive_failures"))


def delivery_status(events: DataFrame, now: datetime) -> DataFrame:
    """One row: a count per status, the age of the oldest pending event in seconds, the last delivery and how many of the
    latest attempts failed in a row.  ``events``: event_id, status, created_at, last_attempt_at, final_at."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    whole = events.agg(
        *counts,
        _age(now, F.min(F.when(F.col("status") == "pending", F.col("created_at")))).alias("oldest_pending_seconds"),
        F.max(F.when(F.col("status") == "sent", F.col("final_at"))).alias("last_delivery"),
    )
    return whole.crossJoin(leading_failures(events.filter("last_attempt_at IS NOT NULL"), [F.col("last_attempt_at"), F.col("event_id")], F.col("status").isin(*FAILED_DELIVERY)))


def scheduler_health(cycles: DataFrame, now: datetime, interval_s: int = 300, most_run_s: int = 1800) -> DataFrame:
    """One row: last cycle attempted, last that succeeded and its age, failures in a row, whether it is stale (the last
    success is older than three times interval and longest run) and degraded.  ``cycles``: cycle_id, status,
    requested_at, finished_at; skipped cycles are no attempts, running ones break no streak."""
    tried, won = F.col("status") != SKIPPED, F.col("status").isin(*SUCCEEDED)
    whole = cycles.agg(
        F.max(F.when(tried, F.struct("requested_at", "cycle_id"))).getField("cycle_id").alias("last_attempted"),
        F.max(F.when(won, F.struct("finished_at", "cycle_id"))).getField("cycle_id").alias("last_successful"),
        _age(now, F.max(F.when(won, F.col("finished_at")))).alias("success_age_seconds"),
    )
    streak = leading_failures(cycles.filter(~F.col("status").isin(SKIPPED, RUNNING)), [F.col("requested_at"), F.col("cycle_id")], F.col("status").isin(*FAILED_CYCLE))
    stale = F.coalesce(F.col("success_age_seconds") > 3 * (interval_s + most_run_s), F.lit(False))
    return whole.crossJoin(streak).withColumn("stale", stale).withColumn("degraded", F.col("stale") | (F.col("consecutive_failures") > 0))


def article_counters(df: DataFrame, by: str) -> DataFrame:
    """Per ``by``: articles, those without a sport, tagged ambiguous, with a conflict, conflicts won by stronger evidence,
    and events that were corrected.  ``df``: sport, tags (array), conflicts (array of structs with rule),
    event_type and proposed (event type before correction)."""
    won = F.size(F.filter(F.coalesce("conflicts", F.array()), lambda c: c["rule"] == "weighted_evidence_override"))
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("sport") == "unknown").alias("n_abstained"),
        F.count_if(F.array_contains("tags", "ambiguous_club")).alias("n_ambiguous"),
        F.count_if(F.size(F.coalesce("conflicts", F.array())) > 0).alias("n_conflict"),
        F.sum(won).alias("n_overrides"),
        F.count_if(F.col("proposed") != F.col("event_type")).alias("n_corrected"),
    )


def throughput(runs: DataFrame, by: str, cost_each: float) -> DataFrame:
    """Per ``by``: items, seconds between first and last, items a second, share of failures and cost; rates are null where
    their denominator is not positive.  ``runs``: at, ok, calls."""
    seconds = (F.unix_micros(F.max("at")) - F.unix_micros(F.min("at"))) / F.lit(1e6)
    n = F.count(F.lit(1))
    return runs.groupBy(by).agg(
        n.alias("n"), seconds.alias("seconds"), rate(n, seconds).alias("per_second"), rate(F.count_if(~F.col("ok")), n).alias("failed_rate"),
        F.bround(F.sum("calls") * F.lit(cost_each), 4).alias("cost"), rate(F.sum("calls") * F.lit(cost_each), F.count_if("ok")).alias("cost_per_ok"),
    )


def coverage(items: DataFrame, scopes: DataFrame) -> DataFrame:
    """Per scope: items, distinct event types and importances, and whether a selectable scope is below contract (4 items,
    3 event types, 2 importances); selectable scopes without items are listed, too.

    ``items``: scope, event_type, importance; ``scopes``: scope, selectable."""
    n = items.groupBy("scope").agg(F.count(F.lit(1)).alias("n_items"), F.count_distinct("event_type").alias("n_events"), F.count_distinct("importance").alias("n_importances"))
    every = scopes.join(n, "scope", "full_outer").fillna(0, ["n_items", "n_events", "n_importances"]).withColumn("selectable", F.coalesce("selectable", F.lit(False)))
    below = F.col("selectable") & ((F.col("n_items") < 4) | (F.col("n_events") < 3) | (F.col("n_importances") < 2))
    return every.filter("selectable OR n_items > 0").withColumn("below", below)


def entity_contrast(ratings: DataFrame, least: float = 0.5) -> DataFrame:
    """Per entity: mean rating of items with it, mean of the items without entities in the same groups, and their
    difference where it is at least ``least``.  ``ratings``: grp, entities (array), rating."""
    with_entity = ratings.select("grp", "rating", F.explode("entities").alias("entity"))
    plain = ratings.filter(F.size("entities") == 0).groupBy("grp").agg(F.sum("rating").alias("s"), F.count(F.lit(1)).alias("c"))
    base = with_entity.select("entity", "grp").distinct().join(plain, "grp").groupBy("entity").agg((F.sum("s") / F.sum("c")).alias("baseline"))
    own = with_entity.groupBy("entity").agg(F.avg("rating").alias("mean"))
    return own.join(base, "entity").withColumn("contrast", F.col("mean") - F.col("baseline")).filter(F.abs("contrast") >= least)


def cluster_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """change (created, removed, changed, retained), size and how many clusters: two snapshots of (cluster_id, article_id)
    compared by their sorted members; size is the later one, or that before for removed ones."""
    side = lambda d, name: d.groupBy("cluster_id").agg(F.array_sort(F.collect_set("article_id")).alias(name))
    both = side(before, "b").join(side(after, "a"), "cluster_id", "full_outer")
    change = F.when(F.col("b").isNull(), "created").when(F.col("a").isNull(), "removed").when(F.col("a") != F.col("b"), "changed").otherwise("retained")
    return both.groupBy(change.alias("change"), F.size(F.coalesce("a", "b")).cast("long").alias("size")).agg(F.count(F.lit(1)).alias("n"))


def transitions(before: DataFrame, after: DataFrame, key: str, values: list[str]) -> DataFrame:
    """How many rows of both snapshots went from which values to which; rows that stayed are left out."""
    b = before.select(key, *[F.col(v).alias(f"{v}_before") for v in values])
    a = after.select(key, *[F.col(v).alias(f"{v}_after") for v in values])
    moved = ~F.struct(*[f"{v}_before" for v in values]).eqNullSafe(F.struct(*[F.col(f"{v}_after").alias(f"{v}_before") for v in values]))
    return b.join(a, key).filter(moved).groupBy(*[f"{v}_{s}" for v in values for s in ("before", "after")]).agg(F.count(F.lit(1)).alias("n"))


def newest(df: DataFrame, at: str, key: str, most: int = 50) -> DataFrame:
    """The ``most`` (1 to 200) newest rows, a top-k report; ties by key."""
    return df.orderBy(F.col(at).desc(), F.col(key)).limit(max(1, min(200, most)))


def counts_by(df: DataFrame, dims: list[str]) -> DataFrame:
    """dim, value (null: unknown) and n for several dimensions in one pass."""
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.coalesce(F.col(d).cast("string"), F.lit("unknown")).alias("value")) for d in dims]))
    return df.select(each.alias("e")).groupBy("e.dim", "e.value").agg(F.count(F.lit(1)).alias("n"))
