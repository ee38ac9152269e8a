"""Run quality: rates, percentiles, latest runs and streaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import exact_sum, rate


def breakdowns(df: DataFrame, dims: list[str], unknown: str = "unknown") -> DataFrame:
    """dim, value and n for each dimension in one pass; nulls count as ``unknown``.

    Rows are counted by the full combination first, so no dimension's hot value meets in one task uncounted."""
    cells = df.groupBy(*[F.coalesce(F.col(d).cast("string"), F.lit(unknown)).alias(d) for d in dims]).agg(F.count(F.lit(1)).alias("n"))
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).alias("value")) for d in dims]))
    return cells.select(pairs.alias("p"), "n").groupBy("p.dim", "p.value").agg(F.sum("n").alias("n"))


def run_metrics(runs: DataFrame, by: list[str], ok: Column, value: str) -> DataFrame:
    """Per group: runs, failures, failure rate (null without runs), mean and nearest-rank 95th percentile of ``value``.

    The mean is of an exact sum: halves round up in any order of the rows."""
    return runs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.count_if(~ok).alias("n_failed"),
        rate(F.count_if(~ok), F.count(F.lit(1))).alias("failure_rate"),
        F.round(F.when(F.count(value) > 0, exact_sum(F.col(value)) / F.count(value)), 1).alias("mean"),
        F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {value})").alias("p95"),
    )


def latest(runs: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """The newest row of each key, ties to the largest ``tie``; grouped, so a hot key is reduced before it is shuffled."""
    rest = [c for c in runs.columns if c != key]
    newest = F.max_by(F.struct(*rest), F.struct(at, tie)).alias("r")
    return runs.groupBy(key).agg(newest).select(key, "r.*")


def failure_streak(runs: DataFrame, key: str, at: str, tie: str, failed: Column, most: int = 20) -> DataFrame:
    """How many of a key's newest rows (of ``most``) failed before one that did not."""
    newest = Window.partitionBy(key).orderBy(F.col(at).desc(), F.col(tie).desc())
    recent = runs.withColumn("place", F.row_number().over(newest)).filter(F.col("place") <= most)
    first_ok = F.min(F.when(~failed, F.col("place")))
    return recent.groupBy(key).agg((F.coalesce(first_ok, F.max("place") + 1) - 1).cast("long").alias("streak"))


def age_histogram(df: DataFrame, hours: Column, edges=(12, 24, 36)) -> DataFrame:
    """Counts by age class; a bound belongs to the lower class, and what lies ahead has a class of its own."""
    label = F.lit(f">{edges[-1]}")
    for low, high in reversed(list(zip((0, *edges), edges))):
        label = F.when(hours <= high, f"{low}-{high}").otherwise(label)
    label = F.when(hours < 0, "future").otherwise(label)
    return df.groupBy(label.alias("age")).agg(F.count(F.lit(1)).alias("n"))


def confusion(pairs: DataFrame, truth: DataFrame, keys=("a_id", "b_id")) -> DataFrame:
    """Accepted pairs against true ones: tp, fp and fn."""
    p = pairs.select(*keys).distinct().withColumn("said", F.lit(1))
    t = truth.select(*keys).distinct().withColumn("true", F.lit(1))
    both = p.join(t, list(keys), "full_outer")
    return both.agg(F.count_if(F.col("said").isNotNull() & F.col("true").isNotNull()).alias("tp"), F.count_if(F.col("true").isNull()).alias("fp"), F.count_if(F.col("said").isNull()).alias("fn"))


def copy_confusion(pairs: DataFrame, owners: DataFrame, keys=("a_id", "b_id")) -> DataFrame:
    """Accepted pairs against pairs of copies: tp, fp and fn.  ``owners``: article_id and h, equal for copies; a null is
    nobody's copy.

    The pairs of copies are counted by group, never made, so a group of any size costs one row; found pairs look up both
    their sides."""
    own = owners.filter("article_id IS NOT NULL AND h IS NOT NULL").select("article_id", "h").distinct()
    truth = own.groupBy("h").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).alias("n_true"))
    a, b = keys
    said = pairs.select(a, b).distinct()
    sides = said.join(own.select(F.col("article_id").alias(a), F.col("h").alias("ha")), a, "left").join(own.select(F.col("article_id").alias(b), F.col("h").alias("hb")), b, "left")
    found = sides.agg(F.count(F.lit(1)).alias("n_said"), F.count_if(F.col("ha") == F.col("hb")).alias("tp"))
    return found.crossJoin(truth).select("tp", (F.col("n_said") - F.col("tp")).alias("fp"), (F.col("n_true") - F.col("tp")).alias("fn"))


def delivery_outcome(status: Column, error: Column) -> Column:
    """What a send attempt means: sent, failed, retryable or unknown (never sent again by itself)."""
    return (
        F.when(status.between(200, 299), "sent")
        .when(status.isin(400, 401, 403, 404), "failed")
        .when((status == 429) | (status >= 500), "retryable")
        .when(error == "connect", "retryable")
        .otherwise("unknown")
    )
