"""Stories as connected components of accepted pairs, and their representatives."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new name in the folder that spark.checkpoint.dir names; where that is unset, and only with a local master, in a
    temporary one."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = "file://" + tempfile.gettempdir()
    return f"{top}/storyloom-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """The rows, read back from a table in the shared folder."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def joined(left: DataFrame, small: DataFrame, on, how: str = "inner", most_rows: int = 200_000, most_bytes: int = 64 << 20) -> DataFrame:
    """The join with ``small`` (a written table), sent to every executor if its files and rows allow, else shuffled."""
    size = int(str(small._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    fits = size <= most_bytes and small.limit(most_rows + 1).count() <= most_rows
    return left.join(F.broadcast(small) if fits else small, on, how)


def components(edges: DataFrame) -> DataFrame:
    """article_id and component (its smallest id) of every node of the edges (a_id, b_id).

    Every node hangs its larger neighbours, and then its smaller ones, on the smallest node it knows, in turns, until a
    turn changes nothing: the edges are then stars.  Turns grow with the logarithm of a component's size; each is written,
    and compared with the one before by two sums."""

    def hung(e: DataFrame, larger: bool) -> DataFrame:
        """Edges (lo, hi) after each node's larger (or smaller) neighbours hang on the smallest it knows."""
        around = e.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(e.select(F.col("hi").alias("u"), F.col("lo").alias("v"))) if larger else e.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
        around = saved(around)
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = around.join(least, "u").filter(F.col("v") > F.col("u") if larger else F.col("v") != F.col("m")).select(F.col("m").alias("lo"), F.col("v").alias("hi"))
        if not larger:
            moved = moved.unionByName(least.select(F.col("m").alias("lo"), F.col("u").alias("hi")))
        return saved(moved.filter("lo < hi").distinct())

    def tally(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()

    nodes = edges.select("a_id").union(edges.select("b_id")).distinct().select(F.col("a_id").alias("article_id"))
    e = saved(edges.select(F.least("a_id", "b_id").alias("lo"), F.greatest("a_id", "b_id").alias("hi")).filter("lo < hi").distinct())
    before = None
    while (now := tally(e)) != before:
        before = now
        e = hung(hung(e, larger=True), larger=False)
    return nodes.join(e.select(F.col("hi").alias("article_id"), F.col("lo").alias("component")), "article_id", "left").select("article_id", F.coalesce("component", "article_id").alias("component"))


def representative(members: DataFrame) -> DataFrame:
    """One row per component: the member with most facts, surest, latest, then of the smallest id; and the anchor, the
    earliest member.  ``members``: component, article_id, published_at, sport, event_type, certainty."""
    facts = (F.col("sport") != "unknown").cast("int") + (F.col("event_type") != "news").cast("int")
    sure = F.when(F.col("certainty") == "confirmed", 2).when(F.col("certainty") == "probable", 1).otherwise(0)
    by = Window.partitionBy("component").orderBy(facts.desc(), sure.desc(), F.col("published_at").desc(), F.col("article_id"))
    best = members.withColumn("place", F.row_number().over(by)).filter("place = 1").select("component", F.col("article_id").alias("representative"))
    rest = members.groupBy("component").agg(F.min_by("article_id", F.struct("published_at", "article_id")).alias("anchor"), F.count(F.lit(1)).alias("n_members"))
    return best.join(rest, "component")


def kept_ids(proposed: DataFrame, existing: DataFrame) -> DataFrame:
    """Which existing cluster each proposed one continues: the one that shares most members, ties to the smallest id;
    a proposal that shares none gets a new id from its anchor.  Both: cluster_id or component, article_id."""
    shared = proposed.join(existing, "article_id").groupBy("component", "cluster_id").agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("component").orderBy(F.col("n").desc(), "cluster_id")
    best = shared.withColumn("place", F.row_number().over(by)).filter("place = 1").select("component", "cluster_id", F.col("n").alias("n_shared"))
    new = F.concat(F.lit("cluster_"), F.substring(F.sha1("component"), 1, 16))
    return proposed.select("component").distinct().join(best, "component", "left").select("component", F.coalesce("cluster_id", new).alias("cluster_id"), F.coalesce("n_shared", F.lit(0)).cast("long").alias("n_shared"))

