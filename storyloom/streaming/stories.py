"""Stories kept up to date as articles come in, in batches of any cut and in any order.

Articles, edges and memberships are tables with a part per batch.  A batch adds its articles and the edges they have with
what is known; only the components that these edges touch are grouped again, whole, so an article that comes late joins
the story it belongs to and the outcome is that of grouping all articles at once.  Clusters keep their ids.  A batch reads
the parts of earlier batches only and overwrites its own, so one that was cut off can simply run again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.coherence import coherent, reconciled
from ..operators.graph import components, saved

ARTICLE = "article_id string, published_at timestamp, source string, event_type string, sport string"
EDGE = "a_id string, b_id string, intra boolean"
MEMBER = "article_id string, component string, cluster_id string"
#: Edges (a_id, b_id, intra) of new articles with known ones; ``known`` holds the new ones, too.
Match = Callable[[DataFrame, DataFrame], DataFrame]


class StoryFeed:
    """The stories of one feed, in the tables of a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str, match: Match):
        self.spark, self.folder, self.match = spark, folder, match

    def _read(self, name: str, schema: str, before: int | None = None) -> DataFrame:
        try:
            df = self.spark.read.schema(f"{schema}, batch int").parquet(f"{self.folder}/{name}")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            df = self.spark.createDataFrame([], f"{schema}, batch int")
        return df if before is None else df.filter(F.col("batch") < before)

    def _write(self, df: DataFrame, name: str, batch: int, schema: str) -> DataFrame:
        path = f"{self.folder}/{name}/batch={batch}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def members(self, before: int | None = None) -> DataFrame:
        """article_id, component and cluster_id as of the last batch that touched the article; null where it has none."""
        log = self._read("members", MEMBER, before)
        return log.groupBy("article_id").agg(F.max_by(F.struct("component", "cluster_id"), "batch").alias("m")).select("article_id", "m.*")

    def stories(self) -> DataFrame:
        """article_id, cluster_id and story (the earliest member) of all articles that are in a cluster."""
        own = self.members().filter("cluster_id IS NOT NULL").join(self._read("articles", ARTICLE).select("article_id", "published_at"), "article_id")
        first = own.groupBy("cluster_id").agg(F.min_by("article_id", F.struct("published_at", "article_id")).alias("story"))
        return own.join(first, "cluster_id").select("article_id", "cluster_id", "story")

    def add(self, batch: DataFrame, number: int) -> None:
        """Take in a batch of articles; ids that are known already, or come twice, count once."""
        names = [c.split()[0] for c in ARTICLE.split(", ")]
        earlier = self._read("articles", ARTICLE, number).select(names)
        new = batch.select(names).dropDuplicates(["article_id"]).join(earlier.select("article_id"), "article_id", "left_anti").select(names)
        new = self._write(new, "articles", number, ARTICLE)
        known = earlier.unionByName(new)
        fresh = self._write(self.match(new, known).select("a_id", "b_id", "intra"), "edges", number, EDGE)
        ends = fresh.select(F.col("a_id").alias("article_id")).union(fresh.select("b_id")).distinct()
        was = saved(self.members(number))
        # All articles of the components that the new edges reach; an article without edges has no component yet.
        touched = was.join(ends, "article_id", "left_semi").select("component").distinct()
        scope = saved(was.join(touched, "component", "left_semi").select("article_id").union(ends).distinct())
        edges = self._read("edges", EDGE, number).select("a_id", "b_id", "intra").unionByName(fresh)
        edges = saved(edges.join(scope.withColumnRenamed("article_id", "a_id"), "a_id", "left_semi"))
        labels = saved(components(edges))
        grouped = coherent(known.join(labels, "article_id"), edges).select("story", "article_id")
        held = was.filter("cluster_id IS NOT NULL").join(scope, "article_id", "left_semi").select("cluster_id", "article_id")
        now = reconciled(saved(grouped), held, scope).select("article_id", "cluster_id")
        self._write(labels.join(now, "article_id", "left").select("article_id", "component", "cluster_id"), "members", number, MEMBER)

    def follow(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Take in a stream of articles, one micro-batch after the other."""
        return stream.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
