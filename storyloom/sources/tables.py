"""Readers, and the article view over the provided documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import story_id

# Fixed values of the article view.
EVENT_TYPES = ("signing", "match_result", "injury", "news", "rumor", "schedule")
SPORTS = ("football", "basketball", "tennis", "unknown")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: tuple[str, ...], index) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, article_id, url, source, lang, title, subtitle, published_at, event_type and sport of each document."""
    url = F.concat(F.lit("https://news.example/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"))
    return read(spark, sf_dir, "documents").select(
        "doc_id",
        story_id(url).alias("article_id"),
        url.alias("url"),
        "source",
        "lang",
        "text",
        F.substring("text", 1, 80).alias("title"),
        F.substring("text", 81, 240).alias("subtitle"),
        F.timestamp_micros(F.lit(1704067200000000) + F.col("doc_id") * 1800000000).alias("published_at"),
        pick(EVENT_TYPES, F.col("doc_id")).alias("event_type"),
        pick(SPORTS, F.col("doc_id")).alias("sport"),
    )


def landed_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Landed feed files: lines of JSON; what does not parse is kept in _corrupt_record, not dropped."""
    return spark.read.schema(schema + ", _corrupt_record string").option("mode", "PERMISSIVE").json(path)


def flat_items(payload: DataFrame) -> DataFrame:
    """One row per item of nested feed payloads: Articles.Items and every category's Items; items without a link or
    title, and videos, are left out, and a link counts once."""
    items = F.concat(F.coalesce("Data.Articles.Items", F.array()), F.coalesce(F.flatten(F.transform("Data.Categories", lambda c: F.coalesce(c["Items"], F.array()))), F.array()))
    each = payload.select(F.explode(items).alias("i")).select("i.*")
    kept = each.filter((F.coalesce("url", F.lit("")) != "") & (F.trim(F.coalesce("title", F.lit(""))) != "") & ~F.coalesce("is_video", F.lit(False)))
    return kept.dropDuplicates(["url"])


def append_snapshot(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Append in one write, partitioned by ``by``."""
    writer = df.write.mode("append")
    (writer.partitionBy(*by) if by else writer).parquet(path)
