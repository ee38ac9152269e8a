"""The same operators over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def new_articles(stream: DataFrame, key: str = "article_id", at: str = "published_at", memory: str = "30 days") -> DataFrame:
    """Each key once within ``memory``: state older than that by event time is dropped."""
    return stream.withWatermark(at, memory).dropDuplicatesWithinWatermark([key])


def counts_by_window(stream: DataFrame, at: str, by: list[str], width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts per event-time window and key; rows later than ``late`` do not change a closed window."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width), *by).agg(F.count(F.lit(1)).alias("n"))


def append_new(stream: DataFrame, history: str, checkpoint: str, key: str = "article_id") -> StreamingQuery:
    """Write every batch's unseen keys, once each, to the ``history`` table; a batch that runs again overwrites its own
    part, so retries add nothing twice."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        try:
            seen = spark.read.parquet(history).filter(F.col("batch_id") != batch_id).select(key)
        except Exception as missing:
            if "PATH_NOT_FOUND" not in str(missing) and "UNABLE_TO_INFER_SCHEMA" not in str(missing):
                raise
            seen = batch.select(key).limit(0)
        new = batch.dropDuplicates([key]).join(seen, key, "left_anti")
        new.write.mode("overwrite").parquet(f"{history}/batch_id={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
