"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the word contracts have it, as a character class body.
SPACE = r"\x20\x09-\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def scratch(spark: SparkSession) -> str:
    """A folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset and the
    master is local.  On a cluster a folder of one machine would lose rows, so there the setting must be given."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("storyloom.scratch", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = "file://" + tempfile.mkdtemp(prefix="storyloom-")
        spark.conf.set("storyloom.scratch", top)
    return f"{top}/storyloom-{uuid.uuid4().hex}"


def written(df: DataFrame, *by: str) -> DataFrame:
    """The same rows, read back from a table in the shared folder: cuts lineage and survives lost executors."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fits_broadcast(df: DataFrame, most_rows: int = 200_000, most_bytes: int = 64 << 20) -> bool:
    """Whether a written table is small enough to be sent to every executor, by the optimizer's size, which rests on the
    files' sizes, and by its rows, counted no further than the limit."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size <= most_bytes and df.limit(most_rows + 1).count() <= most_rows


def join_checked(left: DataFrame, small: DataFrame, on, how: str = "left", most_rows: int = 200_000) -> DataFrame:
    """Broadcast ``small`` (a written table) if its size allows, else leave a shuffled join that AQE may split."""
    return left.join(F.broadcast(small) if fits_broadcast(small, most_rows) else small, on, how)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Array of the maximal runs of anything but ASCII white space; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of an id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
