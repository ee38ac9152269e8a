"""Bounded samples of labelled texts for fitting classifiers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, written


@dataclass
class Sample:
    """Texts and their labels (0 or 1), and how many labelled rows of each label there are in all."""

    texts: list[str]
    labels: list[int]
    counts: tuple[int, int]


def sample(docs: DataFrame, labels: DataFrame, target: str, learn: Column, per_class: int, most_bytes: int) -> Sample:
    """At most ``per_class`` texts of each label, those with the smallest hash of their id, for rows where ``learn``
    holds; a text of over ``most_bytes`` is not drawn (scoring takes texts of any length).  So at most
    2 * per_class * most_bytes bytes reach the driver.  Null ids, texts and labels are left out, and ids with both
    labels; of several rows with one id the text of the smallest hash is drawn."""
    texts = docs.select("doc_id", "text").filter(learn & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (F.octet_length("text") <= most_bytes))
    truth = labels.select(F.col("doc_id"), F.col(target).cast("int").alias("label")).filter("doc_id IS NOT NULL AND label IN (0, 1)").filter(learn)
    truth = written(truth.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).filter("label = other").drop("other"))
    counts = {r.label: r.n for r in truth.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.xxhash64("doc_id")
    known = texts.select("doc_id").distinct()
    ids = [known.join(truth.filter(F.col("label") == k), "doc_id").orderBy(order, "doc_id").limit(per_class) for k in (0, 1)]
    chosen = written(ids[0].unionByName(ids[1]))
    drawn = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text"), "text")).getField("text").alias("text"))
    rows = drawn.orderBy("doc_id").collect()
    return Sample([r.text for r in rows], [r.label for r in rows], (counts.get(0, 0), counts.get(1, 0)))


def learnable(modulus: int, held: int) -> Column:
    """Rows to learn from: crc32 of the id as text has another remainder than ``held``."""
    return crc_of_id(F.col("doc_id")) % modulus != held
