"""From documents to packed training sequences in five stages, each of which works on all that the one before kept.

Rows are told apart by a key of their contents where ids may be null or repeated.  An empty table passes through every
stage; rows with null texts have no words and go in the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm import byte_cnn, decontamination, packing, quality_rules, similar
from storyloom.llm.common import join_checked, table, written

KEY = "storyloom_key"


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with a key of their columns, nulls told apart from texts; equal rows have one key."""
    parts = [F.coalesce(F.concat(F.lit("+"), F.col(c).cast("string")), F.lit("-")) for c in ("doc_id", "lang", "source", "text")]
    return docs.withColumn(KEY, F.md5(F.concat_ws("\x00", *parts).cast("binary")))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of keyed ``docs`` whose key is not in ``gone``."""
    return join_checked(docs, written(gone.distinct()), KEY, "left_anti").drop(KEY)


def keep_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the quality rules reject."""
    keyed = _keyed(docs)
    judged = quality_rules.apply_rules(keyed.select(F.col(KEY).alias("doc_id"), "text", "lang", "source"))
    return _without(keyed, judged.filter("NOT kept").select(F.col("doc_id").alias(KEY)))


def keep_by_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the classifier, trained on the labelled documents among these, scores below 0.3."""
    return byte_cnn.keep(docs, byte_cnn.train(docs, table(spark, sf_dir, "labels")))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of every group of texts whose five-word shingles are similar to 0.8 or more.

    Null ids stand behind all others, told apart by their text; of rows that share an id one stays."""
    own = F.coalesce("doc_id", F.shiftrightunsigned(F.xxhash64("text"), 2) + F.lit(1 << 62))
    named = docs.withColumn(KEY, own)
    found = written(similar.similar_groups(named.select(F.col(KEY).alias("doc_id"), "text")))
    firsts = written(found.filter("doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("doc_id", KEY))
    gone = written(found.filter("doc_id <> component_id").select(F.col("doc_id").alias(KEY)).distinct().join(firsts, KEY, "left_anti"))
    repeated = written(firsts.filter("n > 1").select(KEY))
    kept = join_checked(named, gone, KEY, "left_anti")
    single = join_checked(kept, repeated, KEY, "left_anti")
    return single.unionByName(join_checked(kept, repeated, KEY, "left_semi").dropDuplicates([KEY])).drop(KEY)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that leak a benchmark item."""
    keyed = _keyed(docs)
    found = decontamination.leaks(keyed.select(F.col(KEY).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return _without(keyed, found.select(F.col("doc_id").alias(KEY)))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left."""
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [
    ("quality_rules", keep_by_rules),
    ("quality_classifier", keep_by_classifier),
    ("near_dedup", keep_one_of_each_group),
    ("decontamination", drop_leaks),
    ("packing", pack_sequences),
]
#: Training, SimHash and packing are not what SQL expresses; the operators' tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
