"""Lines that many documents share, found with levelled sorted runs of line hashes.

A run is a bucketed table of (h, n), sorted by h: in how many documents of some batches a line's hash was found, at most
``least``.  A new batch counts its own hashes, merge-anti-joins the runs for those that have reached ``least`` already and
adds the rest as a run of level 0.  ``fanout`` runs of one level are merged into one of the next, bucket by bucket and
without a shuffle.  A hash is of the line in lower case of any script, so it never tells equal keys apart and may bring
unequal ones together; the lines whose hash reaches ``least`` are then counted by their exact keys.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, join_checked, scratch, table, written

LEAST_DOCUMENTS = 10
#: Batches that the query makes of its input files, and runs of a level that are merged into one of the next.
BATCHES, FANOUT = 4, 2
STRIPPED = " \t\n\x0b\x0c\r"


def lines(text: Column) -> Column:
    """The \\n-separated lines of a text; null or empty gives one empty line."""
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n")


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(STRIPPED)))


def _hash(line: Column) -> Column:
    """A hash that equal keys share; null for a line that is empty once stripped."""
    bare = F.btrim(line, F.lit(STRIPPED))
    return F.when(bare != "", F.xxhash64(F.lower(bare)))


class LineRuns:
    """The runs of one corpus.  Tables live in the shared folder; the catalog of the session knows them by name until
    ``drop`` is called."""

    def __init__(self, spark: SparkSession, least: int = LEAST_DOCUMENTS, fanout: int = FANOUT):
        self.spark, self.least, self.fanout = spark, least, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.made: list[str] = []

    def _run(self, counts: DataFrame) -> str:
        name = f"storyloom_lines_{uuid.uuid4().hex}"
        writer = counts.write.format("parquet").option("path", scratch(self.spark))
        writer.bucketBy(self.buckets, "h").sortBy("h").saveAsTable(name)
        self.made.append(name)
        return name

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def _merged(self, names: list[str]) -> DataFrame:
        """(h, n) over some runs by full outer merge joins of their buckets."""

        def both(one: DataFrame, two: DataFrame) -> DataFrame:
            joined = one.join(two.withColumnRenamed("n", "m").hint("merge"), "h", "full_outer")
            total = F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))
            return joined.select("h", F.least(total, F.lit(self.least)).cast("int").alias("n"))

        return reduce(both, [self.spark.table(n) for n in names])

    def counts(self, texts: DataFrame) -> DataFrame:
        """(h, n): in how many rows of (text) each hash is found, at most ``least``; a hash counts once a row."""
        each = F.array_distinct(F.transform(lines(F.col("text")), _hash))
        found = texts.select(F.explode(each).alias("h")).filter("h IS NOT NULL").groupBy("h").agg(F.count(F.lit(1)).alias("n"))
        return found.select("h", F.least("n", F.lit(self.least)).cast("int").alias("n"))

    def add(self, texts: DataFrame) -> None:
        """Add a batch of (text): its hashes but those that the runs know to be common, then compact full levels."""
        own = self.counts(texts)
        for name in self.runs():
            own = own.join(self.spark.table(name).filter(F.col("n") >= self.least).select("h").hint("merge"), "h", "left_anti")
        full, level = [self._run(own)], 0
        while full:
            if len(self.levels) == level:
                self.levels.append([])
            self.levels[level] += full
            full = []
            if len(self.levels[level]) == self.fanout:
                full = [self._run(self._merged(self.levels[level]))]
                self.levels[level] = []
            level += 1

    def common(self) -> DataFrame:
        """(h) of the hashes found in ``least`` documents or more of all batches."""
        names = self.runs()
        if not names:
            return self.spark.createDataFrame([], "h long")
        return self._merged(names).filter(F.col("n") >= self.least).select("h")

    def drop(self) -> None:
        for name in self.made:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def shared_lines(docs: DataFrame, common: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(t1, t2, places): for each text of (text) that holds lines whose exact key is found in ``least`` rows or more, a
    hash of the text and the places of these lines; ``common`` has the hashes (h) that they can have."""
    # Rows are numbered before they are taken apart: beside a generator the number would be a line's.
    named = docs.select("text", *_text_hash(F.col("text")), F.monotonically_increasing_id().alias("row"))
    each = named.select("t1", "t2", "row", F.posexplode(lines(F.col("text"))).alias("place", "line"))
    hashed = each.withColumn("h", _hash(F.col("line"))).filter("h IS NOT NULL")
    met = join_checked(hashed, common, "h", "left_semi", most_rows=2_000_000)
    # The ids of rows hold from here on, as they are written.
    met = written(met.select("t1", "t2", "row", "place", line_key(F.col("line")).alias("key")))
    keys = met.groupBy("key", "row").agg(F.lit(1).alias("one")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    keys = written(keys.filter(F.col("n") >= least).select("key"))
    return join_checked(met, keys, "key", "left_semi").groupBy("t1", "t2").agg(F.collect_set("place").alias("places"))


def _text_hash(text: Column) -> list[Column]:
    whole = F.coalesce(text.cast("string"), F.lit(""))
    return [F.xxhash64(whole).alias("t1"), F.xxhash64(F.lit(1), whole).alias("t2")]


def drop_shared_lines(docs: DataFrame, batches: list[DataFrame] | None = None, least: int = LEAST_DOCUMENTS, fanout: int = FANOUT) -> DataFrame:
    """The rows and columns of ``docs`` with n_lines, n_dropped (long) and kept_text (string).

    Every line whose key is found in ``least`` rows or more goes from every row; the others are joined by \\n.  ``batches``
    are the same rows in any number of parts, one after the other added to the runs; without them there is one part.
    Each row counts as one document, even if another has the same id or text.  A null or empty text has one empty line
    and keeps it; empty lines have no key and stay.  Columns called n_lines, n_dropped or kept_text are replaced.  A line
    found in many places of a text is dropped in all of them; an empty table gives an empty one."""
    store = LineRuns(docs.sparkSession, least, fanout)
    for part in batches if batches is not None else [docs]:
        store.add(part.select("text"))
    common = written(store.common())
    store.drop()
    places = written(shared_lines(docs.select("text"), common, least))
    marks = [F.col(c).alias(f"storyloom_{c}") for c in ("t1", "t2", "places")]
    own = docs.drop("n_lines", "n_dropped", "kept_text")
    named = own.select("*", *[c.alias(f"storyloom_{n}") for c, n in zip(_text_hash(F.col("text")), ("t1", "t2"))])
    found = join_checked(named, places.select(*marks), ["storyloom_t1", "storyloom_t2"])
    split, gone = lines(F.col("text")), F.col("storyloom_places")
    left = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), gone)
    kept = F.array_join(F.transform(left, lambda i: F.get(split, i)), "\n")
    return found.select(
        *own.columns,
        F.size(split).cast("long").alias("n_lines"),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(gone.isNull(), F.coalesce(F.col("text").cast("string"), F.lit(""))).otherwise(kept).alias("kept_text"),
    )


def file_batches(docs: DataFrame, count: int = BATCHES) -> list[DataFrame]:
    """The rows of a table read from files in ``count`` parts by file, so that each part reads its own files only."""
    part = F.pmod(F.xxhash64(F.col("_metadata.file_path")), F.lit(count))
    return [docs.filter(part == k) for k in range(count)]


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drop the lines that ten documents or more share from every whole text of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    found = drop_shared_lines(docs, file_batches(docs))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


_KEY = r"translate(trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP11_SQL = f"""
WITH d AS MATERIALIZED (
    SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), l AS MATERIALIZED (
    SELECT r, place, l, {_KEY} AS key FROM (SELECT r, generate_subscripts(ls, 1) AS place, unnest(ls) AS l FROM d)
), common AS (
    SELECT key FROM l WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= {LEAST_DOCUMENTS}
), kept AS (
    SELECT r, string_agg(l, chr(10) ORDER BY place) AS kept, count(*) AS n
    FROM l WHERE key NOT IN (SELECT key FROM common) GROUP BY r
)
SELECT doc_id, len(ls) AS n_lines, len(ls) - coalesce(n, 0) AS n_dropped, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
