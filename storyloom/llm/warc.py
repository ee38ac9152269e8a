"""WARC archives with revisit records for repeated payloads.

Headers (id, size, digest) are grouped by payload digest; the smallest page id of a digest keeps the payload as a
``response`` record and the others become ``revisit`` records that name it.  Archives are plain WARC/1.1 files in the
shared folder, one record per row of Spark's text writer, and are parsed again by their Content-Length.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_checked, scratch, written

CRLF = "\r\n"
#: (payload bytes below, records in a file): a file holds 64 MiB of payload at most, or one record.
TIERS = ((1 << 14, 4096), (1 << 18, 256), (1 << 22, 16), (None, 1))


def with_heads(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest and row (a number of its own for every row, the same whenever
    the table is read again in the same parts) of every page; null html is the empty payload."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    return pages.select(
        F.col("page_id").cast("long"),
        F.coalesce(F.col("url"), F.lit("")).alias("url"),
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload.cast("binary"), 256).alias("payload_digest"),
        F.monotonically_increasing_id().alias("row"),
    )


def originals(heads: DataFrame, least_bytes: int = 100) -> DataFrame:
    """One row per digest that occurs more than once: payload_digest, the smallest page_id (original), and the URL and row
    of that response (the first of repeated ones)."""
    return (
        heads.filter(F.col("payload_bytes") >= least_bytes)
        .groupBy("payload_digest")
        .agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "row", "url"))).alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select("payload_digest", F.col("first.page_id").alias("original"), F.col("first.row").alias("original_row"), F.col("first.url").alias("original_url"))
    )


def _uri(url: str) -> F.Column:
    """A line end inside a URL would end its header line."""
    return F.regexp_replace(url, r"[\r\n]", " ")


def _record_id(page: str, url: str, row: str) -> F.Column:
    key = F.md5(F.concat_ws("|", F.col("payload_digest"), F.col(page).cast("string"), _uri(url), F.col(row).cast("string")).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(key, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _record(date: str) -> F.Column:
    """A whole WARC record but for the two line ends after it, which the writer puts between rows."""
    size = F.col("payload_bytes").cast("string")
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), size, F.lit(CRLF * 2)
    )
    block = F.when(F.col("revisit"), F.lit("")).otherwise(F.concat(http, F.col("payload")))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    # The page headers are extensions, by which the archives are read back.
    revisit = F.concat(
        F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" + CRLF + "WARC-Refers-To: "),
        _record_id("original", "original_url", "original_row"),
        F.lit(CRLF + "WARC-Refers-To-Target-URI: "),
        _uri("original_url"),
        F.lit(f"{CRLF}WARC-Refers-To-Date: {date}{CRLF}WARC-Refers-To-Page: "),
        F.col("original").cast("string"),
        F.lit(CRLF),
    )
    return F.concat(
        F.lit("WARC/1.1" + CRLF + "WARC-Type: "),
        F.when(F.col("revisit"), "revisit").otherwise("response"),
        F.lit(CRLF + "WARC-Record-ID: "),
        _record_id("page_id", "url", "row"),
        F.lit(f"{CRLF}WARC-Date: {date}{CRLF}WARC-Page-ID: "),
        page,
        F.lit(CRLF + "WARC-Target-URI: "),
        _uri("url"),
        F.lit(CRLF + "WARC-Payload-Digest: sha256:"),
        F.col("payload_digest"),
        F.lit(CRLF),
        F.when(F.col("revisit"), revisit).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response" + CRLF + "Content-Length: "),
        F.octet_length(block).cast("string"),
        F.lit(CRLF * 2),
        block,
    )


def write_archives(pages: DataFrame, least_bytes: int = 100, at: datetime | None = None) -> str:
    """Write deduplicated archives of ``pages`` (page_id, url, html), dated ``at`` (now, if not given), and return their
    folder.  Every record has an id of its own, repeated rows too; revisits name their response's id, URL and date.

    Rows with the smallest id of a digest are responses, repeated rows of it included; a null id never beats another
    id.  An empty table gives an empty folder.
    """
    spark, path = pages.sparkSession, scratch(pages.sparkSession)
    date = (at or datetime.now(timezone.utc)).astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    heads = with_heads(pages)
    firsts = written(originals(heads.drop("payload"), least_bytes))
    decided = join_checked(heads, firsts, "payload_digest")
    decided = decided.withColumn(
        "revisit", F.coalesce((F.col("payload_bytes") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("original")) & F.col("original").isNotNull(), F.lit(False))
    )
    low = 0
    largest = heads.agg(F.max("payload_bytes")).first()[0] or 0
    for below, records in TIERS:
        if low <= largest:
            size = F.col("payload_bytes")
            part = decided.filter((size >= low) & (size < below if below else F.lit(True)))
            part.select(_record(date).alias("value")).write.option("lineSep", CRLF * 2).option("maxRecordsPerFile", records).text(f"{path}/from-{low}")
        low = below or low
    return path


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    for batch in batches:
        for content in batch.column("content"):
            data, at = memoryview(content.as_buffer()), 0
            raw, rows = bytes(data), []
            while at < len(raw):
                end = raw.index(b"\r\n\r\n", at)
                head = dict(line.split(": ", 1) for line in raw[at:end].decode().split(CRLF)[1:])
                start = end + 4
                at = start + int(head["Content-Length"])
                page = int(head["WARC-Page-ID"]) if head["WARC-Page-ID"] else None
                if head["WARC-Type"] == "revisit":
                    rows.append((page, None, head["WARC-Payload-Digest"][7:], "revisit", int(head["WARC-Refers-To-Page"])))
                else:
                    body = data[raw.index(b"\r\n\r\n", start) + 4 : at]
                    rows.append((page, len(body), hashlib.sha256(body).hexdigest(), "response", None))
                at += 4
            page, size, digest, kind, refers = zip(*rows) if rows else ((),) * 5
            yield pa.record_batch(
                [pa.array(page, pa.int64()), pa.array(size, pa.int64()), pa.array(digest, pa.string()), pa.array(kind, pa.string()), pa.array(refers, pa.int64())],
                ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
            )


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest (computed again from the payload), record_type and refers_to of every
    record under ``path``; a revisit takes size and digest from the response that it refers to."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    records = written(files.select("content").mapInArrow(_parse, schema))
    full = records.filter("record_type = 'response'")
    back = records.filter("record_type = 'revisit'").alias("v")
    once = written(
        full.join(back.select(F.col("payload_digest")).distinct(), "payload_digest", "left_semi")
        .groupBy("page_id", "payload_digest")
        .agg(F.max("payload_bytes").alias("payload_bytes"))
    )
    found = join_checked(
        back.select("page_id", "payload_digest", "record_type", "refers_to"),
        once.withColumnRenamed("page_id", "refers_to"),
        ["refers_to", "payload_digest"],
    )
    return full.unionByName(found.select(full.columns))


def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every page of ``pages`` to archives and read them back."""
    return read_archives(spark, write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet")))


OP7_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages
), f AS (
  SELECT d, min(page_id) AS o FROM p WHERE n >= 100 GROUP BY d
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
  CASE WHEN f.o IS NOT NULL AND f.o IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.o IS NOT NULL AND f.o IS DISTINCT FROM page_id THEN f.o END AS refers_to
FROM p LEFT JOIN f ON n >= 100 AND p.d = f.d
"""
