"""Ranked lexical search, score at a time over impact-ordered postings.

Queries are taken in blocks of bounded size.  One pass over the documents keeps what each holds of the block's terms; counts
over all documents give every posting a whole-number impact.  Documents are then ranked where they lie, a few thousand at
once: postings are grouped by term and exact impact, groups are worked off by descending weight times impact, and a query
stops once what is left cannot lift any but a few documents to its k-th best score; those few are then scored in full.
What each share of the documents finds is merged by Spark.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

TOP = 10
#: Texts of queries that are sent to executors at once, in bytes; one longer text is a block of its own.
BLOCK_BYTES = 8 << 20
#: Documents that are ranked at once; bounds the memory of a task.
SHARE = 1 << 14
#: Constants of the score: m is 100 - B + B * n * N / L, and an impact SCALE * tf / (1000 * tf + K1 * m).
B, K1, SCALE = 90, 8, 1_000_000_000
_ALNUM = b"0123456789abcdefghijklmnopqrstuvwxyz"
_FOLD = bytes(c if c > 127 or c in _ALNUM else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """The maximal runs of ASCII letters and digits and of anything beyond ASCII, A-Z lower-cased."""
    return (text or b"").translate(_FOLD).split()


def weight(n_docs: int, df: int) -> int:
    return floor(1000 * log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """The whole-number impact of postings with frequency ``tf`` in documents of ``n`` terms."""
    return (SCALE * tf) // (1000 * tf + K1 * (100 - B + (B * n * n_docs) // total))


def _holds(known: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, own, counts = [], [], []
            for text in batch.column(1).to_pylist():
                every = terms(text)
                tally = Counter(map(known.get, every))
                tally.pop(None, None)
                sizes.append(len(every))
                own.append(list(tally.keys()))
                counts.append(list(tally.values()))
            ids, tfs = pa.array(own, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), ids, tfs], ["doc_id", "n", "terms", "tfs"])

    return run


class Share:
    """Postings of some documents, by term and descending exact impact, and the same by document."""

    def __init__(self, n: np.ndarray, offsets: np.ndarray, term: np.ndarray, impact: np.ndarray):
        self.size, self.offsets, self.term, self.impact = len(n), offsets, term, impact
        doc = np.repeat(np.arange(len(n)), np.diff(offsets))
        order = np.lexsort((doc, -impact, term))
        self.docs, t, s = doc[order], term[order], impact[order]
        starts = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (s[1:] != s[:-1])]) if len(t) else np.zeros(0, np.int64)
        self.starts, self.ends = starts, np.r_[starts[1:], len(t)].astype(np.int64)
        self.group_term, self.group_impact = t[starts], s[starts]

    def scores(self, docs: np.ndarray, weights: dict[int, int]) -> np.ndarray:
        """The full scores of a few documents."""
        found = np.zeros(len(docs), np.int64)
        for i, d in enumerate(docs):
            a, b = self.offsets[d], self.offsets[d + 1]
            found[i] = sum(weights.get(t, 0) * s for t, s in zip(self.term[a:b].tolist(), self.impact[a:b].tolist()))
        return found

    def best(self, weights: dict[int, int], k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, full scores, postings read): all documents that can be among the ``k`` best, ties included."""
        sides = [(np.searchsorted(self.group_term, t), np.searchsorted(self.group_term, t, "right"), w) for t, w in weights.items() if w > 0]
        groups = np.concatenate([np.arange(a, b) for a, b, _ in sides] or [np.zeros(0, np.int64)])
        value = np.concatenate([self.group_impact[a:b] * w for a, b, w in sides] or [np.zeros(0, np.int64)])
        which = np.concatenate([np.full(b - a, i) for i, (a, b, _) in enumerate(sides)] or [np.zeros(0, np.int64)])
        order = np.argsort(-value, kind="stable")
        groups, value, which = groups[order], value[order], which[order]
        length = self.ends[groups] - self.starts[groups]
        read, done, step = np.cumsum(length), 0, 4 * k
        total = np.zeros(self.size, np.int64)
        while done < len(groups):
            # Steps grow with what has been read, so the bounds are looked at a few times only.
            to = max(done + 1, int(np.searchsorted(read, (read[done - 1] if done else 0) + step, "right")))
            part, take = groups[done:to], length[done:to]
            at = np.repeat(self.starts[part] - np.r_[0, np.cumsum(take)[:-1]], take) + np.arange(int(take.sum()))
            np.add.at(total, self.docs[at], np.repeat(value[done:to], take))
            done, step = to, 2 * step
            if done < len(groups):
                # Each term can add its next impact at most once to a document.
                left = int(value[done:][np.unique(which[done:], return_index=True)[1]].sum())
                kth = int(np.partition(total, self.size - k)[self.size - k]) if self.size > k else 0
                some = np.flatnonzero(total + left >= kth)
                if kth > 0 and len(some) <= 4 * k:
                    return some, self.scores(some, weights), int(read[done - 1])
        some = np.flatnonzero(total > 0)
        if len(some) > k:
            kth = np.partition(total[some], len(some) - k)[len(some) - k]
            some = some[total[some] >= kth]
        return some, total[some], int(read[-1]) if len(read) else 0


def _shares(batches: Iterator[pa.RecordBatch], share: int) -> Iterator[list[pa.RecordBatch]]:
    """The rows of a task in lists of batches of ``share`` rows together, the last of fewer."""
    held, rows = [], 0
    for batch in batches:
        while batch.num_rows:
            held.append(batch.slice(0, share - rows))
            rows += held[-1].num_rows
            batch = batch.slice(held[-1].num_rows)
            if rows == share:
                yield held
                held, rows = [], 0
    if held:
        yield held


def _ranker(items: list[tuple[int, dict[int, int]]], n_docs: int, total: int, k: int, share: int):
    names = ["item", "doc_id", "score"]

    def ranked(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(batches).combine_chunks()
        n = whole.column("n").to_numpy().astype(np.int64)
        lists, tfs = whole.column("terms").combine_chunks(), whole.column("tfs").combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        offsets = np.r_[0, np.cumsum(sizes)].astype(np.int64)
        term, tf = lists.flatten().to_numpy().astype(np.int64), tfs.flatten().to_numpy().astype(np.int64)
        own = Share(n, offsets, term, impacts(tf, np.repeat(n, sizes), n_docs, total))
        ids = whole.column("doc_id").to_pylist()
        rows: list[tuple] = []
        for item, weights in items:
            docs, scores, _ = own.best(weights, k)
            found = sorted((-int(s), ids[d] is None, ids[d] or 0) for d, s in zip(docs.tolist(), scores.tolist()) if s > 0)[:k]
            rows += [(item, None if null else d, -s) for s, null, d in found]
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ([], [], []), (pa.int32(), pa.int64(), pa.int64()))], names)

    return lambda batches: map(ranked, _shares(batches, share))


def _block(docs: DataFrame, rows: list, k: int, share: int) -> DataFrame:
    """(item, doc_id, score) of what may be among the ``k`` best of the items, numbered as in ``rows``."""
    wanted = [sorted(set(terms(bytes(r.text) if r.text is not None else None))) for r in rows]
    known = {t: i for i, t in enumerate(sorted({t for w in wanted for t in w}))}
    held = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(_holds(known), "doc_id long, n long, terms array<int>, tfs array<int>"))
    n_docs, total = held.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    # As many rows as the block has terms.
    df = {r.t: r.df for r in held.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect()}
    items = [(i, {known[t]: weight(n_docs, df[known[t]]) for t in w if known[t] in df}) for i, w in enumerate(wanted)]
    return held.filter("n > 0").mapInArrow(_ranker(items, n_docs, max(1, total), k, share), "item int, doc_id long, score long")


def search(docs: DataFrame, queries: DataFrame, k: int = TOP, block_bytes: int = BLOCK_BYTES, share: int = SHARE) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the ``k`` documents of (doc_id, text) with the highest scores above 0
    for each row of queries (item_id, text).

    Equal scores are ordered by doc_id, null ids last.  Every row is a document of its own, even if it repeats another.
    Queries that share an item_id, null among them, are one with the terms of all; one without terms finds nothing, and
    so does an empty table.  Other columns of either table play no part."""
    by_item = queries.groupBy("item_id").agg(F.concat_ws(" ", F.sort_array(F.collect_set(F.col("text").cast("string")))).cast("binary").alias("text"))
    by_item = written(by_item)
    size, count = by_item.agg(F.coalesce(F.sum(F.length("text") + 64), F.lit(0)), F.count(F.lit(1))).first()
    blocks = max(1, -(-size // block_bytes))
    parts = None
    for b in range(blocks):
        own = by_item.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).orderBy("item_id")
        rows = own.collect()  # about block_bytes
        if not rows and count:
            continue
        found = _block(docs, rows, k, share)
        names = own.sparkSession.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], f"item int, item_id {by_item.schema['item_id'].dataType.simpleString()}")
        found = found.join(F.broadcast(names), "item").drop("item")
        parts = found if parts is None else parts.unionByName(found)
    place = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return parts.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank all ``documents`` for every item of ``benchmark``."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP13_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_TERMS.format("coalesce(text, '')")} AS ts FROM documents),
p AS MATERIALIZED (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM d) GROUP BY r, t),
s AS MATERIALIZED (SELECT count(*) FILTER (len(ts) > 0) AS n, CAST(sum(len(ts)) AS BIGINT) AS l FROM d),
q AS (SELECT DISTINCT item_id, unnest({_TERMS.format("coalesce(text, '')")}) AS t FROM benchmark),
w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * n + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM (SELECT t, count(*) AS df FROM p GROUP BY t), s),
f AS (
    SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(ts) * n) // l)))) AS BIGINT) AS score
    FROM q JOIN w USING (t) JOIN p USING (t) JOIN d USING (r), s GROUP BY item_id, r, doc_id
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM f WHERE score > 0
) WHERE rank <= {TOP}
"""
