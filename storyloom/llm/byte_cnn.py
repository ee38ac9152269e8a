"""A quality classifier: a byte-level convolutional network in numpy.

A text is its UTF-8 bytes, each with a flag that says whether the eight bytes from there repeat what stood a few bytes
earlier.  Learned filters slide over overlapping chunks of the whole text, each filter keeps its largest response, and a
logistic unit combines those into one probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_of_id, table
from .labelled import Sample, learnable, sample

WIDTH, STRIDE, FILTERS = 8, 4, 24
#: Bytes, bytes that repeat, and the symbol after the end.
SYMBOLS, PAD = 513, 512
LAGS = range(2, 33)
#: Chunks that are looked at together; a text of any length takes as much memory as this many chunks.
AT_ONCE = 4096
SAMPLE_PER_CLASS, SAMPLE_BYTES = 1500, 32_768


def symbols(text: str | None) -> np.ndarray:
    """The symbols of a text, padded so that every byte lies in a chunk; an empty text is one chunk of padding."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    n = len(raw)
    chunks = 1 + max(0, -(-(n - WIDTH) // STRIDE))
    out = np.full(WIDTH + STRIDE * (chunks - 1), PAD, np.int16)
    out[:n] = raw
    step = 1 << 16
    for a in range(0, max(0, n - 7), step):
        lead = min(a, LAGS[-1])
        part = raw[a - lead : min(n, a + step + 7)]
        eight = np.lib.stride_tricks.sliding_window_view(part, 8).copy().view("<u8").ravel()
        again = np.zeros(len(eight), bool)
        for lag in LAGS:
            if lag >= len(eight):
                break
            again[lag:] |= eight[lag:] == eight[:-lag]
        found = again[lead:]
        out[a : a + len(found)][found] += 256
    return out


class Network:
    """table[k, s]: what symbol s at place k of a chunk adds to each filter."""

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.table = rng.normal(0, 0.1, (WIDTH, SYMBOLS, FILTERS)).astype(np.float32)
        self.table[:, PAD] = 0
        self.bias = np.zeros(FILTERS, np.float32)
        self.weight = np.where(np.arange(FILTERS) % 4, -0.3, 0.3).astype(np.float32)
        self.offset = np.float32(0)

    def pool(self, sym: np.ndarray, where: bool = False):
        """Each filter's largest response over all chunks, and the chunk that has it."""
        count = (len(sym) - WIDTH) // STRIDE + 1
        top, at = np.full(FILTERS, -np.inf, np.float32), np.zeros(FILTERS, np.int64)
        for a in range(0, count, AT_ONCE):
            n = min(AT_ONCE, count - a)
            part = sym[a * STRIDE : (a + n - 1) * STRIDE + WIDTH]
            total = self.table[0].take(part[0 : (n - 1) * STRIDE + 1 : STRIDE], axis=0)
            for k in range(1, WIDTH):
                total += self.table[k].take(part[k : k + (n - 1) * STRIDE + 1 : STRIDE], axis=0)
            if where:
                here = total.argmax(axis=0)
                value = total[here, np.arange(FILTERS)]
                better = value > top
                at[better] = here[better] + a
                top[better] = value[better]
            else:
                np.maximum(top, total.max(axis=0), out=top)
        return (top + self.bias, at) if where else top + self.bias

    def score(self, text: str | None) -> float:
        z = float(np.maximum(self.pool(symbols(text)), 0) @ self.weight + self.offset)
        return float(1 / (1 + np.exp(-min(50.0, max(-50.0, z)))))

    def fit(self, data: Sample, epochs: int = 12, batch: int = 16, rate: float = 0.05, decay: float = 1e-4, seed: int = 2) -> "Network":
        """Adagrad on the logistic loss; a filter learns from the chunk that it responds to most.

        The sample is balanced, so the offset is moved to the labels' own shares at the end.  Without texts of both
        labels the score is their share, 0.5 if there are none."""
        n0, n1 = data.counts
        prior = np.log((n1 + 1) / (n0 + 1))
        labels = np.array(data.labels)
        if len(set(data.labels)) < 2:
            self.weight[:] = 0
            self.offset = np.float32(prior)
            return self
        texts = [symbols(t) for t in data.texts]
        rng = np.random.default_rng(seed)
        g_table, g_bias, g_weight, g_offset = np.full_like(self.table, 1e-4), np.full(FILTERS, 1e-4), np.full(FILTERS, 1e-4), 1e-4
        # Rare labels weigh as much as common ones.
        heavy = np.where(labels == 1, 0.5 / max(1e-9, labels.mean()), 0.5 / max(1e-9, 1 - labels.mean()))
        for _ in range(max(epochs, min(60, 12_000 // max(1, len(texts))))):
            order = rng.permutation(len(texts))
            for a in range(0, len(order), batch):
                d_table = np.zeros_like(self.table)
                d_bias, d_weight, d_offset = np.zeros(FILTERS), np.zeros(FILTERS), 0.0
                for i in order[a : a + batch]:
                    response, at = self.pool(texts[i], where=True)
                    hidden = np.maximum(response, 0)
                    z = float(hidden @ self.weight + self.offset)
                    slip = heavy[i] * (1 / (1 + np.exp(-z)) - labels[i])
                    d_weight += slip * hidden
                    d_offset += slip
                    back = slip * self.weight * (response > 0)
                    d_bias += back
                    for k in range(WIDTH):
                        np.add.at(d_table[k], (texts[i][at * STRIDE + k], np.arange(FILTERS)), back)
                d_table[:, PAD] = 0
                d_weight += decay * self.weight * batch
                touched = d_table != 0
                g_table[touched] += d_table[touched] ** 2
                self.table[touched] -= rate * d_table[touched] / np.sqrt(g_table[touched])
                g_bias += d_bias**2
                self.bias -= (rate * d_bias / np.sqrt(g_bias)).astype(np.float32)
                g_weight += d_weight**2
                self.weight -= (rate * d_weight / np.sqrt(g_weight)).astype(np.float32)
                g_offset += d_offset**2
                self.offset -= np.float32(rate * d_offset / np.sqrt(g_offset))
        self.offset += np.float32(prior)
        return self


def scores(docs: DataFrame, network: Network) -> DataFrame:
    """doc_id and score of every row of (doc_id, text); null and empty texts have the score of padding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [network.score(t) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def keep(docs: DataFrame, network: Network, least: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores ``least`` or more."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([network.score(t) >= least for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, most_bytes: int = SAMPLE_BYTES) -> Network:
    """Fit on a bounded sample of the labelled rows that are not held out (crc32 of the id mod 5 is 0)."""
    return Network().fit(sample(docs, labels, "quality", learnable(5, 0), per_class, most_bytes))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every whole text of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    found = scores(docs, train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", (crc_of_id(F.col("doc_id")) % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
