"""Toxicity by two class-conditional Kneser-Ney models.

A bigram model of toxic and one of ordinary texts back off to word counts of their class, those to stems, and each level
to what both classes have together, so every pair and word that was seen counts and one that is rare in both says little.
Discounts are estimated from counts of counts.  The log-likelihood ratio per word, over the whole text and over its most
telling windows, goes through a logistic curve fitted on texts that were not counted.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_of_id, table
from .labelled import Sample, learnable, sample

WORD = re.compile(r"\w+")
#: Words of windows: an expression, a phrase and a passage; a whole text shorter than LEAST words counts as that long.
WINDOWS, LEAST = (1, 4, 48), 16
#: Letters of a stem: a rare word leans on the counts of the words that begin like it, an unknown one goes by them.
STEM = 4
SAMPLE_PER_CLASS, SAMPLE_BYTES = 4000, 16_384
#: Fits on so many of every ten texts; the others set the curve.
COUNTED_OF_TEN = 7


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def discounts(counts: np.ndarray) -> np.ndarray:
    """What counts of 0, 1, 2 and 3 or more lose, by the numbers of counts 1 to 4 (Chen and Goodman): between 0 and the
    count, so every seen one keeps a share where the numbers allow it."""
    n = [float((counts == k).sum()) for k in range(5)]
    y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
    own = [k - (k + 1) * y * n[k + 1] / n[k] if n[k] else k * y for k in (1, 2, 3)]
    return np.array([0.0, *(min(max(d, 0.05 * k), 0.95 * k) for k, d in zip((1, 2, 3), own))])


class Model:
    """What a worker needs: log ratios of all known pairs and words, and of stems for other words."""

    def __init__(self):
        self.ids: dict[str, int] = {"": 0}
        self.stem: dict[str, float] = {}
        self.word = np.zeros(1)
        #: Sorted keys (first word's id * words + second's) and their log ratios.
        self.pairs, self.pair = np.zeros(0, np.int64), np.zeros(0)
        self.curve = (0.0,) * (2 + len(WINDOWS))

    def count(self, texts: list[list[str]], labels: list[int]) -> None:
        flat = [[], []]
        for ws, k in zip(texts, labels):
            flat[k].append(np.array([0, *(self.ids.setdefault(w, len(self.ids)) for w in ws)], np.int64))
        size = len(self.ids)
        two = []
        for k in (0, 1):
            keys = [a[:-1] * size + a[1:] for a in flat[k]]
            two.append(np.unique(np.concatenate(keys) if keys else np.zeros(0, np.int64), return_counts=True))
        # A word counts by the different words before it, so repeats within a text or copies of it count once.
        one = [np.bincount(keys % size, minlength=size) for keys, _ in two]
        if not one[0].any() or not one[1].any():
            self.ids = {"": 0}
            return
        names: dict[str, int] = {}
        stem = np.array([names.setdefault(w[:STEM], len(names)) for w in self.ids])
        stems = [np.bincount(stem, of).astype(np.int64) for of in one]
        # Every level mixes a class's discounted counts with what both classes have together, tilted as the level above
        # tilts it; what neither class has goes by the level above alone.
        tilt = self._tilts(stems, [np.ones(len(names))] * 2)
        self.stem = dict(zip(names, np.log(tilt[1] / tilt[0]).tolist()))
        tilt = self._tilts(one, [of[stem] for of in tilt])
        self.word = np.log(tilt[1] / tilt[0])
        self.pairs = np.union1d(two[0][0], two[1][0])
        c = [np.zeros(len(self.pairs), np.int64) for _ in two]
        for of, (keys, n) in zip(c, two):
            of[np.searchsorted(self.pairs, keys)] = n
        tilt = self._tilts(c, [of[self.pairs % size] for of in tilt], self.pairs // size)
        self.pair = np.log(tilt[1] / tilt[0])

    @staticmethod
    def _tilts(counts: list[np.ndarray], above: list[np.ndarray], group: np.ndarray | None = None) -> list[np.ndarray]:
        """Each class's probability over that of both classes together, where one has counts; ``above`` elsewhere.
        Probabilities are those within a ``group`` (a pair's first word)."""
        group = np.zeros(len(counts[0]), np.int64) if group is None else group
        d = discounts(np.concatenate(counts))
        both = counts[0] + counts[1]
        total = np.bincount(group, both)[group]
        out = []
        for c, up in zip(counts, above):
            lost = d[np.minimum(c, 3)]
            n, left = np.bincount(group, c)[group], np.bincount(group, lost)[group]
            own = (c - lost + left * both * up / np.maximum(total, 1)) / np.maximum(n, 1) * total / np.maximum(both, 1)
            out.append(np.where((both > 0) & (n > 0), own, up))
        return out

    def ratios(self, ws: list[str]) -> np.ndarray:
        """The log ratio of each word.  A word that repeats the one before it has zero."""
        ids = np.array([self.ids.get(w, -1) for w in ws], np.int64)
        out = self.word[np.maximum(ids, 0)]
        new = np.flatnonzero(ids < 0)
        out[new] = [self.stem.get(ws[i][:STEM], 0.0) for i in new]
        if len(self.pairs):
            before = np.concatenate([[0], ids[:-1]])
            key = np.where((before >= 0) & (ids >= 0), before * len(self.ids) + ids, -1)
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            out = np.where(self.pairs[at] == key, self.pair[at], out)
        same = [False, *(a == b for a, b in zip(ws, ws[1:]))]
        return np.where(same, 0.0, out)

    def features(self, ws: list[str]) -> tuple[float, ...]:
        """Log ratio per word over the whole text and over its highest window of each width; zeros for a text without
        words."""
        if not ws:
            return (0.0,) * (1 + len(WINDOWS))
        sums = np.concatenate([[0.0], np.cumsum(self.ratios(ws))])
        out = [float(sums[-1]) / max(len(ws), LEAST)]
        for width in WINDOWS:
            width = min(width, len(ws))
            out.append(float((sums[width:] - sums[:-width]).max()) / max(width, 1))
        return tuple(out)

    def fit_curve(self, rows: list[tuple[float, ...]], labels: list[int], prior: float) -> None:
        """Logistic regression by Newton steps with a slight pull to zero; ``prior`` are the log odds in all labels."""
        x = np.array([[*r, 1.0] for r in rows]) if rows else np.zeros((0, 2 + len(WINDOWS)))
        y = np.array(labels, float)
        if len(set(labels)) < 2:
            self.curve = (*(0.0,) * (1 + len(WINDOWS)), prior)
            return
        theta, pull = np.zeros(x.shape[1]), np.diag([*(0.05,) * (x.shape[1] - 1), 1e-6])
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
            step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + pull, x.T @ (p - y) + pull @ theta)
            theta = theta - step * min(1.0, 4.0 / max(1e-9, np.abs(step).max()))
        theta[-1] += prior - log((y.sum() + 1) / (len(y) - y.sum() + 1))
        self.curve = tuple(theta.tolist())

    def fit(self, data: Sample) -> "Model":
        pool: dict[str, str] = {}  # one string object per distinct word, however often it occurs
        texts = [[pool.setdefault(w, w) for w in words(t)] for t in data.texts]
        n0, n1 = data.counts
        prior = log((n1 + 1) / (n0 + 1)) if n0 + n1 else 0.0
        turn = Counter()
        counted = []
        for k in data.labels:  # in turn within each label
            counted.append(turn[k] % 10 < COUNTED_OF_TEN)
            turn[k] += 1
        self.count([t for t, c in zip(texts, counted) if c], [k for k, c in zip(data.labels, counted) if c])
        rest = [i for i, c in enumerate(counted) if not c]
        self.fit_curve([self.features(texts[i]) for i in rest], [data.labels[i] for i in rest], prior)
        return self

    def score(self, text: str | None) -> float:
        z = float(np.dot(self.curve, (*self.features(words(text)), 1.0)))
        return 1 / (1 + exp(-min(50.0, max(-50.0, z))))


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, most_bytes: int = SAMPLE_BYTES) -> Model:
    """Fit on a bounded sample of the labelled rows that are not held out (crc32 of the id mod 3 is 1).

    Without rows of both labels the score is the labels' share, 0.5 if there are none."""
    return Model().fit(sample(docs, labels, "toxic", learnable(3, 1), per_class, most_bytes))


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row of (doc_id, text); the model, bounded by the sample, is sent to each worker once."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([own.score(t) for t in batch.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every whole text of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    found = scores(docs, train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", (crc_of_id(F.col("doc_id")) % 3 == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
