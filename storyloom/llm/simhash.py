"""Near-duplicate groups by SimHash, searched with the general pigeonhole principle.

Equal fingerprints are merged first.  Links of distance 1 and 2 are found from the fingerprints one flipped bit away and
contracted to components.  For the rest, the 64 bits are grouped into partitions of correlated bits and every partition
gets a threshold of its own: if they add up to radius - partitions + 1, any linked pair agrees within the threshold in
some partition.  Dynamic programming picks the thresholds that cost least by estimated candidates and probes; both sides
probe the partition's value with up to half the threshold of its bits flipped, and pairs that meet are verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_checked, table, written
from .fingerprints import fingerprints

BITS = 64
#: What a candidate pair costs, in probes.
CANDIDATE = 4.0


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def bit_statistics(prints: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints and how often each pair of bits is 1 in both; one small matrix per task is summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS), np.int64), 0
        for batch in batches:
            raw = batch.column("fp").to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(raw, axis=1, bitorder="little").astype(np.float64)
            total += (bits.T @ bits).astype(np.int64)
            n += len(bits)
        yield pa.record_batch([pa.array(np.append(total.ravel(), n))], ["v"]).append_column("at", pa.array(np.arange(BITS * BITS + 1)))

    rows = prints.select("fp").mapInArrow(run, "v long, at long").groupBy("at").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(BITS * BITS + 1, np.int64)
    for r in rows:
        flat[r.at] = r.v
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def partitions(count: int, both: np.ndarray, n: int) -> list[list[int]]:
    """``count`` groups of bits of nearly equal size; each grows by the bit that correlates most with it."""
    p = np.diag(both) / max(1, n)
    cov = both / max(1, n) - np.outer(p, p)
    spread = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    corr = np.abs(cov / np.outer(spread, spread))
    left, out = set(range(BITS)), []
    for k in range(count):
        size = len(left) // (count - k)
        group = [min(left, key=lambda b: (-sum(corr[b, c] for c in left if c != b), b))]
        left.discard(group[0])
        while len(group) < size:
            best = max(left, key=lambda b: (sum(corr[b, c] for c in group), -b))
            group.append(best)
            left.discard(best)
        out.append(sorted(group))
    return out


def probes(width: int, threshold: int) -> int:
    """How many values each side emits so that two values within ``threshold`` of each other meet."""
    return 0 if threshold < 0 else sum(comb(width, k) for k in range((threshold + 1) // 2 + 1))


def allocate(radius: int, n: int, both: np.ndarray) -> tuple[float, list[tuple[list[int], int]]]:
    """(cost, [(bits, threshold)]): the cheapest partitions and thresholds for a search within ``radius``.

    Candidates are estimated from the bits' frequencies: the chance that two values differ in at most so many bits."""
    p = np.diag(both) / max(1, n)
    differ = 2 * p * (1 - p)
    best: tuple[float, list[tuple[list[int], int]]] = (float("inf"), [])
    for count in range(1, radius + 2):
        groups, need = partitions(count, both, n), radius - count + 1
        plans: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for g in groups:
            chance = np.zeros(BITS + 1)
            chance[0] = 1.0
            for b in g:
                chance[1:] = chance[1:] * (1 - differ[b]) + chance[:-1] * differ[b]
                chance[0] *= 1 - differ[b]
            nxt: dict[int, tuple[float, list[int]]] = {}
            for done, (cost, chosen) in plans.items():
                for t in range(-1, radius + 1):
                    met = float(chance[: 2 * ((t + 1) // 2) + 1].sum()) if t >= 0 else 0.0
                    c = cost + n * probes(len(g), t) + CANDIDATE * n * n / 2 * met * max(1, probes(len(g), t)) ** 0.5
                    if done + t not in nxt or c < nxt[done + t][0]:
                        nxt[done + t] = (c, [*chosen, t])
            plans = nxt
        fit = min(v for k, v in plans.items() if k >= need)
        best = min(best, (fit[0], list(zip(groups, fit[1]))), key=lambda x: x[0])
    return best


def connected(edges: DataFrame) -> DataFrame:
    """node and label (the smallest node of its component) of every node of the edges (a, b).

    Large-star and small-star steps in turn, each written out, until the edges are stars; rounds grow with the logarithm
    of a component's size, and no component is gathered anywhere."""

    def tally(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    def least(e: DataFrame) -> DataFrame:
        return written(e.groupBy("u").agg(F.min("v").alias("m")))

    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    seen = None
    while (now := tally(e)) != seen:
        seen = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = least(both).select("u", F.least("u", "m").alias("m"))
        large = written(join_checked(both, low, "u", "inner").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        low = least(large)
        small = join_checked(large, low, "u", "inner").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = written(small.unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _close_links(uniq: DataFrame) -> DataFrame:
    """Edges that join all fingerprints within two bits of each other: those that share a value one bit away.

    The members of such a value are kept as a mask of flipped bits, so a group takes two longs however full it is."""
    masks = F.array(*[F.lit(signed(1 << i)) for i in range(BITS)])
    flips = uniq.select("fp", F.explode(F.concat(masks, F.array(F.lit(0).cast("long")))).alias("mask"))
    values = (
        flips.select(F.col("fp").bitwiseXOR(F.col("mask")).alias("key"), "mask")
        .groupBy("key")
        .agg(F.bit_or("mask").alias("mask"), F.max((F.col("mask") == 0).cast("int")).alias("self"))
        .filter(F.bit_count("mask") + F.col("self") > 1)
    )
    some = F.transform(F.filter(masks, lambda m: m.bitwiseAND(F.col("mask")) != 0), lambda m: m.bitwiseXOR(F.col("key")))
    members = values.select(F.concat(some, F.when(F.col("self") == 1, F.array("key")).otherwise(F.array().cast("array<long>"))).alias("all"))
    return members.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).filter("a <> b").distinct()


def _far_links(nodes: DataFrame, radius: int) -> DataFrame:
    """Edges (a, b) between different components of ``nodes`` (fp, comp) that hold fingerprints within ``radius``."""
    n, both = bit_statistics(nodes)
    chosen = allocate(radius, n, both)[1]
    sides = []
    for k, (bits, threshold) in enumerate(chosen):
        if threshold < 0:
            continue
        own = signed(reduce(int.__or__, (1 << b for b in bits)))
        flips = [signed(sum(1 << b for b in c)) for r in range((threshold + 1) // 2 + 1) for c in combinations(bits, r)]
        mask = F.explode(F.array(*[F.lit(m) for m in flips]))
        sides.append(nodes.select("fp", "comp", mask.alias("mask")).select(F.lit(k).cast("tinyint").alias("part"), F.col("fp").bitwiseAND(F.lit(own)).bitwiseXOR(F.col("mask")).alias("key"), "fp", "comp"))
    probe = reduce(DataFrame.unionByName, sides)
    by = ["part", "key"]
    mixed = written(probe.groupBy(*by).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select(*by))
    met = written(join_checked(probe, mixed, by, "inner"))
    # The largest component of a meeting is not paired with itself; every other member meets the rest.
    main = written(met.groupBy(*by, "comp").agg(F.count(F.lit(1)).alias("n")).groupBy(*by).agg(F.max(F.struct("n", "comp")).alias("m")).select(*by, F.col("m.comp").alias("main")))
    met = join_checked(met, main, by, "inner")
    other = met.filter("comp <> main").select(*by, F.col("fp").alias("fp2"), F.col("comp").alias("b"))
    pairs = met.withColumnRenamed("comp", "a").join(other, by).filter(F.col("a") != F.col("b")).filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= radius)
    return pairs.select("a", "b").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fp (signed long) and component_id (the smallest doc_id reachable by links) of every row of (doc_id, text).

    Texts without words share fingerprint zero and link like any other; a null id has a component of its fingerprint's
    other rows and is never its name unless all ids of the component are null.  Repeated rows give repeated results."""
    prints = written(fingerprints(docs, shingle))
    uniq = written(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    near = written(connected(_close_links(uniq)))
    nodes = written(join_checked(uniq, near.withColumnRenamed("node", "fp"), "fp").select("fp", "rep", F.coalesce("label", "fp").alias("comp")))
    far = written(connected(_far_links(nodes, radius)))
    nodes = join_checked(nodes, far.withColumnRenamed("node", "comp"), "comp").select("fp", "rep", F.coalesce("label", "comp").alias("comp"))
    nodes = written(nodes)
    names = written(nodes.groupBy("comp").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    named = written(join_checked(nodes, names, "comp").select("fp", F.coalesce("component_id", "rep").alias("component_id")))
    return join_checked(prints, named, "fp").select("doc_id", "fp", "component_id")


def op3_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group every whole text of ``documents``."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
