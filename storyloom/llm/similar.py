"""Near-duplicate groups of texts whose word shingles have a Jaccard similarity of 0.8 or more, by wide SimHash prints.

Two sets of similarity J have shingle vectors at a cosine of 2J / (1 + J), so their prints differ in about
acos(cosine) / pi of their bits; at 0.8 that is 0.15, far beyond what short prints tell apart.  Prints of 512 bits
estimate a similarity near 0.8 to about 0.02.  Equal prints are merged first.  Each 64-bit word of a print is split into
small groups of correlated bits, and a partition is two such groups of different words: there are as many partitions as
pairs of groups, so wide ones, which few texts share by chance, can be had in any number.  Dynamic programming gives
partitions thresholds (none, exact, or some bits) such that the candidates and probes it expects cost least while a pair
at the limit is met with the recall asked for.  Texts meet by a partition's value, with up to half its threshold of bits
flipped.  Where two meet that is their pair; where more meet, each is first held against the least, and then those
still apart against one another, in blocks of prints rather than by rows of pairs.  Pairs are verified on sizes and whole prints.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import acos, ceil, log, log2, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_checked, written
from .simhash import bit_statistics, connected, partitions, probes, signed

WORDS, BITS = 8, 512
SHINGLE, SIMILARITY, RECALL = 5, 0.8, 0.9
#: Shingles whose bits are summed at once, so that memory does not grow with a text; fewer than a byte counts to.
AT_ONCE, BYTE = 1 << 14, 255
#: What a candidate pair costs, in probes.
CANDIDATE = 5.0
#: Groups of bits that a word is split into, and how many groups further on a group's partners stand.
GROUPS, PARTNERS = (4, 5, 6, 7, 8, 9), range(1, 8)
#: So many random prints, and so many a print, are added to the statistics, and chances of meeting are told apart by powers of
#: two only.  A large group of near copies would else make the very bits in which its members differ look cheapest; so
#: partitions are taken in their order, the most correlated groups first, unless one is much more common than another.
PRIOR, PRIOR_SHARE = 1000, 4
#: Prints that are compared with as many others at once, where texts at a value are still apart.
BLOCK = 128
#: A value that so many rows of longs say is sent to every executor, within the limit of bytes.
SENT = 2_000_000
#: A miss of one in e**STEP is the step in which recall is counted.
STEP = 0.002


def differing(similarity: float) -> float:
    """The share of bits in which prints of that Jaccard similarity differ."""
    return acos(2 * similarity / (1 + similarity)) / pi


def most_bits(similarity: float, beyond: float = 1.0) -> int:
    """Prints that differ in no more bits count as similar: some standard deviations beyond the mean at the limit."""
    p = differing(similarity)
    return int(BITS * p + beyond * sqrt(BITS * p * (1 - p)))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def wide_print(text: str | None, size: int) -> tuple[int, np.ndarray]:
    """(number of distinct shingles, print as eight longs) of a text, A-Z lower-cased; zeros for a text without words."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0, np.zeros(WORDS, np.int64)
    own = np.array([xxh64_intdigest(w) for w in words], np.uint64)
    n = max(1, len(words) - size + 1)
    span = len(words) - n + 1
    shingle = np.zeros(n, np.uint64)
    for k in range(span):
        shingle = _mixed(shingle + own[k : k + n] + np.uint64(k + 1))
    shingle = np.unique(shingle)
    ones = np.zeros(BITS, np.int64)
    offsets = np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for a in range(0, len(shingle), AT_ONCE):
        part = shingle[a : a + AT_ONCE]
        bits = np.unpackbits(_mixed(part[:, None] + offsets[None, :]).view(np.uint8), axis=1, bitorder="little")
        for b in range(0, len(bits), BYTE):
            ones += np.add.reduce(bits[b : b + BYTE], axis=0, dtype=np.uint8)
    return len(shingle), np.packbits(2 * ones > len(shingle), bitorder="little").view(np.int64)


def _prints(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [wide_print(t, size) for t in batch.column(1).to_pylist()]
            longs = np.array([f for _, f in found], np.int64).reshape(-1, WORDS)
            cols = [batch.column(0), pa.array([n for n, _ in found], pa.int64()), *[pa.array(longs[:, k].copy()) for k in range(WORDS)]]
            yield pa.record_batch(cols, ["doc_id", "n", *F_NAMES])

    return run


F_NAMES = [f"f{k}" for k in range(WORDS)]
PRINT = "doc_id long, n long, " + ", ".join(f"{f} long" for f in F_NAMES)


def allocate(n: int, both: list[np.ndarray], similarity: float, recall: float) -> list[tuple[list[tuple[int, list[int]]], int]]:
    """(groups as (word, bits), threshold) of the partitions to probe, cheapest for ``n`` prints with these bit statistics.

    A pair that differs in half a standard deviation more bits than one at the limit must be met by one of them with the
    given probability; partitions meet it independently, as the number of its differing bits is given."""
    p, need = most_bits(similarity, 0.5) / BITS, ceil(-log(1 - recall) / STEP)
    prior = PRIOR + PRIOR_SHARE * n
    both, counted = [s + prior / 4 * (1 + np.eye(64)) for s in both], n + prior
    best: tuple[float, list] = (float("inf"), [])
    for count in GROUPS:
        split = [partitions(count, stats, counted) for stats in both]
        groups = [(word, split[word][k]) for k in range(count) for word in range(len(both))]
        # least[d]: the least cost of d steps or more; said[i][d]: the threshold that partition i takes there, or -1.
        least, said, pairs = np.full(need + 1, np.inf), [], []
        least[0] = 0.0
        for shift in PARTNERS:
            for i in range(len(groups)):
                pair = [groups[i], groups[(i + shift) % len(groups)]]
                if pair[0][0] == pair[1][0]:
                    continue
                q = np.concatenate([np.diag(both[word])[bits] / counted for word, bits in pair])
                met, near = np.eye(1, 129)[0], np.eye(1, 129)[0]
                for random in 2 * q * (1 - q):
                    met = met * (1 - random) + np.concatenate([[0], met[:-1]]) * random
                    near = near * (1 - p) + np.concatenate([[0], near[:-1]]) * p
                gains = {t: int(-log(1 - float(near[: t + 1].sum())) / STEP) for t in (0, 2)}
                before, takes = least, np.full(need + 1, -1, np.int8)
                for t, gain in gains.items():
                    c = n * probes(len(q), t) + CANDIDATE * n * n / 2 * 2.0 ** round(log2(float(met[: t + 1].sum())))
                    new = before[np.maximum(np.arange(need + 1) - gain, 0)] + c
                    takes[new < least] = t
                    least = np.minimum(least, new)
                said.append((takes, gains))
                pairs.append(pair)
        if least[need] < best[0]:
            chosen, d = [], need
            for pair, (takes, gains) in zip(reversed(pairs), reversed(said)):
                if takes[d] >= 0:
                    chosen.append((pair, int(takes[d])))
                    d = max(0, d - gains[int(takes[d])])
            best = (float(least[need]), chosen)
    return best[1]


def _probes(nodes: DataFrame, chosen: list[tuple[list[tuple[int, list[int]]], int]]) -> DataFrame:
    """node and k (the hash of a partition and a probed value)."""

    def keys(part: int, pair: list[tuple[int, list[int]]], threshold: int) -> Column:
        (one, bits), (two, more) = pair
        value = lambda word, own: F.col(F_NAMES[word]).bitwiseAND(F.lit(signed(sum(1 << b for b in own))))
        a, b = value(one, bits), value(two, more)
        if not threshold:
            return F.array(F.xxhash64(F.lit(part), a, b))
        where = [(one, x) for x in bits] + [(two, x) for x in more]
        flips = [tuple(signed(sum(1 << x for w, x in c if w == word)) for word in (one, two)) for r in range(threshold // 2 + 1) for c in combinations(where, r)]
        masks = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in flips])
        return F.transform(masks, lambda m: F.xxhash64(F.lit(part), a.bitwiseXOR(m["x"]), b.bitwiseXOR(m["y"])))

    return nodes.select("node", F.explode(F.concat(*[keys(part, pair, t) for part, (pair, t) in enumerate(chosen)])).alias("k"))


def _apart(one: str, two: str) -> Column:
    return reduce(Column.__add__, [F.bit_count(F.col(f"{one}.{f}").bitwiseXOR(F.col(f"{two}.{f}"))) for f in F_NAMES])


def _verified(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of nodes whose sizes and prints allow the similarity."""
    one, two = nodes.alias("one"), nodes.alias("two")
    met = pairs.join(one, F.col("a") == F.col("one.node")).join(two, F.col("b") == F.col("two.node"))
    sizes = F.least("one.n", "two.n") >= F.lit(similarity) * F.greatest("one.n", "two.n")
    return met.filter(sizes & (_apart("one", "two") <= most_bits(similarity))).select("a", "b")


def _meeting(members: DataFrame) -> DataFrame:
    """The members (k, node, comp) of values at which more than one component meets, as a table."""
    members = written(members)
    mixed = members.groupBy("k").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("k")
    return written(members.join(mixed, "k"))


def _compared(similarity: float):
    most = most_bits(similarity)

    def side(column: pa.ListArray, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        rows = column[row].values
        longs = [rows.field(f).to_numpy(zero_copy_only=False) for f in ("node", "comp", "n", *F_NAMES)]
        return longs[0], longs[1], longs[2], np.stack(longs[3:], axis=1).astype(np.int64).view(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links: list[tuple[int, int]] = []
            for row in range(batch.num_rows):
                (node, comp, n, bits), (node_b, comp_b, n_b, bits_b) = side(batch.column(0), row), side(batch.column(1), row)
                near = np.bitwise_count(bits[:, None, :] ^ bits_b[None, :, :]).sum(axis=2, dtype=np.int64) <= most
                near &= np.minimum(n[:, None], n_b[None, :]) >= similarity * np.maximum(n[:, None], n_b[None, :])
                i, j = np.nonzero(near & (comp[:, None] != comp_b[None, :]))
                # One link between two components is enough.
                _, first = np.unique(np.stack([comp[i], comp_b[j]], axis=1), axis=0, return_index=True)
                links += zip(node[i[first]].tolist(), node_b[j[first]].tolist())
            yield pa.record_batch([pa.array([x for x, _ in links], pa.int64()), pa.array([x for _, x in links], pa.int64())], ["a", "b"])

    return run


def _linked_in_blocks(left: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between the components that meet at the values of ``left`` (k, node, comp), enough to join all that are
    linked.  At a value all members of components but the largest are compared with all others, in blocks of prints."""
    main = left.groupBy("k", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("k").agg(F.max(F.struct("n", "comp")).alias("m"), F.sum("n").alias("all"))
    main = written(main.select("k", F.col("m.comp").alias("main"), "all", (F.col("all") - F.col("m.n")).alias("apart")))
    each = written(left.join(nodes, "node").join(main, "k"))
    block = lambda size: F.pmod(F.xxhash64("node"), F.ceil(F.col(size) / BLOCK)).alias("block")
    members = F.collect_list(F.struct("node", "comp", "n", *F_NAMES))
    every = each.groupBy("k", block("all")).agg(members.alias("x"))
    others = each.filter("comp <> main").groupBy("k", block("apart")).agg(members.alias("y"))
    return every.drop("block").join(others.drop("block"), "k").select("x", "y").mapInArrow(_compared(similarity), "a long, b long")


def similar_groups(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """doc_id and component_id (the smallest doc_id reachable by links) of every row of (doc_id, text).

    Texts link if their prints say that their sets of word shingles are similar; a pair at the limit is met with the
    given probability, and nearer ones more surely.  Texts without words are alike.  Rows that share an id count as one
    document with the links of all; a row with a null id has none and a null component."""
    prints = written(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_prints(shingle), PRINT))
    nodes = written(prints.filter("doc_id IS NOT NULL").groupBy("n", *F_NAMES).agg(F.min("doc_id").alias("node")))
    statistics = [bit_statistics(nodes.select(F.col(f).alias("fp"))) for f in F_NAMES]
    chosen = allocate(statistics[0][0], [s for _, s in statistics], similarity, recall)
    probes_of = _probes(nodes, chosen)
    by_value = probes_of.groupBy("k").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count(F.lit(1)).alias("size"))
    by_value = written(by_value.filter("low <> high"))
    # First every node with the least one it meets, then what is still apart where three or more meet.
    full = written(by_value.filter("size > 2").select("k", "low"))
    met = written(join_checked(probes_of, full, "k", "inner", SENT))
    star = by_value.filter("size = 2").select(F.col("high").alias("a"), F.col("low").alias("b"))
    star = written(star.unionByName(met.filter("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b"))).distinct())
    comps = written(connected(_verified(star, nodes, similarity)))
    left = join_checked(met.select("k", "node"), comps, "node").select("k", "node", F.coalesce("label", "node").alias("comp"))
    apart = _linked_in_blocks(_meeting(left), nodes, similarity)
    links = written(apart.unionByName(comps.select(F.col("node").alias("a"), F.col("label").alias("b"))))
    # Rows of one id are one document.
    named = written(prints.filter("doc_id IS NOT NULL").join(nodes, ["n", *F_NAMES]).select("doc_id", "node").distinct())
    links = links.unionByName(named.filter("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b")))
    groups = written(connected(links).withColumnRenamed("node", "doc_id").withColumnRenamed("label", "component_id"))
    found = join_checked(prints.select("doc_id"), groups, "doc_id")
    return found.select("doc_id", F.coalesce("component_id", "doc_id").alias("component_id"))
