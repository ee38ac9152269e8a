import hashlib
import math
import random

import numpy as np

from storyloom.llm.delta_lloyd import delta_lloyd, reassign, squared, transfers, whole_vectors


def brute(vectors, k, rounds, salt="2:"):
    """Full Lloyd rounds in plain Python: (sorted (id, cluster, distance), centroids)."""
    named = sorted((hashlib.sha256(f"{salt}{'' if i is None else i}".encode()).hexdigest(), v) for i, v in vectors)
    centroids = [list(v) for _, v in named[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in vectors:
            groups.setdefault(nearest(v)[1], []).append(v)
        for j, own in groups.items():
            centroids[j] = [sum(col) // len(own) for col in zip(*own)]
    return sorted(((i is None, i or 0), *reversed(nearest(v))) for i, v in vectors), centroids


def check(spark, vectors, k, rounds):
    df = spark.createDataFrame(vectors, "vec_id long, v array<int>")
    found = delta_lloyd(df, k, rounds)
    want, centroids = brute(vectors, k, rounds)
    assert sorted(((r.vec_id is None, r.vec_id or 0), r.cluster, r.distance) for r in found.assigned.collect()) == want
    assert found.centroids.tolist() == centroids


def test_equals_full_rounds(spark):
    rng = random.Random(3)
    # Few coarse values, so that ties, empty clusters and centroids that stand still occur.
    vectors = [(i, [rng.choice((-3, 0, 1, 2)) + 10 * (i % 4) for _ in range(3)]) for i in range(200)]
    vectors += [(500 + i, [7, 7, 7]) for i in range(60)] + [(0, vectors[0][1]), (0, [9, 9, 9]), (None, [1, 1, 1])]
    for k, rounds in ((12, 5), (1, 2), (3, 0)):
        check(spark, vectors, k, rounds)


def test_fewer_vectors_than_clusters_and_none(spark):
    check(spark, [(1, [5, 5]), (2, [5, 5]), (3, [-1, -2])], 40, 5)
    empty = spark.createDataFrame([], "vec_id long, v array<int>")
    assert delta_lloyd(empty).assigned.collect() == []


def test_only_sound_vectors_are_kept_and_floored(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.1, -0.1]), (2, [nan, 0.0]), (3, [inf, 0.0]), (4, [0.0]), (5, None), (6, [None, 0.0]), (7, [1e30, 0.0]), (8, [0.0, -0.0]), (9, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, v string")
    found = {r.vec_id: r.v for r in whole_vectors(df, dims=2).collect()}
    assert found == {1: [math.floor(25.6), math.floor(-25.6)], 8: [0, 0]}


def test_a_round_compares_what_moved_and_is_exact(spark):
    rng = np.random.default_rng(1)
    v, c = rng.integers(-9, 9, (300, 4)), rng.integers(-9, 9, (6, 4))
    d = squared(v, c)
    owner, distance = d.argmin(1), d.min(1)
    after = c.copy()
    after[[1, 4]] += 2
    moved = (after != c).any(1)
    got = reassign(v, owner, distance, after, moved)
    want = ((v[:, None] - after[None]) ** 2).sum(2)
    assert (got[0] == want.argmin(1)).all() and (got[1] == want.min(1)).all()
    big = np.array([[1 << 26, -(1 << 26)]])
    assert squared(big, -big).tolist() == [[2 * (1 << 27) ** 2]]


def test_transfers_are_signed_sums_of_what_moved(spark):
    state = spark.createDataFrame([([1, 2], 0, -1), ([5, 5], 1, 0), ([7, 7], 1, 1), ([0, 3], 0, 1)], "v array<int>, cluster int, before int")
    found = {(r.cluster, r.at): int(r.delta) for r in transfers(state, 2, 2).groupBy("cluster", "at").sum("delta").withColumnRenamed("sum(delta)", "delta").collect()}
    assert {k: d for k, d in found.items() if d} == {(0, 0): -4, (1, 0): 5, (1, 1): 2, (0, 2): 1}
