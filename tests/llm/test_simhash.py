import random

import numpy as np
from xxhash import xxh64_intdigest

from storyloom.llm import simhash as S
from storyloom.llm.fingerprints import fingerprint


def plain(text, size=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", low) if x]
    if not w:
        return 0
    sh = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] or [" ".join(w)]
    h = [xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(prints, radius=4):
    ids = list(prints)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if bin(prints[a] ^ prints[b]).count("1") <= radius:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_fingerprints():
    for t in (None, "", " \n", "One", "a B c d", "É b c d e f", "x " * 50000, "a\x00b c\x0bd e"):
        assert fingerprint(t, 4) == plain(t)


def test_spark_hashes_alike(spark):
    got = spark.sql("SELECT xxhash64('a b c d')").first()[0]
    assert got % (1 << 64) == xxh64_intdigest("a b c d", 42)


def test_groups_against_brute_force(spark, monkeypatch):
    rnd = random.Random(5)
    base = [" ".join(rnd.choice("abcdefghij") * rnd.randint(1, 4) for _ in range(rnd.choice((3, 30, 200)))) for _ in range(12)]
    rows = [(0, None), (1, ""), (2, "one"), (3, "one")]
    for i in range(4, 160):
        w = rnd.choice(base).split(" ")
        for _ in range(rnd.choice((0, 0, 1, 2))):
            w[rnd.randrange(len(w))] = "changed" + str(rnd.randrange(9))
        rows.append((i, " ".join(w)))
    got = {r.doc_id: r.component_id for r in S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute({i: plain(t) for i, t in rows})


def test_chains_of_any_distance(spark, monkeypatch):
    rnd = random.Random(7)
    prints, at = {}, rnd.getrandbits(64)
    for i in range(300):
        if i % 25 == 0:
            at = rnd.getrandbits(64)
        for b in rnd.sample(range(64), rnd.choice((1, 2, 3, 4, 4, 5, 6))):
            at ^= 1 << b
        prints[i] = at
    frame = spark.createDataFrame([(i, S.signed(p)) for i, p in prints.items()], "doc_id long, fp long")
    monkeypatch.setattr(S, "fingerprints", lambda docs, size: docs)
    assert {r.doc_id: r.component_id for r in S.near_duplicates(frame).collect()} == brute(prints)


def test_thresholds_cover_the_radius():
    rng = np.random.default_rng(0)
    bits = rng.integers(0, 2, (500, 64))
    both = bits.T @ bits
    for n in (500, 10**6, 10**9):
        for radius in (1, 3, 4, 6):
            plan = S.allocate(radius, n, both * (n // 500))[1]
            assert sorted(b for g, _ in plan for b in g) == list(range(64))
            assert sum(t for _, t in plan) >= radius - len(plan) + 1


def test_empty_and_repeated(spark):
    assert S.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(None, "a b c"), (None, "a b c"), (5, "a b c"), (5, "a b c"), (7, "z y x w v")]
    got = sorted((r.component_id, r.doc_id or 0) for r in S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(5, 0), (5, 0), (5, 5), (5, 5), (7, 7)]
