import random

import numpy as np
from xxhash import xxh64_intdigest

from storyloom.llm import similar as S


def mixed(h):
    h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) % (1 << 64)
    h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) % (1 << 64)
    return h ^ (h >> 31)


def plain(text, size=5):
    words = (text or "").encode().lower().split()
    shingles = set()
    for i in range(max(1, len(words) - size + 1) if words else 0):
        h = 0
        for k, w in enumerate(words[i : i + size]):
            h = mixed((h + xxh64_intdigest(w) + k + 1) % (1 << 64))
        shingles.add(h)
    out = []
    for k in range(1, 9):
        hs = [mixed((h + k * 0x9E3779B97F4A7C15) % (1 << 64)) for h in shingles]
        out.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)))
    return shingles, out


def test_prints_against_plain_version():
    for t in (None, "", " \n", "One", "a B c d", "a b c d e a b c d e a b c d e", "x " * 40000, " ".join(map(str, range(700)))):
        shingles, longs = plain(t)
        n, got = S.wide_print(t, 5)
        assert n == len(shingles) and got.view(np.uint64).tolist() == longs


def test_recall_and_precision_against_all_pairs(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(4))
    texts = []
    for _ in range(40):
        base = [word() for _ in range(rnd.choice((60, 200, 400)))]
        for share in (0, 0, 0.01, 0.015, 0.02, 0.2):
            texts.append(" ".join(word() if rnd.random() < share else w for w in base))
    docs = [(i, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, "  "), (None, texts[0]), (903, texts[5]), (903, texts[11])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS node", "1 AS k")
    for recall, least in ((0.98, 0.97), (S.RECALL, 0.9)):
        check_groups(S.similar_groups(frame, recall=recall).collect(), docs, texts, least)


def check_groups(rows, docs, texts, least):
    assert len(rows) == len(docs)
    got = {r.doc_id: r.component_id for r in rows}
    assert got[None] is None and got[900] == got[901] == got[902] == 900
    assert got[903] == got[5] == got[11]  # rows of one id are one document
    sets = [plain(t)[0] for t in texts]
    near = far = caught = wrong = 0
    for i in range(len(texts)):
        for j in range(i):
            sim = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
            if sim >= 0.8:
                near, caught = near + 1, caught + (got[i] == got[j])
            elif sim < 0.5 and {i // 6, j // 6} != {0, 1}:
                far, wrong = far + 1, wrong + (got[i] == got[j])
    assert near > 150 and caught >= least * near and far > 1000 and wrong == 0


def test_one_large_group_of_copies(spark):
    rnd = random.Random(2)
    base = ["w%d" % rnd.randrange(10**6) for _ in range(300)]
    rows = []
    for i in range(400):
        w = list(base)
        for _ in range(rnd.choice((0, 1, 2))):
            w[rnd.randrange(300)] = "new%d" % i
        rows.append((i, " ".join(w)))
    got = {r.component_id for r in S.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0}


def test_blocks_of_any_size_find_the_same(spark, monkeypatch):
    rnd = random.Random(6)
    base = ["w%d" % rnd.randrange(10**6) for _ in range(300)]
    rows = []
    for i in range(60):
        if i % 20 == 0:
            base = ["w%d" % rnd.randrange(10**6) for _ in range(300)]
        w = list(base)
        for _ in range(rnd.choice((0, 2, 4, 5))):
            w[rnd.randrange(300)] = "new%d" % i
        rows.append((i, " ".join(w)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    by_one = {r.doc_id: r.component_id for r in S.similar_groups(frame).collect()}
    monkeypatch.setattr(S, "BLOCK", 3)
    assert {r.doc_id: r.component_id for r in S.similar_groups(frame).collect()} == by_one
    assert len(set(by_one.values())) >= 3


def test_thresholds_reach_the_recall():
    rng = np.random.default_rng(0)
    bits = rng.integers(0, 2, (500, 64))
    p = S.differing(0.8)
    for n in (1, 500, 10**6, 10**9):
        plan = S.allocate(n, [bits.T @ bits * max(1, n // 500)] * 8, 0.8, 0.98)
        missed = 1.0
        for groups, t in plan:
            assert len({word for word, _ in groups}) == 2
            width = sum(len(bits) for _, bits in groups)
            missed *= 1 - sum(__import__("math").comb(width, k) * p**k * (1 - p) ** (width - k) for k in range(t + 1))
        assert missed <= 0.021


def test_nothing(spark):
    assert S.similar_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
