import math
import random
import re

import numpy as np

from storyloom.llm.impact_search import Share, search, terms

RUN = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain(text):
    return RUN.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    own = [(i, plain(t)) for i, t in docs]
    n_docs, total = sum(bool(ts) for _, ts in own), sum(len(ts) for _, ts in own)
    df = {}
    for _, ts in own:
        for t in set(ts):
            df[t] = df.get(t, 0) + 1
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(plain(t))
    out = []
    for item, want in wanted.items():
        scored = []
        for i, ts in own:
            if not ts:
                continue
            m = 10 + (90 * len(ts) * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * ts.count(t)) // (1000 * ts.count(t) + 8 * m)) for t in want if t in df)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def found(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=str)


def corpus(n):
    rng = random.Random(9)
    words = [f"w{int(rng.paretovariate(0.7)) % 80}" for _ in range(4000)] + ["Ärger", "ÄRGER", "Straße", "x-y", "É", "été"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.choice((1, 5, 40, 300))))) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, "... --"), (3, docs[7][1]), (None, docs[7][1]), (n + 3, docs[7][1]), (n + 4, "w1 " * 20000)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice((1, 3, 12))))) for i in range(25)]
    return docs, items + [(100, None), (101, "nowhere to be found"), (102, docs[7][1]), (3, "w5 W6"), (None, "w2 ärger")]


def test_terms_are_runs_of_letters_digits_and_beyond_ascii():
    for text in ("A-b_c9", "Été\x00É\x7f\t", "日本 語", "", None):
        assert [t.decode() for t in terms(text.encode() if text is not None else None)] == plain(text)


def test_equals_brute_force_in_any_shares_and_blocks(spark):
    docs, items = corpus(150)
    d = spark.createDataFrame([(i, t, 1, "r") for i, t in docs], "doc_id long, text string, item_id int, rank string").repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items, 10)
    assert found(search(d, q)) == want
    assert found(search(d, q, block_bytes=300, share=17)) == want
    assert found(search(d, q, k=3, share=40)) == brute(docs, items, 3)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a")], "item_id long, text string")
    for d, q in ((docs, asked), (some, items), (docs, items), (spark.createDataFrame([(1, None)], docs.schema), asked)):
        assert search(d, q).collect() == []


def test_stops_early_with_whole_results():
    rng = np.random.default_rng(2)
    n, k = 5000, 10
    sizes = rng.integers(1, 4, n)
    offsets = np.r_[0, np.cumsum(sizes)]
    term = np.concatenate([rng.choice(4, s, replace=False) for s in sizes])
    impact = (10**6 / (1 + rng.pareto(1.0, len(term)))).astype(np.int64)
    share = Share(sizes, offsets, term, impact)
    weights = {0: 9000, 1: 40, 2: 3, 3: 1}
    docs, scores, read = share.best(weights, k)
    full = np.bincount(np.repeat(np.arange(n), sizes), weights=np.array([weights[t] for t in term]) * impact, minlength=n).astype(np.int64)
    assert read < len(term)
    best = sorted(zip(-full, range(n)))[:k]
    assert sorted(zip((-scores).tolist(), docs.tolist()))[:k] == [(int(s), d) for s, d in best]
