import math
import random
import re
import subprocess
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from storyloom.llm import pitman_yor as H


def plain(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), ""]


def corpus(n=160, seed=1):
    rnd = random.Random(seed)
    syllables = ["ba", "to", "é", "rin", "ka", "lu"]
    word = lambda: "".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 3)))
    rows = [(0, None), (1, ""), (2, " \n"), (3, "One one ONE")]
    return rows + [(i, " ".join(rnd.choice(("the", "of", word())) for _ in range(rnd.randint(1, 60)))) for i in range(4, n)]


def test_base_columns_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(H, "CHUNK_BYTES", 700)  # several chunks and shards
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("chunk", F.lit("clash"))
    got = {r.doc_id: r for r in H.score_texts(docs, F.col("doc_id") % 7 != 2).collect()}
    c = Counter(w for i, t in rows if i % 7 != 2 for w in plain(t))
    n, v = sum(c.values()), len(c)
    for i, t in rows:
        ws = plain(t)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(got[i].base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
    held = [i for i, t in rows if i % 7 == 2 and t]
    assert sum(got[i].score for i in held) > sum(got[i].base_score for i in held)


def test_probabilities_sum_to_one(spark, monkeypatch):
    """From scores of texts of no, one and two words: what follows the start and each word sums to one."""
    monkeypatch.setattr(H, "CHUNK_BYTES", 40)  # several chunks, shards and classes
    words = ["aa", "ab", "b", "the", "new"]
    texts = ["", *words, *(f"{u} {w}" for u in words for w in words)]
    rows = [(0, "aa aa ab the the the b the aa ab the aa ab")] + list(enumerate(texts, 1))
    got = {r.doc_id: 10**r.score for r in H.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") == 0).collect()}
    p = {t: got[i] for i, t in enumerate(texts, 1)}
    # p("u w") / p("w") is first(u) * next(w | u) / first(w), p("u") is first(u) * end(u): with what follows u summing to
    # one, first(u) = p("u") + the sum over w of p("u w") / p("w") * first(w).
    m = np.array([[p[f"{u} {w}"] / p[w] for w in words] for u in words])
    first = np.linalg.solve(np.eye(len(words)) - m, np.array([p[w] for w in words]))
    assert math.isclose(first.sum() + p[""], 1, rel_tol=1e-3)
    assert (first > 0).all()


def test_word_order_counts(spark):
    rows = [(i, "the cat sat on a mat") for i in range(20)] + [(20, "the cat sat on a mat"), (21, "mat a on sat cat the")]
    got = {r.doc_id: r.score for r in H.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") < 20).collect()}
    assert got[20] > got[21] + 3


def test_pairs_of_a_chunk_and_their_packing():
    rnd = random.Random(4)
    texts = [H.words_of(" ".join(rnd.choice("abcdefg") for _ in range(rnd.randint(0, 9)))) for _ in range(50)]
    parts, words, before, now = H.tokens_of(texts, 3)
    assert sorted(words) == sorted({w for ws in texts for w in ws}) and [words[i] for i in now] == [w for ws in texts for w in ws]
    want = Counter((u, w) for ws in texts for u, w in zip([b"", *ws], ws))
    pairs = H.Pairs(before, now, words, 3)
    count = np.bincount(pairs.at, minlength=len(pairs.word))
    kind, code = H.codes(words, 3)
    got = Counter()
    for s, i in zip(pairs.shards, pairs.parts):
        w, u, c = H.unpack_pairs(H.pack_pairs(pairs.word[i], pairs.context[i], count[i]))
        for key in zip(u.tolist(), w.tolist(), c.tolist()):
            got[s % 3, key[0], s // 3, key[1]] = key[2]
    name = {w: (k, c) for w, k, c in zip(words, kind.tolist(), code.tolist())}
    assert got == Counter({(*name[u], *name[w]): c for (u, w), c in want.items()})


def test_spelling_is_a_distribution():
    joined = b"the\nthen\nthat\nof\non\n\n"
    context, symbol = H.contexts(np.frombuffer(joined, np.uint8))
    keys, n = np.unique((context << 8) | symbol, return_counts=True)
    model = H.Spelling(keys, n)
    usable = [b for b in range(256) if not 65 <= b <= 90 and b not in (9, 11, 12, 13, 32)]
    assert len(usable) == H.SYMBOLS
    for log in model.log:
        assert np.allclose(np.exp(log[:, usable]).sum(axis=1), 1, atol=1e-4)
    assert (model.words(joined) < 0).all() and len(model.words(joined)) == 6


def test_stirling_numbers_and_moves():
    d = 0.5
    s = H.log_stirling(d, 6)
    want = np.zeros((7, 7))
    want[0, 0] = 1
    for n in range(6):
        for t in range(1, 7):
            want[n + 1, t] = want[n, t - 1] + (n - d * t) * want[n, t]
    assert np.allclose(np.exp(s[1:, 1:]), want[1:, 1:])
    # The stationary distribution of the moves is that of the number of tables: pull**t * S(n, t) for a fixed pull.
    seats = H.Seating(np.full(40000, 5), d, np.random.default_rng(0))
    pull = np.full(40000, 0.7)
    for _ in range(80):
        seats.move(pull)
    p = np.array([0.7**t * want[5, t] for t in range(1, 6)])
    assert np.allclose(np.bincount(seats.t, minlength=6)[1:] / 40000, p / p.sum(), atol=0.01)


def test_nothing_to_learn(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert H.score_texts(empty, F.lit(True)).count() == 0
    rows = H.score_texts(spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string"), F.lit(False)).collect()
    assert [(r.n_known, r.train_tokens) for r in rows] == [(0, 0)] * 3
    assert all(math.isfinite(r.score) for r in rows)
    assert zlib.crc32(b"") == 0


GROWS_BY = """
import random
import pyarrow as pa
from storyloom.llm import pitman_yor as H

def peak():
    return int(next(x for x in open("/proc/self/status") if x.startswith("VmHWM")).split()[1]) * 1024

def texts(n):
    rnd = random.Random(n)
    some = ["".join(rnd.choices("abcdefghijklmnop", k=rnd.randint(2, 8))) for _ in range(8 * n)]
    return pa.table({"chunk": [0] * n, "text": [" ".join(rnd.choices(some, k=500)) for _ in range(n)], "learn": [i % 7 > 0 for i in range(n)]})

H._ask(9)(texts(300))
t = texts(3000)
open("/proc/self/clear_refs", "w").write("5")
before = peak()
H._ask(9)(t)
print((peak() - before) / t["text"].nbytes)
"""


def test_a_chunk_is_not_held_as_words():
    done = subprocess.run([sys.executable, "-c", GROWS_BY], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2])
    assert float(done.stdout) < 18, "bytes a byte of text"
