"""Held-out accuracy on made texts, and the edges: nulls, empty and long texts, no labels, one label."""

import random

import numpy as np

from storyloom.llm import byte_cnn as B
from storyloom.llm import toxicity as X
from storyloom.llm.labelled import Sample, learnable, sample


def made(n, bad, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        words = ["".join(rnd.choice(["ba", "to", "ri", "ka", "lu", "me"]) for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(30, 200))]
        k = rnd.random() < 0.4
        if k:
            words = bad(rnd, words)
        rows.append((i, " ".join(words), k))
    return rows


def frames(spark, rows, column):
    odd = [(10_001, None), (10_002, ""), (10_003, "word " * 40_000), (None, "no id"), (0, rows[0][1])]
    docs = spark.createDataFrame([(i, t, 1) for i, t, _ in rows] + [(i, t, 1) for i, t in odd], "doc_id long, text string, quality int")
    labels = spark.createDataFrame([(i, int(k)) for i, _, k in rows] + [(None, 1), (5, None), (77_777, 1)], f"doc_id long, {column} int")
    return docs, labels


def held_out(found, rows, modulus, held, least):
    from zlib import crc32

    score = {r.doc_id: r.score for r in found}
    assert all(0 <= s <= 1 for s in score.values()) and {10_001, 10_002, 10_003, None} <= set(score)
    test = [(score[i] >= least) == k for i, _, k in rows if crc32(str(i).encode()) % modulus == held]
    return sum(test) / len(test)


def test_quality(spark):
    rows = [(i, t, not k) for i, t, k in made(400, lambda rnd, ws: [w + "***" for w in ws] if rnd.random() < 0.5 else [w for w in ws[:20] for _ in range(6)], 1)]
    docs, labels = frames(spark, rows, "quality")
    network = B.train(docs, labels)
    assert held_out(B.scores(docs, network).collect(), rows, 5, 0, 0.3) > 0.95
    kept = B.keep(docs, network)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    assert B.scores(docs.limit(0), network).count() == 0


def test_toxicity(spark):
    lexicon = ["nasty", "vile", "rotten", "foul"]

    def bad(rnd, ws):
        for _ in range(max(2, len(ws) // 25)):
            ws.insert(rnd.randrange(len(ws)), rnd.choice(lexicon))
        return ws

    rows = made(900, bad, 2)
    docs, labels = frames(spark, rows, "toxic")
    model = X.train(docs, labels)
    assert held_out(X.scores(docs, model).collect(), rows, 3, 1, 0.7) > 0.95
    assert X.scores(docs.limit(0), model).count() == 0


def test_without_labels_or_with_one(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    for rows, share in (([], 0.5), ([(1, 1), (3, 1)], 0.75)):
        labels = spark.createDataFrame(rows, "doc_id long, quality int")
        both = labels.withColumnRenamed("quality", "toxic")
        assert {round(r.score, 3) for r in B.scores(docs, B.Network().fit(sample(docs, labels, "quality", learnable(5, 9), 10, 100))).collect()} == {share}
        assert {round(r.score, 3) for r in X.scores(docs, X.Model().fit(sample(docs, both, "toxic", learnable(3, 9), 10, 100))).collect()} == {share}


def test_pooling_in_pieces_is_pooling_of_the_whole(monkeypatch):
    network, text = B.Network(), "some text é that is longer than a chunk " * 50
    whole = network.pool(B.symbols(text))
    monkeypatch.setattr(B, "AT_ONCE", 7)
    assert np.allclose(whole, network.pool(B.symbols(text)))
    top, at = network.pool(B.symbols(text), where=True)
    assert np.allclose(top, whole) and len(at) == B.FILTERS


def test_repeats_are_flagged():
    sym = B.symbols("word " * 10)
    assert (sym[5:40] >= 256).all() and (sym[:5] < 256).all()
    other = B.symbols("all of these are quite different words here")
    assert (other[other != B.PAD] < 256).all()
    assert len(B.symbols("")) == B.WIDTH and (B.symbols(None) == B.PAD).all()


def test_model_of_one_class_counts_nothing():
    model = X.Model().fit(Sample(["a b"], [1], (0, 1)))
    assert 0.5 < model.score("a b") < 1
