"""Rare expressions count: few labels, one predecessor, few occurrences."""

import random

import numpy as np

from storyloom.llm import toxicity as X
from storyloom.llm.labelled import Sample


def corpus(toxic, ordinary, seed=4):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice(["ba", "to", "ri", "ka", "lu", "me"]) for _ in range(rnd.randint(1, 4))) for _ in range(400)]
    texts, labels = [], []
    for i in range(toxic + ordinary):
        ws = [rnd.choice(vocabulary) for _ in range(rnd.randint(30, 120))]
        if i < toxic:
            ws[10:10] = ["utter", "filth"]
        texts.append(" ".join(ws))
        labels.append(int(i < toxic))
    return texts, labels


def test_a_phrase_with_one_predecessor_counts():
    texts, labels = corpus(30, 300)
    model = X.Model().fit(Sample(texts, labels, (300, 30)))
    assert model.ratios(["utter", "filth"]).sum() > 2
    clean, _ = corpus(0, 40, 5)
    with_phrase = [" ".join([*t.split()[:15], "utter filth", *t.split()[15:]]) for t in clean]
    assert np.mean([model.score(t) >= 0.7 for t in with_phrase]) > 0.9
    assert np.mean([model.score(t) >= 0.7 for t in clean]) < 0.1


def test_a_pair_seen_a_few_times_counts():
    model = X.Model()
    both = [f"a b{i} c d{i} e" for i in range(20)]
    model.count([[*t.split(), "c", "e"] if k else t.split() for k in (0, 1) for t in both], [0] * 20 + [1] * 20)
    after, alone = model.ratios(["c", "e"])[1], model.ratios(["unseen", "e"])[1]
    assert after > alone + 0.3


def test_discounts_and_neutral_levels():
    d = X.discounts(np.repeat([1, 2, 3, 4], [100, 40, 20, 10]))
    y = 100 / 180
    assert np.allclose(d, [0, 1 - 2 * y * 40 / 100, 2 - 3 * y * 20 / 40, 3 - 4 * y * 10 / 20])
    assert (X.discounts(np.array([], int)) >= 0).all() and (X.discounts(np.array([7, 9]))[1:] > 0).all()
    same = X.Model()
    same.count([["x", "y", "z"], ["x", "y", "z"]], [0, 1])
    assert np.allclose(same.ratios(["x", "y", "z", "new"]), 0)
