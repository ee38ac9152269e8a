"""Every text against every item, place by place, in plain Python on the words the templates give."""

import math
import random

from pyspark.sql import functions as F

from storyloom.llm import decontamination as D

NAMES = ["Anna", "Bob", "Eve", "Tom", "Maria"]


def numbered(t, r):
    seen = {}
    return [seen.setdefault((a, b), i + 1) if a in D.SLOTS else 0 for i, (a, b) in enumerate(zip(t, r))]


def places(t, r):
    s = min(D.WINDOW, len(t))
    p = numbered(t, r)
    cut = [(t[i : i + s], r[i : i + s], p[i : i + s]) for i in range(len(t) - s + 1)]
    return [(i, *c) for i, c in enumerate(cut) if any(c[1])]


def leak(doc, item):
    """(places met, all places, exact) of an item in a text, each given as (template words, raw words)."""
    t, r = doc
    spots = places(*item)
    if not spots:
        return None
    s = len(spots[0][1])
    n = len(t) - s + 1
    shifts = {}
    for i, it, _, ip in spots:
        if any(w and w not in D.SLOTS for w in it):
            for at in range(n):
                if t[at : at + s] == it:
                    shifts.setdefault(at - i, []).append((i, {(p, r[at + k]) for k, p in enumerate(ip) if p}))
    met = set()
    for matches in shifts.values():
        told = set().union(*(x for _, x in matches))
        if len(told) == len({a for a, _ in told}) == len({b for _, b in told}):
            met |= {i for i, _ in matches}
    own = {i for i, _, ir, _ in spots if any(r[at : at + s] == ir for at in range(n))}
    slotted = {i for i, _, _, ip in spots if any(ip)}
    both = met | own
    if len(both) < math.ceil(len(spots) * D.SHARE - 1e-9):
        return None
    return len(both), len(spots), both & slotted <= own


def test_against_brute_force(spark):
    rnd = random.Random(11)
    vocabulary = ["".join(rnd.choice("abcde") for _ in range(rnd.randint(1, 4))) for _ in range(60)]

    def line(n):
        return " ".join(rnd.choice([rnd.choice(vocabulary)] * 6 + [rnd.choice(NAMES), str(rnd.randint(1, 30)), str(rnd.randint(1, 30)) + " km", "|", "Then."]) for _ in range(n))

    items = [(i, line(n)) for i, n in enumerate([1, 2, 3, 4, 5, 6, 6, 7, 9, 12, 15, 20, 25, 30, 40, 60])]
    # Items of one template, an item twice, one of punctuation and one of numbers alone.
    items += [(50 + k, f"{rnd.choice(NAMES)} has {k + 3} red apples and gives {n} away") for k, n in enumerate((4, 9, 5, 3))]
    items += [(60, items[9][1]), (61, "| , ."), (62, "1 2 3 4 5 6")]
    docs = []
    for i in range(220):
        parts = [line(rnd.choice((0, 3, 30)))]
        for _ in range(rnd.choice((0, 1, 2))):
            text = rnd.choice(items)[1]
            for _ in range(rnd.choice((0, 0, 1, 3))):
                a, b = rnd.choice(NAMES), rnd.choice(NAMES)
                text = text.replace(a, b).replace(" " + str(rnd.randint(1, 30)) + " ", " " + str(rnd.randint(1, 30)) + " ")
            words = text.split(" ")
            if rnd.random() < 0.4:
                words[rnd.randrange(len(words))] = "xyz"
            parts.append(rnd.choice((str, str, str.upper, str.title))(" ".join(words)))
        docs.append((i, rnd.choice(("\n", " ", " \t")).join([*parts, line(3)])))

    def worded(rows, trim):
        t = F.trim(D._spaced(F.col("text"))) if trim else F.col("text")
        frame = spark.createDataFrame(rows, "id long, text string").select("id", D.template(t).alias("t"), D.raw_words(t).alias("r"))
        return {x.id: (x.t, x.r) for x in frame.collect()}

    own, asked = worded(docs, False), worded(items, True)
    want = {(d, i): x for d, w in own.items() for i, v in asked.items() if (x := leak(w, v))}
    got = D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): (r.n_windows, round(r.coverage * 1000), r.kind == "exact") for r in got} == {k: (n, round(1000 * n / m), e) for k, (n, m, e) in want.items()}
    assert len({i for _, i in want}) > 15 and len(got) == len(want) > 150


def test_items_of_any_length_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "Ann has 3 cats", "w", 1), (2, "so Ann has 3 cats now", "w", 2), (3, "we see", "w", 3), (4, None, "w", 4)], "doc_id long, text string, class string, h int")
    items = spark.createDataFrame([(1, "Ann has 3 cats", "x"), (2, "  ", "x"), (3, "", "x")], "item_id long, text string, place string")
    got = sorted((r.doc_id, r.item_id, r.kind, r.coverage) for r in D.leaks(docs, items).collect())
    assert got == [(1, 1, "exact", 1.0), (2, 1, "exact", 1.0)]


def test_an_array_and_columns_hash_alike(spark):
    r = spark.sql("SELECT 'a' a, 'b' b, array('a', 'b') x").select((D._hash("t", 2, F.col("a"), F.col("b")) == D._hash("t", 2, F.col("x"))).alias("same")).first()
    assert r.same
