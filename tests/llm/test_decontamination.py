import random

from storyloom.llm import decontamination as D

ITEMS = [
    (1, "A train leaves Paris at 9 and travels 120 km in 3 hours, while Anna waits for the train in Rome. How fast is it?"),
    (2, "the old house near the river was painted by three brothers during one long summer of rain"),
    (3, "too short"),
    (4, None),
    (None, "this item has no id but it does have more than five words"),
]
FILL = "some words that have nothing to do with the matter at all "


def run(spark, docs, items=ITEMS):
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id long")
    b = spark.createDataFrame(items, "item_id long, text string")
    return sorted((r.doc_id if r.doc_id is not None else -1, r.item_id, r.kind) for r in D.leaks(d, b).collect())


def test_kinds(spark):
    item, other = ITEMS[0][1], ITEMS[1][1]
    same = item.replace("Paris", "Oslo").replace("120", "480").replace("Anna", "Maria").replace("Rome", "Bergen").replace("9 ", "7 ").replace(" 3 ", " 5 ")
    mixed = "He saw Tom and Ann and Tom at 5 and 6 in 5 cities"
    docs = [
        (1, FILL + item + " " + FILL, 0),
        (2, FILL + same, 0),
        (3, FILL * 200 + other.upper() + " " + FILL, 0),
        (4, FILL, 0),
        (5, None, 0),
        (6, "", 0),
        (7, " ".join(other.split()[:9]), 0),
        (8, item, 0),
        (8, item, 0),
        (None, other, 0),
        (9, mixed, 0),
    ]
    assert run(spark, docs) == [(-1, 2, "exact"), (1, 1, "exact"), (2, 1, "reparameterised"), (3, 2, "exact"), (8, 1, "exact")]


def test_inconsistent_parameters_do_not_count(spark):
    items = [(1, "then Tom gave 5 apples to Ann and Tom kept 5 pears so Ann had 5 apples while Tom had 5 pears")]
    good = items[0][1].replace("Tom", "Bob").replace("Ann", "Eve").replace("5", "8")
    words = good.split()
    bad = " ".join({3: "11", 9: "12", 13: "13"}.get(i, w) for i, w in enumerate(words))
    assert run(spark, [(1, good, 0), (2, bad, 0)], items) == [(1, 1, "reparameterised")]


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, "a b c d e f", 0)], []) == []


def test_verbatim_items_in_random_texts(spark):
    rnd = random.Random(3)
    vocabulary = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 6))) for _ in range(300)]
    line = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(i, line(rnd.randint(8, 60))) for i in range(20)]
    docs, want = [], set()
    for i in range(120):
        text = line(rnd.randint(0, 300))
        if i % 3 == 0:
            k = rnd.randrange(20)
            text, _ = f"{text} {items[k][1]}\n{line(20)}", want.add((i, k, "exact"))
        docs.append((i, text, 0))
    assert run(spark, docs, items) == sorted(want)
