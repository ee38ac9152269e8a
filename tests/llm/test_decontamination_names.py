"""Names wherever they stand, and copies in any case and wrapping."""

from storyloom.llm import decontamination as D

ITEMS = [
    (1, "Anna has 12 apples. Tom takes 5 of them. How many does Anna keep?"),
    (2, "the farmer said that Maria sold 40 eggs to Peter while Maria kept 15 eggs for the long winter"),
]
FILL = "some words that have nothing to do with the matter at all"


def run(spark, docs):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    return sorted((r.doc_id, r.item_id, r.kind) for r in D.leaks(d, spark.createDataFrame(ITEMS, "item_id long, text string")).collect())


def test_names_at_the_start_of_sentences_and_lines(spark):
    new = "Bob has 31 apples. Eve takes 8 of them. How many does Bob keep?"
    docs = [
        (1, f"{FILL}. {new} {FILL}"),
        (2, f"{FILL} 7 {new}"),
        (3, f"{FILL}\n{new}\n{FILL}"),
        (4, f"{FILL} “{new}” {FILL}"),
        (5, f"{FILL}. Bob has 31 apples. Eve takes 8 of them. How many does Eve keep? Cid does. {FILL}"),
        (6, FILL),
    ]
    got = run(spark, docs)
    assert [g for g in got if g[0] != 5] == [(i, 1, "reparameterised") for i in (1, 2, 3, 4)]


def test_copies_in_any_case_and_wrapping(spark):
    docs = []
    for k, (i, t) in enumerate(ITEMS):
        docs += [(10 * k + n, f"{FILL} {x} {FILL}") for n, x in enumerate((t.lower(), t.upper(), t.replace(" ", "\n"), t.replace(" ", "  \t"), t.title()))]
    assert run(spark, docs) == [(10 * k + n, i, "exact") for k, (i, _) in enumerate(ITEMS) for n in range(5)]
