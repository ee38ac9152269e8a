import random

from pyspark.sql import Row
from pyspark.sql import functions as F

from storyloom.llm.line_runs import LineRuns, drop_shared_lines

SPACE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def brute(texts, least):
    split = [(t or "").split("\n") for t in texts]
    seen = {}
    for ls in split:
        for k in {key(x) for x in ls} - {""}:
            seen[k] = seen.get(k, 0) + 1
    kept = [[x for x in ls if seen.get(key(x), 0) < least] for ls in split]
    return [(len(ls), len(ls) - len(own), "\n".join(own)) for ls, own in zip(split, kept)]


def rows(df):
    return sorted((r.i, r.n_lines, r.n_dropped, r.kept_text) for r in df.select("i", "n_lines", "n_dropped", "kept_text").collect())


def corpus():
    rng = random.Random(5)
    pool = ["Same line", "same LINE  ", "\tsame line", "Ünder Straße", "ÜNDER STRASSE", "ünder straße", "İ", "i̇", "K", "k", "Σας", "ΣΑΣ", "", " ", "a", "b c", "\x0bb c\r"]
    texts = ["\n".join(rng.choice(pool + [f"own {i}"]) for _ in range(rng.randint(1, 9))) for i in range(60)]
    return texts + [None, "", "\n", "same line", "\n".join(["same line"] * 3000 + ["last"]), texts[0], texts[0]]


def test_equals_brute_force_in_any_batches(spark):
    texts = corpus()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    for least in (1, 4, 20):
        want = [(i, *r) for i, r in enumerate(brute(texts, least))]
        assert rows(drop_shared_lines(docs, least=least)) == want
    for count in (3, 5):
        parts = [docs.filter(F.col("i") % count == k) for k in range(count)]
        assert rows(drop_shared_lines(docs, parts, least=4, fanout=2)) == [(i, *r) for i, r in enumerate(brute(texts, 4))]


def test_runs_are_levelled_sorted_and_merged_without_a_shuffle(spark):
    store = LineRuns(spark, least=3, fanout=2)
    for k in range(5):
        store.add(spark.createDataFrame([("hot\nx%d" % k,), ("hot",)], "text string"))
    assert [len(level) for level in store.levels] == [1, 0, 1]
    plan = store._merged(store.runs())._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    whole = store._merged(store.runs())
    assert {r.n for r in whole.collect()} == {1, 3} and whole.filter("n = 1").count() == 5
    # The last batch knew the common line and did not add it.
    assert spark.table(store.levels[0][0]).count() == 1
    store.drop()
    assert not [t for t in spark.catalog.listTables() if t.name in store.made]


def test_clashing_columns_and_empty_table(spark):
    docs = spark.createDataFrame([Row(i=1, text="a\nb", h=1, n=2, key="k", places="p", n_lines=7, kept_text="x")])
    found = drop_shared_lines(docs, least=1)
    assert found.columns == ["i", "text", "h", "n", "key", "places", "n_lines", "n_dropped", "kept_text"]
    assert rows(found) == [(1, 2, 2, "")]
    assert drop_shared_lines(docs.limit(0), least=1).count() == 0
