"""Names are found without a row per word being sorted or moved, and rated where they are found."""

import random
from datetime import datetime, timedelta

from storyloom.functions.columns import WINDOW_HOURS
from storyloom.operators import gates as T
from storyloom.operators import names as N

RULES = N.NameRules(word=r"\p{L}+", prefixes="d", punctuation=r"[\p{P}\p{S}]", role_titles=(), possessives=(), opponents=())
ARTICLES = "article_id string, title string, subtitle string, event_type string, sport string, published_at timestamp, source string"


def articles():
    rng = random.Random(3)
    text = lambda: " ".join(rng.choice(("the", "the", "ann", "dann", "bob", "carol", "eve", "live", "zed", "dzed")) for _ in range(rng.randrange(4)))
    start = datetime(1969, 12, 30)
    return [(f"x{i:03}", text(), text(), rng.choice(("signing", "injury", "schedule")), rng.choice(("tennis", "football", "unknown")), start + timedelta(hours=rng.choice((0, 24, 48, 72, 96)) + rng.choice((0, 0, 1, -1))), "s") for i in range(120)]


def wanted(rows):
    """(article, source, place) of lone words that are kept, and whether a form is known around."""
    form = lambda w: {w, w[1:]} if len(w) > 3 and w[0] == "d" else {w}
    free = lambda ws, i: 0 <= i < len(ws) and ws[i] != "the"
    pairs = lambda t: {w for ws in [t.split()] for i, w in enumerate(ws) if free(ws, i) and (free(ws, i - 1) or free(ws, i + 1))}
    lexicon = {r[0]: {f for t in r[1:3] for w in pairs(t) for f in form(w)} for r in rows}
    out = {}
    for x in rows:
        band = timedelta(hours=WINDOW_HOURS.get(x[3], 24))
        clash = lambda p: x[4] in T.PROVEN_SPORTS and p[4] in T.PROVEN_SPORTS and x[4] != p[4]
        around = [p for p in rows if x[3] != "schedule" and p[3] == x[3] and "live" not in p[1] + " " + p[2] and abs(p[5] - x[5]) <= band and not clash(p)]
        for source, text in (("title", x[1]), ("subtitle", x[2])):
            ws = text.split()
            for i, w in enumerate(ws):
                if free(ws, i):
                    known = any(form(w) & lexicon[p[0]] for p in around)
                    if known or form(w) & pairs(text):
                        out[x[0], source, i] = known
    return out


def test_lone_words_equal_a_search_through_all_articles(spark):
    rows = articles()
    vocabulary = spark.createDataFrame([("the", N.LISTED)], "word string, kinds int")
    got = N.candidates(spark.createDataFrame(rows, ARTICLES), vocabulary, RULES).filter("generation_rule = 'corroborated_single'")
    want = wanted(rows)
    assert {(r.article_id, r.source, r.token_start): r.population_corroborated for r in got.collect()} == want
    assert len(set(want.values())) == 2 and "Window" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_ratings_on_the_way_are_those_of_the_spans(spark):
    df = spark.createDataFrame(articles(), ARTICLES)
    vocabulary = spark.createDataFrame([("the", N.LISTED)], "word string, kinds int")
    zipf = spark.createDataFrame([("ann", 4.5), ("bob", 3.9), ("zed", 2.5), ("dzed", 1.0)], "word string, zipf double")
    shown = lambda found: sorted(tuple(r) for r in N.validated(found, zipf, RULES).select("article_id", "source", "token_start", "anchor", "max_zipf", "decision", "reason_code").collect())
    assert shown(N.candidates(df, vocabulary, RULES, frequencies=zipf)) == shown(N.candidates(df, vocabulary, RULES))
