import random
import re

from storyloom.llm import quality_rules as Q


def plain(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    places = {}
    for i in range(len(w) - 2):
        places.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {j for at in places.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def line(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 8))) for _ in range(n))


def test_counts_and_verdicts(spark):
    rnd = random.Random(4)
    odd = [None, "", " \n\t", "a", "a a a a a", "x y z x y z\n\nx y z\nx y z", "é ü | <b> ## \x0b q", "same line\nsame line\n same line", "w " * 30000]
    rows = [(i, t, None if i % 2 else "en", None, "clash") for i, t in enumerate(odd)]
    rows += [(100 + i, line(rnd, rnd.randint(60, 300)), "en", f"s{i % 2}", "clash") for i in range(300)]
    noisy = [(900 + i, " ".join(w + rnd.choice(("***", "$$$")) for w in line(rnd, 120).split()), "en", "s1", "clash") for i in range(5)]
    shout = [(950 + i, line(rnd, 120).upper(), "en", "s0", "clash") for i in range(5)]
    rows += noisy + shout + [rows[20], (None, line(rnd, 80), "xx", "tiny", "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words string")
    got = {}
    found = Q.apply_rules(docs).collect()
    assert len(found) == len(rows)
    for r in found:
        got[r.doc_id] = r
    for i, t, *_ in rows:
        r = got[i]
        want = plain(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, i
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
    assert not any(got[i].kept for i, *_ in noisy + shout)
    assert sum(got[100 + i].kept for i in range(300)) >= 299 and got[None].kept


def test_empty_table_and_too_few_rows(spark):
    schema = "doc_id long, text string, lang string, source string"
    assert Q.apply_rules(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, line(random.Random(1), 80), "en", "a"), (2, "short", "en", "a")]
    assert {r.doc_id: r.kept for r in Q.apply_rules(spark.createDataFrame(rows, schema)).collect()} == {1: True, 2: False}
