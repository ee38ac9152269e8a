import re

from storyloom.llm import urls as U


def fixed(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = ("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
    fit = [(len(h + p), h + p, a) for a, h, p in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fit)[1:] if fit else (None, None))


URLS = [None, "", "no scheme", "http://", "HTTP://A.Example.NET/en/x", "http://a.example.net/EN/", "https://example.net/en/?q", "http://badexample.net/en/", "http://x.example.com/de/1#y", "http://x.example.com?de/", "ftp://org/fr/", "http://my.org/fr", "http://my.org/fr/", "http://u:p@net/", "a://b://c/d"]


def test_fixed_rules(spark):
    rows = [(i, u, "clash") for i, u in enumerate(URLS)] + [(4, URLS[4], "clash"), (None, URLS[8], "clash")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in U.judge(pages, spark.createDataFrame([], "url string, block boolean")).collect()), key=repr)
    want = sorted(((i, *fixed(u)[:3], fixed(u)[3] or "allow") for i, u, _ in rows), key=repr)
    assert got == want


def test_mined_rules(spark):
    labelled = []
    for i in range(60):
        labelled += [(f"http://shop{i % 7}.example.com/cheap/pills/{i}", True), (f"http://shop{i % 7}.example.com/cheap/books/{i}", i % 10 == 0), (f"http://shop{i % 7}.example.com/pills/info/{i}", i % 12 == 0), ("http://n.example.com/x", None)]
    known = spark.createDataFrame(labelled, "url string, block boolean")
    rules = {tuple(r.rule): (r.n, r.n_block) for r in U.mine(known).collect()}
    assert rules == {("p=cheap", "p=pills"): (60, 60)}
    pages = spark.createDataFrame([(1, "http://new.example.com/cheap/pills/9?x=1"), (2, "http://new.example.com/cheap/books"), (3, "http://new.example.org/fr/"), (4, "http://q.net/cheap/pills"), (5, "http://q.example.net/en/cheap/pills")], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict, r.mined) for r in U.judge(pages, known).collect()}
    assert got == {1: (None, "block", "p=cheap p=pills"), 2: (None, "allow", None), 3: ("org/fr/", "allow", None), 4: ("net/", "block", "p=cheap p=pills"), 5: ("example.net/en/", "allow", "p=cheap p=pills")}


def test_empty(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert U.judge(none, spark.createDataFrame([], "url string, block boolean")).count() == 0
