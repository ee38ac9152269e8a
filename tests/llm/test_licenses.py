import re
from itertools import accumulate

from pyspark.sql import functions as F

from storyloom.llm import licenses as L


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    norm = " " + " ".join(ws) + " "
    base = []
    for phrase, label in L.BASE:
        p = phrase.split()
        base += [(i, label) for i in range(len(ws)) if ws[i : i + len(p)] == p]
    found = []
    for r in L.rules():
        if " " + r.keyword in norm:
            at = 0
            while m := re.compile(f" {r.pattern}(?= )").search(norm, at):
                found.append((m.start(), m.end(), r.label, r.priority))
                at = m.end()
    kept = {
        d[2]
        for d in found
        if not any(o[0] <= d[0] and o[1] >= d[1] and (o[1] - o[0] > d[1] - d[0] or o[3] > d[3] or (o[3] == d[3] and o[2] < d[2])) for o in found)
    }
    at = [i for i, _ in base]
    own = sorted({label for _, label in base})
    return len(ws), len(base), min(at, default=None), max(at, default=None), ",".join(own), ",".join(sorted(kept | set(own)))


TEXTS = [
    None,
    "",
    "?!",
    "Licensed under the Apache License, Version 2.0.",
    "MIT License mit license MIT-LICENSE",
    "x GNU General Public License v3 or later; gnu general  public license. End",
    "CC BY-NC 4.0 and cc by",
    "This is CC-BY-SA 4.0 International license, gplv2 or any later version, LGPL 2.1",
    "committed emit licenses apache licensee",
    "Permission is hereby granted, free of charge, to any person obtaining a copy. BSD 3-Clause License",
    "Neither the name of the Äther Project may be used to endorse or promote products. All rights reserved.",
    "word " * 20000 + "mit license",
    # More matches than a block of running sums holds, and letters of more than one byte.
    "gpl 2 " * 600 + "Ä gnu gpl v3 or any later version é " * 40,
]


def test_scan_against_brute_force(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "y"), (None, TEXTS[4], "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, labels string")
    got = sorted(tuple(r)[:7] for r in L.scan(docs).collect() if r.doc_id is not None)
    want = sorted((i, *brute(t)) for i, t, _ in rows if i is not None)
    assert got == want
    assert all(0 <= r.score <= 1 for r in L.scan(docs).collect())
    assert L.scan(docs).count() == len(rows)


def test_running_values_in_blocks(spark):
    values = [(i * 37) % 11 + 1 for i in range(L.BLOCK * 2 + 5)]
    df = spark.createDataFrame([(values[:n],) for n in (0, 1, L.BLOCK, L.BLOCK + 1, len(values))], "v array<int>")
    got = df.select("v", L.running(F.col("v"), lambda x, y: x + y).alias("s"), L.running(F.col("v"), lambda x, y: F.greatest(x, y)).alias("m")).collect()
    assert all(r.s == list(accumulate(r.v)) and r.m == list(accumulate(r.v, max)) for r in got)


def test_a_dense_megabyte_is_scanned(spark):
    r = L.scan(spark.createDataFrame([(1, "gpl 2 " * 170_000)], "doc_id long, text string")).first()
    assert (r.n_words, r.labels) == (340_000, "gpl-2")


def test_every_pattern_holds_its_keyword():
    assert len(L.rules()) > 300
    for r in L.rules():
        assert r.keyword in r.pattern, r


def test_empty_table(spark):
    assert L.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
