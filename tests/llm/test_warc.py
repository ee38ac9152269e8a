import hashlib
import re

from storyloom.llm import warc as W

BIG = "<p>é" * 100_000
TRICK = "x" * 100 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


def brute(rows):
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        same = [j for j, _, h in rows if (h or "").encode() == body and j is not None]
        first = min(same) if same else None
        revisit = len(body) >= 100 and first is not None and i != first and sum((h or "").encode() == body for _, _, h in rows) > 1
        out.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


def test_round_trip(spark):
    rows = [(5, "http://a/", BIG), (3, None, BIG), (9, "http://b\r\nX: y", BIG), (1, "u", None), (2, "u", ""), (4, "u", "short"), (6, "u", "short"), (7, "u", TRICK), (8, "u", TRICK), (10, "u", "a" * 99), (11, "u", "a" * 99), (12, "u", "b" * 100), (12, "u", "b" * 100), (None, "u", "b" * 100), (13, "u", "b" * 100)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload string")
    path = W.write_archives(pages)
    got = sorted((tuple(r) for r in W.read_archives(spark, path).collect()), key=repr)
    assert got == brute(rows)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    text = "".join(bytes(r.content).decode() for r in files.collect())
    assert text.count(BIG) == 1  # kept once
    ids = re.findall(r"(?<=\nWARC-Record-ID: )<urn:uuid:[0-9a-f-]{36}>", text)
    assert len(ids) == len(set(ids)) == len(rows)  # repeated rows have ids of their own
    refers = re.findall(r"WARC-Refers-To: (\S+)\r\nWARC-Refers-To-Target-URI: [^\r]*\r\nWARC-Refers-To-Date: ([0-9TZ:-]{20})\r\n", text)
    responses = set(re.findall(r"WARC-Type: response\r\nWARC-Record-ID: (\S+)\r\n", text))
    assert len(refers) == sum(r[3] == "revisit" for r in got) and {i for i, _ in refers} <= responses


def test_empty(spark):
    assert W.read_archives(spark, W.write_archives(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0
