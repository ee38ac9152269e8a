import bisect
import random
from zlib import crc32

import numpy as np
import pytest

from storyloom.llm import packing as P

TEXTS = [None, "", " ", "a", "  two  spaces ", "tab\tand\n\nlines \n x", "no break   space   x", "Él niño, it's don't  12 3-4", "x" * 9000, "wörd " * 3000, "<|endoftext|> here", " \x1c odd \x1d", "日本語 テキスト  です"]


def encoded(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.default_tokenizer())
    t.encode_special_tokens = True
    return [[*t.encode(x or "", add_special_tokens=False).ids, P.END_ID] for x in texts]


def test_ids_of_parts_are_ids_of_the_text():
    rnd = random.Random(1)
    odd = TEXTS[1:] + ["".join(rnd.choice([" ", " ", "\n", "\t", "a", "B", "é", "'s", "1", ".", " ", "\x85", "\x1f"]) for _ in range(60)) for _ in range(400)]
    ids = P._word_ids(P.default_tokenizer())
    for text, want in zip(odd, encoded(odd)):
        got = np.frombuffer(ids(text), "<u4").tolist() if text else []
        assert [*got, P.END_ID] == want, repr(text)


def test_frequent_words_stay_remembered_and_marks_are_words(monkeypatch):
    monkeypatch.setattr(P, "WORDS_KEPT", 40)
    monkeypatch.setattr(P, "_memory", {})
    ids = P._word_ids(P.default_tokenizer())
    texts = ["the erth and onten", "the erth, and. onten. and, x, y2. é, a.. 'b. ,. . , don't. it's, ERTH. erth.", "one erth.\nThe end.\nof erth\tx\ny z\n\nw erth.\nThe end.\nof"]
    texts += [" ".join(f"the w{i}{k} zq{'abcdefghij'[k]}," for k in range(10)) for i in range(9)] + texts
    for text, want in zip(texts, encoded(texts)):
        assert [*np.frombuffer(ids(text), "<u4").tolist(), P.END_ID] == want, text
        assert {"erth", "and", "onten"} <= P._memory[P.default_tokenizer()][2].keys()


def check(rows, want, capacity):
    pieces = {}
    sequences = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for doc_id, ids in want.items():
        own = sorted(pieces[doc_id], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert [r.start for r in own] == list(np.cumsum([0] + [r.length for r in own])[:-1])
        assert sum(r.length for r in own) == len(ids)
        assert all(r.length == capacity for r in own[1:]) and own[0].length <= capacity
        for r in own:
            assert r.ids_crc32 == crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(sequences)


def test_pack(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, length string")
    check(P.pack(docs, P.default_tokenizer()).collect(), dict(enumerate(encoded(TEXTS))), P.CAPACITY)
    assert P.pack(docs.limit(0), P.default_tokenizer()).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece_once(seed):
    rnd = random.Random(seed)
    lengths = [min(1024, max(1, int(rnd.lognormvariate(rnd.choice((4, 6)), 1)))) for _ in range(rnd.choice((1, 30, 3000, 60000)))]
    histogram = {n: lengths.count(n) for n in set(lengths)}
    rows = P.plan(histogram)
    seen, room = {}, {}
    for length, rank, n, sequence, offset in rows:
        for k in range(n):
            assert (length, rank + k) not in seen
            seen[length, rank + k] = (sequence + k, offset)
            room.setdefault(sequence + k, []).append((offset, length))
    assert sorted(seen) == sorted((n, k) for n, c in histogram.items() for k in range(c))
    for own in room.values():
        own.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and own[0][0] == 0 and sum(own[-1]) <= 1024
    assert len(room) <= best_fit_decreasing(lengths)


def best_fit_decreasing(lengths, capacity=1024):
    rooms = []
    for n in sorted(lengths, reverse=True):
        at = bisect.bisect_left(rooms, n)
        bisect.insort(rooms, (rooms.pop(at) if at < len(rooms) else capacity) - n)
    return len(rooms)


@pytest.mark.parametrize("sf", ("sf0.001", "sf0.01"))
def test_no_more_sequences_than_best_fit_decreasing(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    rows = P.pack(docs, P.default_tokenizer()).select("length", "sequence_id").collect()
    assert len({r.sequence_id for r in rows}) <= best_fit_decreasing([r.length for r in rows])
