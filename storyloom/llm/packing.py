"""Packing documents into fixed-length token sequences by a linear grouping scheme.

Only the histogram of piece lengths, at most ``capacity`` counts however large the corpus is, comes to the driver.  There
the large lengths are rounded up within groups of equal cardinality, the few rounded sizes are packed by configurations
from a linear program (column generation), the documents' own lengths take the place of the rounded ones, and what is
left goes in by best fit, long pieces first.  The plan says for "the r-th piece of length l" which sequence and place it
gets; the pieces find theirs by their rank among pieces of their length.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

CAPACITY, END_ID = 1024, 2
#: Lengths over these parts of the capacity are grouped, in turn.
PARTS = (8, 4, 3, 2)
#: Pieces in a bucket, in the mean; ranks are counted within buckets.
BUCKET = 10_000
#: Distinct words whose ids a Python worker remembers before it forgets the later half.
WORDS_KEPT, LONGEST_KEPT = 1_000_000, 40
#: White space but for the space and the line feed.
OTHER_SPACE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
#: Marks that are words of their own behind letters, and the letters below which Unicode versions agree.
MARKS, LETTERS_END = ".,", "\u0250"
#: How byte-level vocabularies write the byte of a space.
SPACE_BYTE = "\u0120"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_memory: dict = {}


def _word_ids(path: str):
    """A function from a text to its ids as little-endian 32-bit bytes.

    Byte-level BPE splits a text before a space that stands between two visible characters, so a text cut at such spaces
    has the ids of its parts, each with the space before it.  The ids of short parts are remembered; parts seen first,
    which are the frequent ones, longest.  Letters with a mark behind have the ids of the letters, then that of the
    mark.  Other parts not seen before are encoded in one go: as they hold no space but the first character, a new part
    begins where an id's bytes begin with a space."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    if path not in _memory:
        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        opens = np.zeros(tokenizer.get_vocab_size(with_added_tokens=True), bool)
        opens[[i for token, i in tokenizer.get_vocab().items() if token.startswith(SPACE_BYTE)]] = True
        marks = {c: np.array(tokenizer.encode(c, add_special_tokens=False).ids, "<u4").tobytes() for c in MARKS}
        _memory[path] = (tokenizer, opens, {}, marks)
    tokenizer, opens, known, marks = _memory[path]

    def encode(texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def ids(text: str) -> bytes:
        parts = text.split(" ")
        # White space beside a cut changes how the text is split; then the neighbours stay together.
        odd = "  " in text or "\n " in text or " \n" in text or parts[0] == "" or parts[-1] == "" or any(c in text for c in OTHER_SPACE)
        if odd:
            joined, parts = parts, []
            for p in joined:
                if parts and (not p or p[0].isspace() or not parts[-1] or parts[-1][-1].isspace()):
                    parts[-1] += " " + p
                else:
                    parts.append(p)
        first, rest = parts[0], parts[1:]
        if len(known) > WORDS_KEPT:
            for _ in range(len(known) // 2):
                known.popitem()
        found = list(map(known.get, rest))
        gaps = [i for i, x in enumerate(found) if x is None]
        new = []
        for p in {rest[i] for i in gaps}:
            if p[-1:] in marks and (letters := known.get(p[:-1])) and p[:-1].isalpha() and max(p) < LETTERS_END:
                known[p] = letters + marks[p[-1]]
            else:
                new.append(p)
        spaced = [p for p in new if " " in p] if odd else []
        whole = [p for p in new if " " not in p] if odd else new
        head, run, *apart = encode([first, "".join(" " + p for p in whole), *(" " + p for p in spaced)])
        data, at = run.tobytes(), (4 * np.flatnonzero(opens[run])).tolist()
        known.update(zip(whole, (data[a:b] for a, b in zip(at, [*at[1:], len(data)]))))
        known.update(zip(spaced, (a.tobytes() for a in apart)))
        for i in gaps:
            found[i] = known[rest[i]]
        data = head.tobytes() + b"".join(found)
        for p in new:
            if len(p) > LONGEST_KEPT:
                del known[p]
        return data

    return ids


def _pieces(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zlib import crc32

        ids, end = _word_ids(path), np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = memoryview((ids(text) if text else b"") + end)
                n = len(data) // 4
                cut = [0, *range(n % capacity or capacity, n + 1, capacity)]
                rows.extend((doc_id, k, a, b - a, crc32(data[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(cut, cut[1:])))
            cols = zip(*rows) if rows else ((),) * 5
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def cut_into_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece of every document of (doc_id, text).

    A null or empty text is one piece with the end id alone; repeated rows give repeated pieces."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_pieces(tokenizer_path, capacity), PIECES)


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[list[int], int]]:
    """(how often each size occurs in a sequence, number of such sequences): the linear program over configurations,
    solved by column generation from one-size columns, rounded down."""
    k = len(sizes)
    columns = [np.eye(k, dtype=int)[i] * (capacity // sizes[i]) for i in range(k)]
    basis, falling = list(range(k)), np.array(sizes)
    need = np.array(demand, float)
    for _ in range(60 * k):
        b = np.array([columns[j] for j in basis], float).T
        price = np.linalg.solve(b.T, np.ones(k))
        # Unbounded knapsack; sizes fall, so those that fit are the last ones.
        best = np.zeros(capacity + 1)
        took = np.full(capacity + 1, -1)
        for room in range(1, capacity + 1):
            best[room] = best[room - 1]
            fit = int(np.searchsorted(-falling, -room))
            if fit < k:
                value = best[room - falling[fit:]] + price[fit:]
                if value[at := int(value.argmax())] > best[room] + 1e-12:
                    best[room], took[room] = value[at], fit + at
        if best[capacity] <= 1 + 1e-7:
            break
        new, room = np.zeros(k, int), capacity
        while room > 0:
            if took[room] < 0:
                room -= 1
            else:
                new[took[room]] += 1
                room -= sizes[took[room]]
        change = np.linalg.solve(b, new.astype(float))
        amount = np.linalg.solve(b, need)
        ratio = np.where(change > 1e-9, np.maximum(amount, 0) / np.where(change > 1e-9, change, 1), np.inf)
        columns.append(new)
        basis[int(ratio.argmin())] = len(columns) - 1
    amount = np.linalg.solve(np.array([columns[j] for j in basis], float).T, need)
    return [(columns[j].tolist(), int(a + 1e-6)) for j, a in zip(basis, amount) if a + 1e-6 >= 1]


class _Bins:
    """Runs of equal sequences: their lengths, how many there are, by the room left in each."""

    def __init__(self, capacity: int):
        self.capacity, self.rooms, self.runs = capacity, [], {}

    def add(self, lengths: list[int], count: int) -> None:
        room = self.capacity - sum(lengths)
        if room not in self.runs:
            insort(self.rooms, room)
            self.runs[room] = []
        self.runs[room].append((lengths, count))

    def best_fit(self, length: int, count: int) -> None:
        while count:
            at = bisect_left(self.rooms, length)
            if at == len(self.rooms):
                each = self.capacity // length
                if count >= each:
                    self.add([length] * each, count // each)
                if count % each:
                    self.add([length] * (count % each), 1)
                return
            room = self.rooms[at]
            lengths, n = self.runs[room].pop()
            if not self.runs[room]:
                del self.runs[room]
                self.rooms.pop(at)
            each = room // length
            filled = min(n, count // each)
            if filled:
                self.add(lengths + [length] * each, filled)
                count, n = count - filled * each, n - filled
            elif count:
                self.add(lengths + [length] * count, 1)
                count, n = 0, n - 1
            if n:
                self.add(lengths, n)


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = 40) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, count, first sequence, offset): pieces of that length with ranks from the first on get
    sequences from the first on, at the offset.  The number of rows depends on capacity and groups, not on the corpus.

    Which lengths are large enough to be grouped is tried at the capacity's parts in PARTS; the fewest sequences win."""
    tried = [_grouped(histogram, capacity, groups, capacity // part) for part in PARTS]
    bins = min(tried, key=lambda b: sum(n for runs in b.runs.values() for _, n in runs))
    rows, sequence, rank = [], 0, dict.fromkeys(histogram, 0)
    for room in bins.rooms:
        for lengths, n in bins.runs[room]:
            offset = 0
            for length in lengths:
                rows.append((length, rank[length], n, sequence, offset))
                rank[length] += n
                offset += length
            sequence += n
    return rows


def _grouped(histogram: dict[int, int], capacity: int, groups: int, small: int) -> _Bins:
    """Sequences with lengths over ``small`` grouped.  A configuration of several sizes leaves its least one open: best
    fit fills it with the longest piece that the documents in the others leave room for."""
    bins = _Bins(capacity)
    left = {length: n for length, n in histogram.items() if n}
    large = sorted((length for length in left if small < length < capacity), reverse=True)
    total = sum(left[length] for length in large)
    if total >= groups:
        # Groups of equal cardinality, longest first; a group's size is its longest length.
        quota, grouped, open_ = -(-total // groups), [], 0
        for length in large:
            n = left[length]
            while n:
                if open_ == 0:
                    grouped.append([])
                    open_ = quota
                take = min(n, open_)
                grouped[-1].append([length, take])
                n, open_ = n - take, open_ - take
        merged: dict[int, list[list[int]]] = {}
        for g in grouped:  # groups of one length have the same size
            merged.setdefault(g[0][0], []).extend(g)
        sizes = list(merged)
        for counts, n in configurations(sizes, [sum(c for _, c in merged[s]) for s in sizes], capacity):
            slots = [s for s, c in zip(sizes, counts) for _ in range(c)]
            slots = slots[: max(1, len(slots) - 1)]
            while n and all(merged[s] for s in slots):
                # As many equal sequences as the next lengths of all slots allow.
                want: dict[int, int] = {}
                for s in slots:
                    want[s] = want.get(s, 0) + 1
                room = min(merged[s][0][1] // w for s, w in want.items())
                if room == 0:  # lengths change within a sequence
                    lengths = []
                    if any(sum(c for _, c in merged[s]) < w for s, w in want.items()):
                        break
                    for s in slots:
                        lengths.append(merged[s][0][0])
                        merged[s][0][1] -= 1
                        if not merged[s][0][1]:
                            merged[s].pop(0)
                    bins.add(lengths, 1)
                    n -= 1
                    continue
                room = min(room, n)
                bins.add([merged[s][0][0] for s in slots], room)
                for s, w in want.items():
                    merged[s][0][1] -= w * room
                    if not merged[s][0][1]:
                        merged[s].pop(0)
                n -= room
        for length in large:
            left[length] = 0
        for rest in merged.values():
            for length, c in rest:
                left[length] += c
    for length in sorted(left, reverse=True):
        if left[length]:
            bins.best_fit(length, left[length])
    return bins


def _place(rows: list[tuple[int, int, int, int, int]], capacity: int):
    table = np.array(sorted(rows) or [(0, 0, 0, 0, 0)], np.int64)
    #: Ranks stay below 2**48, lengths below 2**15.
    key = (table[:, 0] << 48) + table[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(key, (length << 48) + rank, side="right") - 1
            out = [batch.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")]
            out += [pa.array(table[at, 3] + rank - table[at, 1]), pa.array(table[at, 4])]
            yield pa.record_batch(out, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, groups: int = 40) -> DataFrame:
    """One row per piece of (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = written(cut_into_pieces(docs, tokenizer_path, capacity))
    # Ranks within a length: rows are numbered within (length, bucket), buckets by running totals of their counts.
    buckets = max(1, pieces.count() // BUCKET)
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    counts = written(pieces.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")
    ranked = pieces.withColumn("own", F.row_number().over(own)).join(starts, ["length", "bucket"])
    rows = plan(histogram, capacity, groups)
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("own") - 1).alias("rank")).mapInArrow(
        _place(rows, capacity), f"{PIECES}, sequence_id long, offset long"
    )


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack every document of ``documents``."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())
