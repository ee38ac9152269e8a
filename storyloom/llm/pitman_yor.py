"""Language-model scoring by a hierarchical Pitman-Yor model.

A word comes from the restaurant of the word before it (of the end, at the start of a text).  The tables of all these
draw their dishes from one word restaurant that they share as parent, and the tables of that from a spelling model: byte
restaurants in the context of one, two and three preceding bytes (the farther ones by class), each sharing its parent with all contexts that end
alike, down to a root over all bytes.  Numbers of tables are sampled by Gibbs moves of single customers, with seatings
at the tables summed out (a moved customer had opened its table with a ratio of generalised Stirling numbers), and
predictive probabilities are averaged over samples.

Texts are dealt to chunks, words and pairs of words to shards, both in number proportional to the input.  A chunk asks
the shards for its distinct words and pairs, with its training counts.  Pairs are dealt on a grid, by the class of the
context and the class of the word, so that neither a frequent context nor a frequent word lands in one shard.  A shard of
pairs samples its seatings with a word restaurant of its own class of words as parent, answers each chunk and tells the
shards of words how many customers fewer than tokens their words have, and how many tables fewer than customers their
restaurants.  Shards of words add counts up, hold the word restaurant and answer each chunk.  The spelling model has at
most 65,536 contexts of 226 symbols however large the corpus is; it alone passes the driver.

In pairs a word is known by its class and 32 more bits of its hash, and words that agree there are one.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from itertools import batched, chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_of_id, table, written

CHUNK_BYTES = 12 << 20
#: Texts of a chunk whose words are Python objects at a time.
BLOCK = 256
#: The end of a word, and what stands before its first byte; also the spelling of the end of a text, the empty word.
STOP = 10
#: Bytes that a lower-cased word can have, and the stop.
SYMBOLS = 256 - 26 - 6 + 1
DISCOUNT = (0.4, 0.5, 0.6, 0.7)
STRENGTH = (1.0, 1.0, 2.0, 2.0)
WORD_STRENGTH = 10.0
#: Of the restaurants in the context of a word.
PAIR_DISCOUNT, PAIR_STRENGTH = 0.8, 1.0
BURN, SAMPLES, MOVES = 6, 8, 4
STIRLING = 160


def log_stirling(d: float, size: int = STIRLING) -> np.ndarray:
    """log of the generalised Stirling numbers of n customers at t tables, for discount d and n, t up to ``size``."""
    out = np.full((size + 1, size + 1), -np.inf)
    out[0, 0] = 0.0
    t = np.arange(size + 1)
    for n in range(size):
        stay = np.maximum(n - d * t, 1e-300)
        out[n + 1] = np.where(t > 0, np.logaddexp(np.concatenate([[-np.inf], out[n, :-1]]), np.log(stay) + out[n]), -np.inf)
        out[n + 1, n + 2 :] = -np.inf
    return out


class Seating:
    """Numbers of tables of many (restaurant, dish) pairs with known numbers of customers, moved by Gibbs steps."""

    def __init__(self, n: np.ndarray, d: float, rng: np.random.Generator):
        self.n, self.d, self.rng, self.t = n.astype(np.int64), d, rng, np.ones(len(n), np.int64)
        s = log_stirling(d)
        with np.errstate(invalid="ignore"):
            ratio = np.exp(s[:-1, :-1] - s[1:, 1:])
        #: opened[n, t]: the chance that a customer of n at t tables is the one who opened its table.
        self.opened = np.zeros_like(s)
        self.opened[1:, 1:] = np.nan_to_num(ratio)

    def start(self, pull: np.ndarray) -> None:
        """Near the expected number of tables; ``pull`` is (strength + discount * tables) * parent's probability."""
        guess = 1 + pull * np.log((pull + self.n) / (pull + 1))
        self.t = np.clip(np.rint(guess), 1, self.n).astype(np.int64)

    def alone(self) -> np.ndarray:
        n, t = self.n, self.t
        far = (t - 1) / np.maximum(n - 1, 1)
        out = far * (self.d + (1 - self.d) * far)  # what the ratio tends to for many customers
        near = n <= STIRLING
        out[near] = self.opened[n[near], t[near]]
        return np.where(n == 1, 1.0, out)

    def move(self, pull: np.ndarray) -> None:
        """One customer of every pair gets up and sits down again."""
        t = self.t - (self.rng.random(len(self.t)) < self.alone())
        old = np.maximum(self.n - 1 - self.d * t, 0.0)
        new = np.where((self.n == 1) | (t == 0), 1.0, pull / np.maximum(pull + old, 1e-300))
        self.t = np.minimum(t + (self.rng.random(len(t)) < new), self.n)

    def refill(self, n: np.ndarray) -> None:
        self.n = n.astype(np.int64)
        self.t = np.clip(self.t, 1, np.maximum(self.n, 1))


def contexts(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For words laid end to end, each closed by a stop: the context of every symbol, and the symbols."""
    one, two, three = (np.concatenate([np.full(k, STOP, np.uint8), raw[:-k]]) if len(raw) >= k else np.full(len(raw), STOP, np.uint8) for k in (1, 2, 3))
    two = np.where(one == STOP, STOP, two)
    three = np.where(two == STOP, STOP, three)
    return (one.astype(np.int64) << 8) | ((two.astype(np.int64) & 31) << 3) | (three.astype(np.int64) & 7), raw


class Spelling:
    """Averaged predictive probabilities of symbols: a dense row for each seen context of three bytes, two, one, none."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, seed: int = 3):
        """``keys`` are context * 256 + symbol, each with its number of customers."""
        rng = np.random.default_rng(seed)
        #: Shifts that shorten a context's key to that of its parent: three, two, one, no bytes.
        levels = [keys]
        for shift in (3, 5, 8):
            context, symbol = levels[-1] >> 8, levels[-1] & 255
            levels.append(np.unique(((context >> shift) << 8) | symbol))
        levels, n = levels[::-1], [None, None, None, counts]
        parent = [None] * 4  # of each pair, its pair one level up
        rooms = [np.unique(k >> 8) for k in levels]
        row = [np.searchsorted(r, k >> 8) for r, k in zip(rooms, levels)]
        above = [None] * 4  # of each restaurant, its parent's row
        for i, shift in zip((3, 2, 1), (3, 5, 8)):
            up = (((levels[i] >> 8) >> shift) << 8) | (levels[i] & 255)
            parent[i] = np.searchsorted(levels[i - 1], up)
            above[i] = np.searchsorted(rooms[i - 1], rooms[i] >> shift)
            n[i - 1] = np.bincount(parent[i], minlength=len(levels[i - 1]))
        seats = [Seating(c, d, rng) for c, d in zip(n, DISCOUNT)]
        total = [np.zeros((len(r), 256)) for r in rooms]
        for step in range(BURN + SAMPLES):
            p = self._predict(seats, levels, rooms, row, above)
            if step >= BURN:
                for i in range(4):
                    total[i] += p[i] / SAMPLES
            for i in (3, 2, 1, 0):
                upper = np.full(len(levels[0]), 1 / SYMBOLS) if i == 0 else p[i - 1][above[i][row[i]], levels[i] & 255]
                for k in range(MOVES):
                    tables = np.bincount(row[i], seats[i].t, len(rooms[i]))
                    pull = (STRENGTH[i] + DISCOUNT[i] * tables[row[i]]) * upper
                    if step == 0 and k == 0:
                        seats[i].start(pull)
                    seats[i].move(pull)
                if i:
                    seats[i - 1].refill(np.bincount(parent[i], seats[i].t, len(levels[i - 1])))
        self.rooms = rooms
        self.log = [np.log(np.maximum(t, 1e-12)).astype(np.float32) for t in total]

    @staticmethod
    def _predict(seats, levels, rooms, row, above) -> list[np.ndarray]:
        out = []
        for i in range(4):
            size = len(rooms[i])
            c = np.bincount(row[i], seats[i].n, size) + STRENGTH[i]
            tables = np.bincount(row[i], seats[i].t, size)
            base = out[-1][above[i]] if i else np.full((size, 256), 1 / SYMBOLS)
            p = ((STRENGTH[i] + DISCOUNT[i] * tables) / c)[:, None] * base
            p[row[i], levels[i] & 255] += (seats[i].n - DISCOUNT[i] * seats[i].t) / c[row[i]]
            out.append(p)
        return out

    def words(self, joined: bytes) -> np.ndarray:
        """The natural log of the probability of each word; ``joined`` has each word closed by a stop."""
        raw = np.frombuffer(joined, np.uint8)
        context, symbol = contexts(raw)
        out = self.log[0][0][symbol] if len(self.rooms[0]) else np.full(len(raw), -np.log(SYMBOLS), np.float32)
        for rooms, log, shift in zip(self.rooms[1:], self.log[1:], (8, 3, 0)):
            if len(rooms):
                at = np.minimum(np.searchsorted(rooms, context >> shift), len(rooms) - 1)
                known = rooms[at] == context >> shift
                out = np.where(known, log[at, symbol], out)
        ends = np.flatnonzero(raw == STOP)
        sums = np.cumsum(out, dtype=np.float64)[ends]
        return np.diff(sums, prepend=0.0)


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, A-Z lower-cased, and the end, which is the empty word."""
    return [*(text or "").encode().lower().split(), b""]


def codes(words: list[bytes], side: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each word its class, one of ``side``, and the code that tells it from others of the class."""
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    return (h % np.uint64(side)).astype(np.int64), ((h // np.uint64(side)) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def pack_words(words: list[bytes]) -> bytes:
    return zlib.compress(b"\n".join(words) + b"\n", 1)


def unpack_words(data: bytes) -> tuple[list[bytes], bytes]:
    joined = zlib.decompress(data)
    return joined[:-1].split(b"\n"), joined


def pack(a: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(a).tobytes(), 1)


def unpack(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), kind)


def words_in(texts: pa.ChunkedArray, kept: list[bool]) -> Iterator[list[bytes]]:
    """The words of each text that is ``kept``; few texts are unpacked at a time."""
    for at in range(0, len(texts), BLOCK):
        yield from map(words_of, compress(texts.slice(at, BLOCK).to_pylist(), kept[at : at + BLOCK]))


def tokens_of(texts: Iterable[list[bytes]], side: int) -> tuple[dict[int, list[bytes]], list[bytes], np.ndarray, np.ndarray]:
    """For texts laid end to end: the distinct words by shard and in one list, the place in it of each token, and that of
    the token before it (the end, for a first one).  No more than a block of texts is held as lists of words."""
    blocks = [pa.array(list(chain.from_iterable(some)), pa.binary()) for some in batched(texts, BLOCK)]
    if not blocks:
        return {}, [], np.zeros(0, np.int32), np.zeros(0, np.int32)
    flat = pa.chunked_array(blocks, pa.binary()).dictionary_encode().unify_dictionaries()
    del blocks
    found, now = flat.chunk(0).dictionary, np.concatenate([x.indices.to_numpy() for x in flat.chunks])
    del flat
    order = pc.sort_indices(found).to_numpy()
    words = found.to_numpy(zero_copy_only=False)
    kind, code = codes(words.tolist(), side)
    shard = kind * side + code % side
    order = order[np.argsort(shard[order], kind="stable")]
    words, shard = words[order].tolist(), shard[order]
    first = np.flatnonzero(np.diff(shard, prepend=-1))
    parts = {s: words[a:b] for s, a, b in zip(shard[first].tolist(), first.tolist(), [*first[1:].tolist(), len(words)])}
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order))
    now = place[now]
    return parts, words, np.roll(now, 1), now  # every text closes with the end


def lengths_of(words: list[bytes], now: np.ndarray) -> np.ndarray:
    """The number of tokens of each text; none is without the end."""
    return np.diff(np.flatnonzero(now == words.index(b"")), prepend=-1) if words else np.zeros(0, np.int64)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and each key's place among them."""
    order = np.argsort(keys)
    ordered = keys[order]
    first = np.ones(len(keys), bool)
    first[1:] = ordered[1:] != ordered[:-1]
    ordered, at = ordered[first], np.empty(len(keys), np.int32)
    at[order] = np.cumsum(first, dtype=np.int32) - np.int32(1)
    return ordered, at


class Pairs:
    """The distinct pairs of a chunk in the order in which shards are asked for them, and each pair's place in it.

    ``words`` are known by their places in a list."""

    def __init__(self, before: np.ndarray, now: np.ndarray, words: list[bytes], side: int):
        kind, code = codes(words, side)
        order, size = np.lexsort((code, kind)), max(1, len(words))
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(words))
        keys = kind[now]  # in place, as this array has the length of the chunk
        keys *= side
        keys += kind[before]
        keys *= size
        keys += rank[now]
        keys *= size
        keys += rank[before]
        keys, self.at = distinct(keys)
        self.word, self.context = code[order][keys // size % size], code[order][keys % size]
        self.shards, start = np.unique(keys // size**2, return_index=True)
        self.parts = np.split(np.arange(len(keys)), start[1:])


def pack_pairs(word: np.ndarray, context: np.ndarray, count: np.ndarray) -> bytes:
    """``word`` is ascending and stored as steps."""
    step = np.diff(word, prepend=0).astype("<u4")
    planes = [step.view(np.uint8).reshape(-1, 4).T.ravel(), context.astype("<u4").view(np.uint8), count.astype("<u4").view(np.uint8).reshape(-1, 4).T.ravel()]
    return zlib.compress(b"".join(p.tobytes() for p in planes), 1)


def unpack_pairs(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(zlib.decompress(data), np.uint8).reshape(3, -1)
    step, count = (np.ascontiguousarray(raw[i].reshape(4, -1).T).view("<u4").ravel().astype(np.int64) for i in (0, 2))
    return np.cumsum(step), raw[1].view("<u4").astype(np.int64), count


ASKED = pa.schema([("shard", pa.int64()), ("chunk", pa.int64()), ("words", pa.binary()), ("counts", pa.binary()), ("pairs", pa.binary())])


def _ask(side: int):
    def run(t: pa.Table) -> pa.Table:
        learn = [bool(x) for x in t["learn"].to_pylist()]
        texts = chain(words_in(t["text"], learn), words_in(t["text"], [not x for x in learn]))
        parts, words, before, now = tokens_of(texts, side)
        learned = lengths_of(words, now)[: sum(learn)].sum()  # these come first
        tokens = np.bincount(now[:learned], minlength=len(words))
        pairs = Pairs(before, now, words, side)
        count = np.bincount(pairs.at[:learned], minlength=len(pairs.word))
        asked = {s: pack_pairs(pairs.word[i], pairs.context[i], count[i]) for s, i in zip(pairs.shards.tolist(), pairs.parts)}
        chunk, first, rows = t["chunk"][0].as_py(), 0, []
        for shard in [*parts, *(asked.keys() - parts.keys())]:
            ws = parts.get(shard, [])
            rows.append((shard, chunk, pack_words(ws) if ws else None, pack(tokens[first : first + len(ws)].astype("<i8")), asked.get(shard)))
            first += len(ws)
        return pa.table(dict(zip(ASKED.names, zip(*rows))), schema=ASKED)

    return run


def _seat_pairs(side: int, d: float):
    """Seat the pairs of a shard; rows for chunks (discounted counts of the pairs asked for) and for shards of words."""

    def run(t: pa.Table) -> pa.Table:
        shard, asked = t["shard"][0].as_py(), [unpack_pairs(x.as_py()) for x in t["pairs"]]
        sizes = [len(w) for w, _, _ in asked]
        word, context, count = (np.concatenate(x) for x in zip(*asked))
        del asked
        keys, at = distinct((word.astype(np.uint64) << np.uint64(32)) | context.astype(np.uint64))
        del word, context
        n = np.bincount(at, count, len(keys)).astype(np.int64)
        mean, last, rows = np.minimum(n, 1).astype(float), np.minimum(n, 1), []
        seen = np.flatnonzero(n)
        words, dish = distinct((keys[seen] >> np.uint64(32)).astype(np.int64))
        rooms, room = distinct((keys[seen] & np.uint64(0xFFFFFFFF)).astype(np.int64))
        if len(seen):
            many = np.flatnonzero(n[seen] > 1)  # a single customer has one table
            rng = np.random.default_rng(shard)
            seats, tables = Seating(n[seen][many], PAIR_DISCOUNT, rng), np.ones(len(seen), np.int64)
            parent = Seating(np.bincount(dish, tables, len(words)), d, rng)
            total = np.zeros(len(many))
            for step in range(BURN + SAMPLES):
                parent.refill(np.bincount(dish, tables, len(words)))
                upper = (WORD_STRENGTH + d * parent.t.sum()) / len(words)
                if step == 0:
                    parent.start(np.full(len(words), upper))
                parent.move(np.full(len(words), upper))
                chance = (parent.n - d * parent.t + upper) / (WORD_STRENGTH + parent.n.sum())
                for k in range(MOVES):
                    pull = (PAIR_STRENGTH / side + PAIR_DISCOUNT * np.bincount(room, tables, len(rooms))[room[many]]) * chance[dish[many]]
                    if step == 0 and k == 0:
                        seats.start(pull)
                    seats.move(pull)
                    tables[many] = seats.t
                if step >= BURN:
                    total += seats.t / SAMPLES
            last[seen], mean[seen[many]] = tables, total
            for role, names, row, less in ((1, words, dish, n[seen] - last[seen]), (2, rooms, room, n[seen] - mean[seen])):
                cut = np.bincount(row, less, len(names))
                some = np.flatnonzero(cut)
                kind = shard // side if role == 1 else shard % side
                to = names[some] % side
                for k in np.unique(to).tolist():
                    i = some[to == k]
                    rows.append((role, kind * side + k, shard, pack(names[i].astype("<u4")), pack(cut[i].astype("<f8"))))
        left = (n - PAIR_DISCOUNT * mean).astype("<f4")
        first = 0
        for chunk, size in zip(t["chunk"].to_pylist(), sizes):
            rows.append((0, chunk, shard, None, pack(left[at[first : first + size]])))
            first += size
        return pa.table(dict(zip(PAIRED.names, zip(*rows))), schema=PAIRED)

    return run


PAIRED = pa.schema([("role", pa.int64()), ("key", pa.int64()), ("shard", pa.int64()), ("codes", pa.binary()), ("data", pa.binary())])
PAIRED_SQL = "role long, key long, shard long, codes binary, data binary"


def _merge(t: pa.Table) -> pa.Table:
    total: dict[bytes, int] = {}
    for data, counts in zip(t["words"], t["counts"]):
        for w, c in zip(unpack_words(data.as_py())[0], unpack(counts.as_py(), "<i8").tolist()):
            total[w] = total.get(w, 0) + c
    known = sorted(w for w, c in total.items() if c)
    n = np.array([total[w] for w in known], "<i8")
    return pa.table(
        {
            "shard": pa.array([t["shard"][0].as_py()], pa.int64()),
            "words": pa.array([pack_words(known) if known else b""], pa.binary()),
            "counts": pa.array([pack(n)], pa.binary()),
            "tokens": pa.array([int(n.sum())], pa.int64()),
            "types": pa.array([len(n)], pa.int64()),
            "ones": pa.array([int((n == 1).sum())], pa.int64()),
            "twos": pa.array([int((n == 2).sum())], pa.int64()),
        }
    )


MERGED = "shard long, words binary, counts binary, tokens long, types long, ones long, twos long"


def _seated_customers(side: int):
    """Of a shard's words: customers in the word restaurant, and tables in the restaurant of the context they are."""

    def run(t: pa.Table, told: pa.Table) -> pa.Table:
        words = unpack_words(t["words"][0].as_py())[0] if t["words"][0].as_py() else []
        count = unpack(t["counts"][0].as_py(), "<i8")
        code, less = codes(words, side)[1], {1: np.zeros(len(words)), 2: np.zeros(len(words))}
        for role in (1, 2):
            mine = [(unpack(c.as_py(), "<u4"), unpack(x.as_py(), "<f8")) for r, c, x in zip(told["role"].to_pylist(), told["codes"], told["data"]) if r == role]
            if mine and len(words):
                names, at = np.unique(np.concatenate([c for c, _ in mine]).astype(np.int64), return_inverse=True)
                cut = np.bincount(at, np.concatenate([x for _, x in mine]))
                i = np.minimum(np.searchsorted(names, code), len(names) - 1)
                less[role] = np.where(names[i] == code, cut[i], 0.0)
        customers = np.clip(np.rint(count - less[1]), 1, None).astype("<i8")
        tables = np.clip(count - less[2], 0, None).astype("<f4")
        return pa.table(
            {
                "shard": t["shard"],
                "words": t["words"],
                "counts": t["counts"],
                "customers": pa.array([pack(customers)], pa.binary()),
                "tables": pa.array([pack(tables)], pa.binary()),
                "seated": pa.array([int(customers.sum())], pa.int64()),
                "ones": pa.array([int((customers == 1).sum())], pa.int64()),
                "twos": pa.array([int((customers == 2).sum())], pa.int64()),
            }
        )

    return run


VOCABULARY = "shard long, words binary, counts binary, customers binary, tables binary, seated long, ones long, twos long"


def _seat_words(spelling: Spelling | None, d: float, tables: float):
    """Tables of a shard's words, averaged over samples and as last sampled; without a spelling model, one each."""

    def run(t: pa.Table) -> pa.Table:
        shard, data, counts = (t[c][0].as_py() for c in ("shard", "words", "customers"))
        n = unpack(counts, "<i8")
        if not len(n):
            keys, weights, mean, mass = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), 0.0
        else:
            joined = zlib.decompress(data)
            last, mean, mass = np.ones(len(n), np.int64), np.ones(len(n)), 0.0
            if spelling is not None:
                seats = Seating(n, d, np.random.default_rng(shard))
                spelt = np.exp(spelling.words(joined))
                mass, pull = float(spelt.sum()), (WORD_STRENGTH + d * tables) * spelt
                seats.start(pull)
                mean = np.zeros(len(n))
                for step in range(MOVES * (BURN + SAMPLES)):
                    seats.move(pull)
                    if step >= MOVES * BURN and step % MOVES == 0:
                        mean = mean + seats.t / SAMPLES
                last = seats.t
            context, symbol = contexts(np.frombuffer(joined, np.uint8))
            word = np.cumsum(symbol == STOP) - (symbol == STOP)
            keys, at = np.unique((context << 8) | symbol, return_inverse=True)
            weights = np.bincount(at, last[word].astype(float)).astype(np.int64)
        return pa.table(
            {
                "shard": pa.array([shard], pa.int64()),
                "mean": pa.array([pack(np.asarray(mean, "<f8"))], pa.binary()),
                "tables": pa.array([float(np.sum(mean))], pa.float64()),
                "mass": pa.array([mass], pa.float64()),
                "keys": pa.array([keys.tolist()], pa.list_(pa.int64())),
                "weights": pa.array([weights.tolist()], pa.list_(pa.int64())),
            }
        )

    return run


SEATED = "shard long, mean binary, tables double, mass double, keys array<long>, weights array<long>"


TOLD = pa.schema([("chunk", pa.int64()), ("shard", pa.int64()), ("chance", pa.binary()), ("count", pa.binary()), ("tables", pa.binary())])


def _answer(spelling: Spelling, d: float, seated: int, tables: float, mass: float):
    # What the spelling model leaves to words that were not learned is one outcome, as it is in the base score.
    unknown = (WORD_STRENGTH + d * tables) * max(1e-9, 1 - mass) / (WORD_STRENGTH + seated)

    def run(asked: pa.Table, vocabulary: pa.Table) -> pa.Table:
        at: dict[bytes, int] = {}
        # The last place is that of words that were not learned.
        count, chance, rooms = np.zeros(1, "<i8"), np.full(1, unknown), np.zeros(1)
        if vocabulary.num_rows and vocabulary["words"][0].as_py():
            known, joined = unpack_words(vocabulary["words"][0].as_py())
            at = dict(zip(known, range(len(known))))
            c, n, mean, t = (unpack(vocabulary[x][0].as_py(), k) for x, k in (("counts", "<i8"), ("customers", "<i8"), ("mean", "<f8"), ("tables", "<f4")))
            found = (n - d * mean + (WORD_STRENGTH + d * tables) * np.exp(spelling.words(joined))) / (WORD_STRENGTH + seated)
            count, chance, rooms = np.append(c, 0), np.append(found, unknown), np.append(t, 0.0)
        rows = []
        for chunk, data in zip(asked["chunk"].to_pylist(), asked["words"]):
            i = np.array([at.get(w, -1) for w in unpack_words(data.as_py())[0]])
            rows.append((chunk, asked["shard"][0].as_py(), pack(chance[i].astype("<f4")), pack(count[i].astype("<i8")), pack(rooms[i].astype("<f4"))))
        return pa.table(dict(zip(TOLD.names, zip(*rows))) if rows else {c: [] for c in TOLD.names}, schema=TOLD)

    return run


def _score(side: int, tokens: int, types: int):
    def run(t: pa.Table, answers: pa.Table) -> pa.Table:
        parts, words, before, now = tokens_of(words_in(t["text"], [True] * t.num_rows), side)
        pairs, told, left = Pairs(before, now, words, side), {}, {}
        for s, p, c, r, x in zip(answers["shard"].to_pylist(), *(answers[k] for k in ("chance", "count", "tables", "data"))):
            if x.is_valid:
                left[s] = unpack(x.as_py(), "<f4")
            else:
                told[s] = unpack(p.as_py(), "<f4"), unpack(c.as_py(), "<i8"), unpack(r.as_py(), "<f4")
        chance, count, tables = (np.concatenate([told[s][k] for s in parts] or [np.zeros(0)]) for k in range(3))
        own = np.concatenate([left[s] for s in pairs.shards.tolist()] or [np.zeros(0)])[pairs.at]
        score = (PAIR_STRENGTH + PAIR_DISCOUNT * tables.astype(float))[before]
        score *= chance.astype(float)[now]
        score += own
        score /= (PAIR_STRENGTH + count)[before]
        np.log10(score, out=score)
        base = np.log10((count + 1) / (tokens + types + 1))[now]
        length = lengths_of(words, now)
        start = np.cumsum(length) - length
        add = lambda x: np.add.reduceat(x, start) if len(start) else x
        return pa.table(
            {
                "doc_id": t["doc_id"],
                "n_tokens": pa.array(length, pa.int64()),
                "n_known": pa.array(add((count > 0).astype(np.int64)[now]), pa.int64()),
                "base_score": pa.array(add(base), pa.float64()),
                "score": pa.array(add(score), pa.float64()),
            }
        )

    return run


def _discount(ones: int, twos: int) -> float:
    return min(0.95, max(0.1, (ones + 1) / (ones + 2 * twos + 2)))


def _spelling(seated: DataFrame, seed: int) -> Spelling:
    """The spelling model of all shards' tables: at most 65,536 contexts of 226 symbols, whatever the corpus."""
    rows = (
        seated.select(F.explode(F.arrays_zip("keys", "weights")).alias("p"))
        .groupBy(F.col("p.keys").alias("key"))
        .agg(F.sum("p.weights").alias("n"))
        .toArrow()
    )
    keys, n = rows["key"].to_numpy(), rows["n"].to_numpy()
    order = np.argsort(keys)
    return Spelling(keys[order].astype(np.int64), n[order].astype(np.int64), seed)


def score_texts(docs: DataFrame, learn: Column, rounds: int = 2) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row of (doc_id, text).

    The model learns from the rows where ``learn`` holds.  A null text is empty: its only token is the end.  Repeated
    rows count and are scored each.  All words that were not learned are one outcome, whose probability is what the word
    restaurant leaves to its parent times what the spelling model leaves to unlearned words; if nothing was learned it is
    the only one.  After a word that was not learned the word restaurant decides."""
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), learn.alias("learn"))
    size = texts.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    chunks = max(1, (size[0] or 0) // CHUNK_BYTES + size[1] // 500_000)
    side = math.isqrt(chunks - 1) + 1  # shards are the squares of a grid of this side
    texts = texts.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("long"))
    asked = written(texts.select("chunk", "text", "learn").groupBy("chunk").applyInArrow(_ask(side), "shard long, chunk long, words binary, counts binary, pairs binary"))
    spoken = asked.filter("words IS NOT NULL")
    merged = written(spoken.select("shard", "words", "counts").groupBy("shard").applyInArrow(_merge, MERGED))
    tokens, types, ones, twos = (int(x or 0) for x in merged.agg(*[F.sum(c) for c in ("tokens", "types", "ones", "twos")]).first())
    paired = written(asked.filter("pairs IS NOT NULL").select("shard", "chunk", "pairs").groupBy("shard").applyInArrow(_seat_pairs(side, _discount(ones, twos)), PAIRED_SQL))
    told = paired.filter("role > 0").select(F.col("key").alias("shard"), "role", "codes", "data")
    vocabulary = written(merged.select("shard", "words", "counts").groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(_seated_customers(side), VOCABULARY))
    customers, ones, twos = (int(x or 0) for x in vocabulary.agg(*[F.sum(c) for c in ("seated", "ones", "twos")]).first())
    d = _discount(ones, twos)
    seats = vocabulary.select("shard", "words", "customers").groupBy("shard")
    spelling, tables = _spelling(written(seats.applyInArrow(_seat_words(None, d, types), SEATED)), 0), float(types)
    for k in range(rounds):
        seated = written(seats.applyInArrow(_seat_words(spelling, d, tables), SEATED))
        tables, mass = (x or 0.0 for x in seated.agg(F.sum("tables"), F.sum("mass")).first())
        if k + 1 < rounds:
            spelling = _spelling(seated, k + 1)
    model = vocabulary.join(seated.select("shard", "mean"), "shard").select("shard", "words", "counts", "customers", "tables", "mean")
    answers = spoken.select("shard", "chunk", "words").groupBy("shard").cogroup(model.groupBy("shard")).applyInArrow(
        _answer(spelling, d, customers, tables, mass), "chunk long, shard long, chance binary, count binary, tables binary"
    )
    answers = answers.unionByName(paired.filter("role = 0").select(F.col("key").alias("chunk"), "shard", "data"), allowMissingColumns=True)
    scored = texts.select("chunk", "doc_id", "text").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        _score(side, tokens, types), "doc_id long, n_tokens long, n_known long, base_score double, score double"
    )
    return scored.select("doc_id", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every whole text of ``documents``; a seventh of them, by crc32 of the id, is held out."""
    held = crc_of_id(F.col("doc_id")) % 7 == 2
    found = score_texts(table(spark, sf_dir, "documents"), ~held)
    return found.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


