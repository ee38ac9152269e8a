"""Which articles tell the same story: document frequencies, pairs and their verdicts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import WINDOW_HOURS, case, hours_between
from .gates import PROVEN_SPORTS, clusterable
from .graph import saved


def document_frequency(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """token and df: the number of rows that hold it (token arrays are distinct)."""
    return df.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))


#: Parts the tokens of an article where they travel as one string.
SEPARATOR = "\x1f"
#: Hebrew letters that may stand before a word.
PREFIXES = "ובהלמשכ"
# Articles of a kind of event and time that meet in one task at most (those of the next slot come on top),
# articles of a group from which a token is counted by a product of matrices, tokens of one such product, pairs of a batch.
MOST_MET, OFTEN, WIDTH, BATCH = 2048, 16, 2048, 50_000


def _common(own: DataFrame, most_df: int, df_ratio: float) -> list[str]:
    """The tokens of so many articles that they are not rare.  There are at most 1 / ``df_ratio`` times as many of them as
    an article has tokens on average."""
    n = own.count()
    each = own.filter("n > 0").select(F.explode(F.split("words", SEPARATOR)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return [r.token for r in each.filter((F.col("df") > most_df) & (F.col("df") > n * df_ratio)).select("token").collect()]


def _met(own: DataFrame, block: str, widest_hours: int, most: int) -> DataFrame:
    """The articles dealt to the groups in which they meet all others of their block within the widest window, each pair
    once.  ``late``: whether an article stands in a group to meet its first ones only.

    Slots are twice as long as the window.  A slot of more than ``most`` articles has parts, by the article's hash, that
    meet each other and those of the next slot in groups of two; one part, as a rule, meets itself and the next slot's
    articles of one window."""
    wide = 3_600_000_000 * widest_hours
    own = own.filter(F.col("article_id").isNotNull() & F.col(block).isNotNull() & F.col("published_at").isNotNull()).withColumn("at", F.unix_micros("published_at"))
    own = own.withColumn("slot", F.expr(f"(at - pmod(at, {2 * wide})) div {2 * wide}"))
    # Slots that need parts are few: at most one for every ``most`` articles.
    dense = saved(own.groupBy(block, "slot").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select(block, "slot", F.ceil(F.col("n") / most).cast("int").alias("parts")))
    for name, step in (("here", 0), ("before", 1), ("after", -1)):
        own = own.join(F.broadcast(dense.select(block, (F.col("slot") + step).alias("slot"), F.col("parts").alias(name))), [block, "slot"], "left").withColumn(name, F.coalesce(name, F.lit(1)))
    own = own.withColumn("part", F.pmod(F.xxhash64("article_id"), F.col("here")).cast("int"))
    part, one = F.col("part"), F.lit(1)
    span = lambda lo, hi: F.when(lo < hi, F.sequence(lo, hi - 1)).otherwise(F.array().cast("array<int>"))
    group = lambda slot, i, to, j, late: F.struct(slot.alias("from_slot"), i.alias("from_part"), to.alias("to_slot"), j.alias("to_part"), F.lit(late).alias("late"))
    first = F.concat(
        F.transform(span(part + 1, F.col("here")), lambda j: group(F.col("slot"), part, F.col("slot"), j, False)),
        F.transform(span(F.lit(0), F.col("after")), lambda j: group(F.col("slot"), part, F.col("slot") + one, j, False)),
    )
    near = F.col("at") - F.col("slot") * F.lit(2 * wide) <= F.lit(wide)
    second = F.concat(
        F.transform(span(F.lit(0), part), lambda i: group(F.col("slot"), i, F.col("slot"), part, True)),
        F.transform(span(F.lit(0), F.when(near, F.col("before")).otherwise(0)), lambda i: group(F.col("slot") - one, i, F.col("slot"), part, True)),
    )
    return own.withColumn("g", F.explode(F.concat(first, second))).select("*", "g.*").drop("g", "slot", "part", "here", "before", "after", "published_at")


def _product(rows: np.ndarray, tokens: np.ndarray, n_first: int, n: int) -> np.ndarray:
    """How many tokens each of the first ``n_first`` of ``n`` articles shares with each; ``rows`` hold ``tokens``."""
    out = np.zeros((n_first, n), np.float32)
    order = np.lexsort((rows, tokens))
    rows, tokens = rows[order], tokens[order]
    held = np.bincount(tokens)
    often = held[tokens] >= OFTEN
    some, of = rows[~often], tokens[~often]
    met = [some[:-d][same].astype(np.int64) * n + some[d:][same] for d in range(1, min(OFTEN, len(some))) if (same := (of[d:] == of[:-d]) & (some[:-d] < n_first)).any()]
    if met:
        out += np.bincount(np.concatenate(met), minlength=n_first * n).reshape(n_first, n)
    n_often = int((held >= OFTEN).sum())
    place, rows = (np.cumsum(held >= OFTEN) - 1)[tokens[often]], rows[often]
    for low in range(0, n_often, WIDTH):
        here = (place >= low) & (place < low + WIDTH)
        holds = np.zeros((n, min(WIDTH, n_often - low)), np.float32)
        holds[rows[here], place[here] - low] = 1
        out += holds[:n_first] @ holds.T
    # Above the diagonal only: the first meet each other once, and nobody meets itself.
    out[:, :n_first] = np.triu(out[:, :n_first], 1)
    return out


def _pairs_of(kept: list[str], not_rare: list[str], widest_hours: int, least: float):
    """The pairs of a group, as record batches."""
    wide = 3_600_000_000 * widest_hours

    def pairs(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).combine_chunks()
        t = t.take(pc.sort_indices(t, [("late", "ascending"), ("at", "ascending")]))
        late, at, n = t["late"].to_numpy(), t["at"].to_numpy(), t["n"].to_numpy()
        named, ids = np.unique(t["article_id"].to_numpy(), return_inverse=True)
        first = int((~late).sum())
        if first == 0:
            return
        lists = pc.split_pattern(t["words"].combine_chunks(), SEPARATOR)
        code = pc.list_flatten(lists).dictionary_encode()
        rows = np.repeat(np.arange(len(n)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        tokens, listed = code.indices.to_numpy(), pc.is_in(code.dictionary, pa.array(not_rare, pa.string())).to_numpy(zero_copy_only=False)
        held = np.bincount(tokens, minlength=len(listed))
        use = (held[tokens] > 1) & (n[rows] > 0)
        rows, tokens = rows[use], tokens[use]
        rare = _product(rows[~listed[tokens]], tokens[~listed[tokens]], first, len(n))
        # The first of a group meet each other in one group only, that with the next slot's first part.
        if not (key[3].as_py() == key[1].as_py() + 1 and key[4].as_py() == 0):
            rare[:, :first] = 0
        x, y = np.nonzero(rare)
        keep = (np.abs(at[x] - at[y]) <= wide) & (ids[x] != ids[y])
        if least > 0:
            keep &= np.minimum(n[x], n[y]) >= least * np.maximum(n[x], n[y])
        x, y = x[keep], y[keep]
        if not len(x):
            return
        shared = (rare + _product(rows[listed[tokens]], tokens[listed[tokens]], first, len(n)))[x, y].astype(np.int64)
        n_rare = rare[x, y].astype(np.int64)
        if len(named) < len(ids):  # an article that is there twice counts twice
            _, both = np.unique(np.minimum(ids[x], ids[y]) * len(ids) + np.maximum(ids[x], ids[y]), return_inverse=True)
            n_rare = np.bincount(both, n_rare)[both].astype(np.int64)
        if least > 0:
            alike = shared / (n[x] + n[y] - shared) >= least
            x, y, shared, n_rare = x[alike], y[alike], shared[alike], n_rare[alike]
        a, b = np.where(ids[x] < ids[y], x, y), np.where(ids[x] < ids[y], y, x)
        for k in range(0, len(a), BATCH):
            i, j = a[k : k + BATCH], b[k : k + BATCH]
            sides = [t[c].combine_chunks().take(pa.array(w)) for w in (i, j) for c in ("article_id", *kept)]
            counts = [pa.array(v[k : k + BATCH]) for v in (n_rare, shared)] + [pa.array(n[w].astype(np.int64)) for w in (i, j)]
            yield pa.RecordBatch.from_arrays(sides + counts, names=[f"{s}_{c}" for s in "ab" for c in ("id", *kept)] + ["n_rare", "shared", "n_a", "n_b"])

    return pairs


def candidate_pairs(
    df: DataFrame, most_df: int = 6, df_ratio: float = 0.01, widest_hours: int = 48, block: str = "event_type", generic: tuple[str, ...] = (), least: float = 0.0, kept: tuple[str, ...] = (), most_met: int = MOST_MET
) -> DataFrame:
    """Pairs (a before b by article_id) of one block within the widest window that share a rare token: one of df at most
    ``most_df`` or of at most ``df_ratio`` of all articles, and not generic; n_rare counts them, shared all tokens in
    common, n_a and n_b the tokens of each.  ``kept`` columns come along as structs a and b.  Pairs of a similarity under
    ``least`` are not made.

    Articles meet within a block and a time slot, and there each token is counted over all of them at once: what moves are
    articles, one and a half times each, never a row per token or pair.  ``tokens`` are distinct strings."""
    kept = tuple(c for c in kept if c != "published_at")
    words = F.coalesce(F.col("tokens"), F.array().cast("array<string>"))
    own = saved(df.select("article_id", *dict.fromkeys((block, "published_at", *kept)), F.size(words).alias("n"), F.array_join(words, SEPARATOR).alias("words")))
    not_rare = list({*_common(own, most_df, df_ratio), *generic, *(p + g for p in PREFIXES for g in generic if len(g) > 2)})
    met = _met(own, block, widest_hours, most_met)
    sent = ("at", *kept)
    types = {f.name: f.dataType.simpleString() for f in met.schema.fields}
    schema = ", ".join(f"{s}_{c} {types[c] if c != 'id' else 'string'}" for s in "ab" for c in ("id", *sent)) + ", n_rare long, shared long, n_a long, n_b long"
    keys = (block, "from_slot", "from_part", "to_slot", "to_part")
    found = met.select(*keys, *[c for c in dict.fromkeys(("late", "article_id", "n", "words", *sent)) if c not in keys]).groupBy(*keys).applyInArrow(_pairs_of(list(sent), not_rare, widest_hours, least), schema)
    side = lambda s: F.struct(*[F.col(f"{s}_{c}").alias(c) for c in kept], F.timestamp_micros(f"{s}_at").alias("published_at")).alias(s)
    return found.select("a_id", "b_id", "n_rare", "shared", "n_a", "n_b", *([side("a"), side("b")] if kept else []))


def alike() -> Column:
    """The similarity of a pair: shared over all distinct tokens, 0 if either has none."""
    union = F.col("n_a") + F.col("n_b") - F.col("shared")
    return F.when((F.col("n_a") == 0) | (F.col("n_b") == 0), F.lit(0.0)).otherwise(F.col("shared") / union)


# Least similarity and rare words of each tier.
TIERS = {"A": (0.30, 1), "B": (0.35, 1), "C": (0.35, 2)}


# Reasons, in the order of the gates.
REASONS = (
    "same_source", "not_clusterable_state", "event_state_incompatible", "claim_reversal_mismatch", "in_play", "outside_time_window", "cross_sport", "below_threshold", "no_discriminative_evidence",
)


def verdicts(pairs: DataFrame) -> DataFrame:
    """Adds jaccard (rounded), tier and reason: the first gate that a pair fails, null for an accepted one.

    Gates in order: same source, not clusterable (a kind of event that is not listed abstains), other event, one side
    claims what the other does not, in play, outside the window, contradicting sports, too little in common, too few rare
    words.  News and unproven sports are tier C, pairs that share a competition or an entity tier A, others B.
    ``pairs`` as from ``candidate_pairs``, with source, event_type, sport, competition, entities, claim and live
    (``in_play``) kept."""
    a, b = F.col("a"), F.col("b")
    j = alike()
    known = a["sport"].isin(*PROVEN_SPORTS) & b["sport"].isin(*PROVEN_SPORTS)
    backed = F.coalesce(a["competition"] == b["competition"], F.lit(False)) | F.coalesce(F.arrays_overlap(a["entities"], b["entities"]), F.lit(False))
    tier = F.when((a["event_type"] == "news") | ~known, "C").when(backed, "A").otherwise("B")
    least = case(tier, {t: v for t, (v, _) in TIERS.items()})
    need = case(tier, {t: n for t, (_, n) in TIERS.items()})
    fails = (
        a["source"] == b["source"],
        ~(clusterable(a["event_type"]) & clusterable(b["event_type"])),
        a["event_type"] != b["event_type"],
        a["claim"] != b["claim"],
        a["live"] | b["live"],
        F.abs(hours_between(a["published_at"], b["published_at"])) > case(a["event_type"], WINDOW_HOURS, 24),
        known & (a["sport"] != b["sport"]),
        j < least,
        F.col("n_rare") < need,
    )
    return pairs.withColumn("jaccard", F.round(j, 4)).withColumn("tier", tier).withColumn("reason", F.coalesce(*[F.when(f, r) for f, r in zip(fails, REASONS)]))


def generic_token(token: Column, generic: tuple[str, ...], prefixes: str = PREFIXES) -> Column:
    """Whether a token is listed as generic, as it is or, if longer than three, without one Hebrew prefix letter."""
    bare = F.when((F.length(token) > 3) & F.substring(token, 1, 1).isin(*prefixes), F.substring(token, 2, 1000))
    return token.isin(*generic) | F.coalesce(bare.isin(*generic), F.lit(False))


def skeleton(name: Column) -> Column:
    """A Hebrew name's words with doubled vav and yod collapsed and those that do not stand first dropped; ids (with a
    colon) pass through."""
    once = F.regexp_replace(F.regexp_replace(name, "וו+", "ו"), "יי+", "י")
    return F.when(name.contains(":"), name).otherwise(F.regexp_replace(once, "(?<=[^ ])[וי]", ""))


def republished(pairs: DataFrame, hours: float = 6.0, least: float = 0.40, contained: float = 0.55, rare: int = 2) -> DataFrame:
    """Pairs of one source that repeat each other: close in time, titles alike and one largely within the other."""
    a, b = F.col("a"), F.col("b")
    within = F.col("shared") / F.greatest(F.least("n_a", "n_b"), F.lit(1))
    return pairs.filter(
        (a["source"] == b["source"])
        & (a["event_type"] == b["event_type"])
        & (a["event_type"] != "news")
        & (F.abs(hours_between(a["published_at"], b["published_at"])) <= hours)
        & (alike() >= least)
        & (within >= contained)
        & (F.col("n_rare") >= rare)
    )
