"""Evidence in texts: rule tables, claims, aliases, anchors, and integrity of the catalog they refer to."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class EventRule:
    """An event that a text shows if it has a word of every group and none of the blockers."""

    event: str
    certainty: str
    groups: tuple[tuple[str, ...], ...]
    blockers: tuple[str, ...] = ()


def _any(tokens: Column, words: tuple[str, ...]) -> Column:
    return F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in words]))


def event_of(tokens: Column, rules: tuple[EventRule, ...], default: str = "news") -> Column:
    """event and certainty of the first rule that holds, as a struct; no rule gives the default, with weak certainty."""
    out = F.struct(F.lit(default).alias("event"), F.lit("weak").alias("certainty"))
    for r in reversed(rules):
        holds = reduce(Column.__and__, [_any(tokens, g) for g in r.groups])
        if r.blockers:
            holds = holds & ~_any(tokens, r.blockers)
        out = F.when(holds, F.struct(F.lit(r.event).alias("event"), F.lit(r.certainty).alias("certainty"))).otherwise(out)
    return out


def claimed(words: Column, markers: tuple[str, ...], conditionals: tuple[str, ...]) -> Column:
    """Whether a title (its words in order) holds a marker that no conditional word stands right before."""
    marks = F.array(*[F.lit(m) for m in markers])
    before = F.array(*[F.lit(c) for c in conditionals])
    hit = F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0))), lambda i: F.coalesce(F.array_contains(marks, F.get(words, i)), F.lit(False)) & ~F.coalesce(F.array_contains(before, F.get(words, i - 1)), F.lit(False)))
    return F.size(hit) > 0


def reversed_claims(pairs: DataFrame, words_a: str, words_b: str, markers: tuple[str, ...], conditionals: tuple[str, ...]) -> DataFrame:
    """Pairs of which exactly one side makes the claim: those do not tell one story."""
    return pairs.filter(claimed(F.col(words_a), markers, conditionals) != claimed(F.col(words_b), markers, conditionals))


def alias_spans(texts: DataFrame, aliases: dict[str, str | None]) -> DataFrame:
    """article_id and the entities that a text names, in order of place: aliases are claimed longest first, a claimed
    place is not claimed again, and an alias without an entity (an ambiguous one) claims its place but names nobody.

    Claiming depends on what was claimed before, so it runs per text in batches; ``aliases`` is a small dimension."""
    import re

    ordered = sorted((a.lower() for a in aliases), key=lambda a: (-len(a), a))
    found = re.compile("|".join(rf"(?<!\w){re.escape(a)}(?!\w)" for a in ordered)) if ordered else None
    names = {a.lower(): e for a, e in aliases.items()}

    def of(text: str | None) -> list[str]:
        low, spans = (text or "").lower(), []
        for a in ordered if found and found.search(low) else ():
            at = low.find(a)
            while at >= 0:
                end = at + len(a)
                free = all(end <= s or at >= e for s, e, _ in spans)
                edge = (at == 0 or not (low[at - 1].isalnum() or low[at - 1] == "_")) and (end == len(low) or not (low[end].isalnum() or low[end] == "_"))
                if free and edge:
                    spans.append((at, end, names[a]))
                at = low.find(a, at + 1)
        return list(dict.fromkeys(e for _, _, e in sorted(spans, key=lambda s: s[0]) if e))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"article_id": b["article_id"], "entities": [of(t) for t in b["text"]]})

    return texts.select("article_id", "text").mapInPandas(run, f"article_id {texts.schema['article_id'].dataType.simpleString()}, entities array<string>")


def match_keys(anchor: Column) -> Column:
    """An anchor, its words, and its words without a one-letter prefix (of words over three letters): distinct, sorted."""
    words = F.filter(F.split(F.lower(anchor), " "), lambda w: w != "")
    bare = F.transform(F.filter(words, lambda w: F.length(w) > 3), lambda w: F.concat(F.lit("-"), F.substring(w, 2, 100)))
    return F.array_sort(F.array_distinct(F.concat(F.array(F.lower(anchor)), words, bare)))


def rescued(anchors: DataFrame, most: int = 6) -> DataFrame:
    """Pairs that share a match key of an anchor that at least one of them has in its title; keys that over ``most``
    articles have are too common to rescue anything.  ``anchors``: article_id, anchor, in_title."""
    keys = anchors.select("article_id", F.explode(match_keys(F.col("anchor"))).alias("key"), "in_title").groupBy("article_id", "key").agg(F.max("in_title").alias("in_title"))
    rare = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= most).select("key")
    own = keys.join(rare, "key")
    met = own.alias("a").join(own.alias("b"), F.expr("a.key = b.key AND a.article_id < b.article_id AND (a.in_title OR b.in_title)"))
    return met.groupBy(F.col("a.article_id").alias("a_id"), F.col("b.article_id").alias("b_id")).agg(F.count(F.lit(1)).alias("n_keys"))


def reach(entities: DataFrame, memberships: DataFrame) -> DataFrame:
    """article_id, competition and the smallest entity that reaches it, over exploded memberships."""
    return entities.join(memberships, "entity").groupBy("article_id", "competition").agg(F.min("entity").alias("through"))


def integrity(children: DataFrame, key: str, parents: DataFrame, parent_key: str, name: str) -> DataFrame:
    """check, problem and n: missing keys, keys without a parent, and parents listed twice (no row for no problem)."""
    keys = children.groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    missing = keys.filter("k IS NULL").select(F.lit("missing_key").alias("problem"), "n")
    orphans = keys.filter("k IS NOT NULL").join(parents.select(F.col(parent_key).alias("k")).distinct(), "k", "left_anti").select(F.lit("no_parent").alias("problem"), "n")
    twice = parents.groupBy(parent_key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.lit("listed_twice").alias("problem"), "n")
    return missing.union(orphans).union(twice).groupBy("problem").agg(F.sum("n").alias("n")).select(F.lit(name).alias("check"), "problem", "n")
