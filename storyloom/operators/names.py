"""Names that a story may be about: found by their neighbours, known to the articles around, judged by the language.

A word that is not vocabulary is a name if another such word stands beside it, or if it stands alone and an article that the
gates admit beside its own has it in such a pair.  What is found is then held against how common its words are in the
language: rare ones are names, common ones are not, and between them nothing is claimed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hebrew as H
from .gates import PERSON_STATES, gated
from .graph import saved
from .similarity import skeleton

# Frequencies (log10 of occurrences in a billion words) of ordinary words and of names.
ORDINARY, NAME = 4.4, 3.4
#: Words on either side that a candidate carries.
CONTEXT = 3
# Kinds of vocabulary. Listed words are also recognised behind a prefix letter if that leaves three letters,
# non-names if it leaves two, other words only as they are.
LISTED, NON_NAME, OTHER = 1, 2, 4


@dataclass(frozen=True)
class NameRules:
    """How a script writes words and what stands beside a name."""

    word: str = H.LETTERS
    prefixes: str = H.PREFIXES
    punctuation: str = H.PUNCTUATION
    role_titles: tuple[str, ...] = tuple(H.ROLE_TITLES)
    possessives: tuple[str, ...] = H.POSSESSIVES
    opponents: tuple[str, ...] = H.OPPONENT_MARKERS


HEBREW = NameRules()


def hebrew_vocabulary(spark, competitions: tuple[str, ...] = ()) -> DataFrame:
    """(word, kinds) of what is never a name in Hebrew headlines; words of competitions are the caller's."""
    kinds: dict[str, int] = {}
    for words, kind in ((H.STOP_WORDS + H.TEMPLATE_WORDS + H.GENERIC_WORDS, LISTED), (H.ACTION_WORDS + H.MONEY_WORDS + H.NUMBER_WORDS, NON_NAME), ([w for c in competitions for w in c.split() if len(w) > 2], OTHER)):
        for w in words:
            kinds[w] = kinds.get(w, 0) | kind
    return spark.createDataFrame(list(kinds.items()), "word string, kinds int")


def words(text: Column, rules: NameRules) -> Column:
    """The words of a text in order, lower-cased, punctuation parting them, of two letters or more."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), rules.punctuation, " ")
    return F.filter(F.regexp_extract_all(plain, F.lit(rules.word), F.lit(0)), lambda w: F.length(w) > 1)


def _prefixed(word: Column, rules: NameRules) -> Column:
    return F.substring(word, 1, 1).isin(*rules.prefixes)


def forms(word: Column, rules: NameRules) -> Column:
    """The word, and without its prefix letter if three letters remain: an additional form, never a replacement."""
    return F.when((F.length(word) > 3) & _prefixed(word, rules), F.array(word, F.substring(word, 2, 1000))).otherwise(F.array(word))


def vocabulary_forms(found: DataFrame, vocabulary: DataFrame, rules: NameRules) -> DataFrame:
    """(w) of the distinct words of ``found`` (w) of which a form is in ``vocabulary`` (word, kinds): each word of it has
    few forms, by the prefixes of the script."""
    own = found.select("w").distinct()
    one, two = F.substring("w", 2, 1000), F.substring("w", 3, 1000)
    n, first = F.length("w"), _prefixed(F.col("w"), rules)
    again = first & (n > 3) & _prefixed(one, rules)
    look = lambda form, kinds: F.struct(form.alias("word"), F.lit(kinds).alias("allowed"))
    every = F.array(
        look(F.col("w"), LISTED | NON_NAME | OTHER),
        F.when(first & (n > 3), look(one, LISTED | NON_NAME | OTHER)).when(first & (n == 3), look(one, NON_NAME)),
        F.when(again & (n > 4), look(two, LISTED | NON_NAME)).when(again, look(two, NON_NAME)),
    )
    looked = own.select("w", F.explode(F.filter(every, lambda x: x.isNotNull())).alias("x")).select("w", "x.*")
    return looked.join(vocabulary, "word").filter(F.col("kinds").bitwiseAND(F.col("allowed")) > 0).select("w").distinct()


def role(prev: Column, prev2: Column, rules: NameRules) -> Column:
    """role_holder after a possessive or a title (up to two words before), opponent after its marker, else unknown."""
    said = lambda c, of: F.coalesce(c.isin(*of), F.lit(False))
    holder = said(prev, rules.possessives) | said(prev, rules.role_titles) | said(prev2, rules.role_titles)
    return F.when(holder, "role_holder").when(said(prev, rules.opponents), "opponent").otherwise("unknown")


def _skeleton_key(word: Column) -> Column:
    return F.concat(F.lit("translit:"), skeleton(word))


SOURCES = ("title", "subtitle")


def _texts(articles: DataFrame, vocabulary: DataFrame, rules: NameRules) -> DataFrame:
    """The articles with what the gates ask for, a row number, and their titles and subtitles as ts: source, ws (words),
    free (whether each word is none of the vocabulary) and pairs (the words of pairs of such).  A written table.

    The words that are vocabulary in any form become one set of literals: as many as ``vocabulary`` has, times the forms."""
    every = articles.select(F.explode(F.concat(*[words(F.col(c), rules) for c in SOURCES])).alias("w"))
    listed = [r.w for r in vocabulary_forms(every, vocabulary, rules).collect()]
    is_free = lambda w: ~w.isin(*listed) if listed else F.lit(True)
    t = gated(articles).select("article_id", "kind", "proven", "at", "band", "live", *[words(F.col(c), rules).alias(f"{c}_ws") for c in SOURCES])
    t = t.withColumns({f"{c}_free": F.transform(f"{c}_ws", is_free) for c in SOURCES})
    beside = lambda c, i: F.coalesce(F.get(f"{c}_free", i + 1), F.lit(False)) | F.coalesce(F.get(f"{c}_free", i - 1), F.lit(False))
    paired = lambda c: F.array_distinct(F.filter(f"{c}_ws", lambda w, i: F.get(f"{c}_free", i) & beside(c, i)))
    t = t.withColumns({f"{c}_pairs": paired(c) for c in SOURCES})
    parts = [F.struct(F.lit(c).alias("source"), *[F.col(f"{c}_{x}").alias(x) for x in ("ws", "free", "pairs")]) for c in SOURCES]
    return saved(t.select("article_id", "kind", "proven", "at", "band", "live", F.monotonically_increasing_id().alias("row"), F.array(*parts).alias("ts")))


def _rated(texts: DataFrame, frequencies: DataFrame, rules: NameRules) -> DataFrame:
    """The texts with z: by place, the frequency of each word that is none of the vocabulary, by its most common form."""
    each = texts.select("row", F.posexplode("ts").alias("s", "t")).select("row", "s", F.posexplode("t.ws").alias("i", "w"), "t.free").filter(F.get("free", F.col("i"))).select("row", _place(F.col("s"), F.col("i")).alias("place"), "w")
    forms_of = each.select("w").distinct().select("w", F.explode(forms(F.col("w"), rules)).alias("word"))
    known = forms_of.join(frequencies, "word").groupBy("w").agg(F.max("zipf").alias("z"))
    z = each.join(known, "w").groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("place", "z"))).alias("z"))
    return texts.join(z, "row", "left")


def _place(s: Column, i: Column) -> Column:
    return i * len(SOURCES) + s


def _mentions(texts: DataFrame, rules: NameRules) -> DataFrame:
    """Every word of the texts that is not vocabulary, with its place, what stands beside it, next_name (the following word
    if that is not vocabulary either), in_text (whether the text has it in a pair) and own (whether an article that its own
    gates admit has it so)."""
    both = F.array_distinct(F.flatten(F.transform(F.flatten("ts.pairs"), lambda w: forms(w, rules))))
    counts = F.col("kind").isNotNull() & ~F.col("live")
    rated = ["z"] if "z" in texts.columns else []
    each = texts.select("*", F.when(counts, both).alias("named")).select("row", "article_id", "kind", "proven", "at", "band", *rated, "named", F.posexplode("ts").alias("s", "t"))
    each = each.select("*", "t.*").select("*", F.posexplode("ws").alias("i", "w")).filter(F.get("free", F.col("i")))
    i = F.col("i")
    own = forms(F.col("w"), rules)
    return each.select(
        "row", "article_id", "kind", "proven", "at", "band", "source", "s", "i", "w", F.get("ws", i - 1).alias("prev"), F.get("ws", i - 2).alias("prev2"),
        F.slice("ws", F.greatest(i - CONTEXT, F.lit(0)) + 1, F.least(i, F.lit(CONTEXT))).alias("left_context"), F.slice("ws", i + 2, CONTEXT + 1).alias("after"),
        F.when(F.get("free", i + 1), F.get("ws", i + 1)).alias("next_name"), F.arrays_overlap(own, "pairs").alias("in_text"), F.coalesce(F.arrays_overlap(own, "named"), F.lit(False)).alias("own"),
        *[F.coalesce(F.element_at("z", _place(F.col("s"), i + k)), F.lit(0.0)).alias(f"z{k}") for k in (0, 1) if rated],
    )


def _keys(word: Column, rules: NameRules) -> Column:
    return F.array_append(forms(word, rules), _skeleton_key(word))


def _known_around(texts: DataFrame, asked: DataFrame, rules: NameRules) -> DataFrame:
    """row, s and i of the mentions ``asked`` of which a pair in an article that the gates admit beside theirs has a form or
    skeleton, and known: whether a form.

    Time is cut into slots as long as the band, so a band reaches into the slot before and the one after; of each slot
    it is enough to know when a key was used first and last."""
    slot = lambda k: F.expr(f"(at - pmod(at, band)) div band + {k}")
    group = F.xxhash64("key", "kind").alias("g")
    used = texts.filter("kind IS NOT NULL AND NOT live").select("kind", "proven", "at", "band", F.explode(F.array_distinct(F.flatten(F.transform(F.flatten("ts.pairs"), lambda w: _keys(w, rules))))).alias("key"))
    span = used.select(group, slot(0).alias("slot"), "proven", "at").repartition("g", "slot").groupBy("g", "slot", "proven").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    probes = asked.select("row", "s", "i", "kind", "proven", "at", "band", F.explode(_keys(F.col("w"), rules)).alias("key"))
    probes = probes.select("row", "s", "i", group, "proven", "at", "band", (~F.startswith("key", F.lit("translit:"))).alias("surface"), F.explode(F.array(slot(-1), slot(0), slot(1))).alias("slot"))
    p, e = probes.alias("p"), span.alias("e")
    near = F.expr("p.g = e.g AND p.slot = e.slot AND e.last >= p.at - p.band AND e.first <= p.at + p.band AND (p.proven = e.proven OR p.proven = '' OR e.proven = '')")
    return p.join(e, near, "left_semi").groupBy("row", "s", "i").agg(F.max("surface").alias("known"))


def candidates(articles: DataFrame, vocabulary: DataFrame, rules: NameRules = HEBREW, resolved: DataFrame | None = None, frequencies: DataFrame | None = None) -> DataFrame:
    """Candidate names: article_id, source (title or subtitle), token_start, token_end, anchor, generation_rule,
    confidence, role, left_context, right_context, population_corroborated, entity_id; and, with ``frequencies`` (word,
    zipf), max_zipf, as ``validated`` has it.

    name_bigram: two words beside each other of which neither is vocabulary.  corroborated_single: one such word that is
    part of a pair in the same text, or whose form or skeleton a pair in an article of its population has
    (population_corroborated: a form, not only the skeleton).  canonical_taxonomy: what ``resolved`` (article_id, source,
    entity_id, taxonomy_kind) says is named there.  An article whose stories are not grouped has no population.
    ``articles``: article_id (once each), title, subtitle, event_type, sport, published_at; null texts have no words."""
    texts = _texts(articles, vocabulary, rules)
    found = _mentions(texts if frequencies is None else saved(_rated(texts, frequencies, rules)), rules)
    common = ["article_id", "source", F.col("i").alias("token_start")]
    part = role(F.col("prev"), F.col("prev2"), rules).alias("role")
    none = F.lit(None).cast("string").alias("entity_id")
    rated = lambda of: [] if frequencies is None else [of.alias("max_zipf")]
    pairs = found.filter("next_name IS NOT NULL").select(
        *common, (F.col("i") + 2).alias("token_end"), F.concat_ws(" ", "w", "next_name").alias("anchor"), F.lit("name_bigram").alias("generation_rule"), F.lit("strong").alias("confidence"),
        part, "left_context", F.slice("after", 2, CONTEXT).alias("right_context"), F.lit(False).alias("population_corroborated"), none, *rated(F.greatest("z0", "z1")),
    )
    # Only words that their own article does not settle are looked up in others.
    asked = F.col("kind").isNotNull() & ~F.col("own")
    known = _known_around(texts, _mentions(texts, rules).filter(asked), rules)
    sure = found.filter(~asked & (F.col("own") | F.col("in_text"))).withColumn("known", F.col("own"))
    looked = found.filter(asked).join(known, ["row", "s", "i"], "left").filter(F.col("known").isNotNull() | F.col("in_text"))
    single = sure.unionByName(looked).select(
        *common, (F.col("i") + 1).alias("token_end"), F.col("w").alias("anchor"), F.lit("corroborated_single").alias("generation_rule"), F.lit("weak").alias("confidence"),
        part, "left_context", F.slice("after", 1, CONTEXT).alias("right_context"), F.coalesce("known", F.lit(False)).alias("population_corroborated"), none, *rated(F.col("z0")),
    )
    out = pairs.unionByName(single)
    if resolved is not None:
        empty = F.array().cast("array<string>")
        out = out.unionByName(resolved.select(
            "article_id", "source", F.lit(-1).alias("token_start"), F.lit(-1).alias("token_end"), F.col("entity_id").alias("anchor"), F.lit("canonical_taxonomy").alias("generation_rule"),
            F.lit("canonical").alias("confidence"), F.when(F.col("taxonomy_kind") == "coach", "role_holder").otherwise("unknown").alias("role"), empty.alias("left_context"), empty.alias("right_context"),
            F.lit(False).alias("population_corroborated"), "entity_id", *rated(F.lit(None).cast("double")),
        ))
    return out


def word_frequencies(texts: DataFrame, rules: NameRules = HEBREW) -> DataFrame:
    """(word, zipf) of (text): log10 of how often a word occurs in a billion, to two places."""
    each = texts.select(F.explode(words(F.col("text"), rules)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    total = each.agg(F.sum("n").alias("total"))
    return each.crossJoin(F.broadcast(total)).select("word", F.round(F.log10(F.col("n") / F.col("total")) + 9, 2).alias("zipf"))


def validated(found: DataFrame, frequencies: DataFrame | None, rules: NameRules = HEBREW, ordinary: float = ORDINARY, name: float = NAME) -> DataFrame:
    """The candidates with decision (accepted, rejected, abstained), reason_code and max_zipf.

    A span is as ordinary as the most common form of its most common word; a form that ``frequencies`` (word, zipf) does
    not have is at 0; what ``candidates`` has rated already is taken as it is.  Named entities of the catalogue are
    accepted as they are; without frequencies, or without a word of the script, nothing is claimed."""
    named, z = F.col("entity_id").isNotNull(), F.col("max_zipf")
    reason = F.when(named, "canonical_taxonomy").when(z.isNull(), "no_tokens").when(z >= ordinary, "ordinary_word").when(z <= name, "rare_in_language").otherwise("uncertain_band")
    if frequencies is None:
        judged = found.withColumn("max_zipf", F.lit(None).cast("double")).withColumn("reason_code", F.when(named, "canonical_taxonomy").otherwise("resource_unavailable"))
    elif "max_zipf" in found.columns:
        judged = found.withColumn("reason_code", reason)
    else:
        spans = found.filter(~named).select("anchor").distinct()
        own = F.filter(F.split("anchor", " "), lambda w: w.rlike(f"^(?:{rules.word})$"))
        each = spans.select("anchor", F.explode(own).alias("w")).select("anchor", F.explode(forms(F.col("w"), rules)).alias("word"))
        rated = each.join(frequencies, "word", "left").groupBy("anchor").agg(F.max(F.coalesce("zipf", F.lit(0.0))).alias("max_zipf"))
        judged = found.join(rated, "anchor", "left").withColumn("reason_code", reason)
    decision = F.when(F.col("reason_code").isin("canonical_taxonomy", "rare_in_language"), "accepted").when(F.col("reason_code") == "ordinary_word", "rejected").otherwise("abstained")
    return judged.withColumn("decision", decision)


def story_anchors(judged: DataFrame) -> DataFrame:
    """article_id, anchor, role, source and reason_code of what is kept with an article: accepted names that are not its
    role-holders or opponents, each once, as first found (title first, then named entities, pairs, single words)."""
    rank = F.when(F.col("generation_rule") == "canonical_taxonomy", 0).when(F.col("generation_rule") == "name_bigram", 1).otherwise(2)
    first = F.struct((F.col("source") != "title").alias("late"), rank.alias("rank"), "token_start")
    kept = judged.filter((F.col("decision") == "accepted") & ~F.col("role").isin("role_holder", "opponent"))
    return kept.groupBy("article_id", "anchor").agg(*[F.min_by(c, first).alias(c) for c in ("role", "source", "reason_code")])


def refreshed(articles: DataFrame, stored: DataFrame, version: str, force: bool = False) -> DataFrame:
    """The articles whose anchors must be found anew: those whose ``stored`` (article_id, validator_version) version is
    another or missing, or all if forced."""
    if force:
        return articles
    return articles.join(stored.filter(F.col("validator_version") == version).select("article_id"), "article_id", "left_anti")


def anchor_keys(anchors: DataFrame, rules: NameRules = HEBREW) -> DataFrame:
    """(article_id, key, in_title): all that the anchors of an article match on, and whether its title has one of them.

    A named entity matches as it is; a name by itself, the forms of its words and the skeleton of the whole."""
    plain = F.col("anchor")
    parts = F.flatten(F.transform(F.split(plain, " "), lambda w: forms(w, rules)))
    keys = F.when(plain.rlike("^(player|coach|team|comp):"), F.array(plain)).otherwise(F.array_append(F.concat(F.array(plain), parts), _skeleton_key(plain)))
    each = anchors.select("article_id", F.explode(F.array_distinct(keys)).alias("key"), (F.col("source") == "title").alias("in_title"))
    return each.groupBy("article_id", "key").agg(F.max("in_title").alias("in_title"))


def subject_pairs(keys: DataFrame, articles: DataFrame) -> DataFrame:
    """(a_id, b_id, n_keys): pairs of articles of two sources that the gates let pass, of a state that is about a person,
    that share a key which the title of one of them has.

    Keys are joined within a kind of event and a time slot as long as its band."""
    own = gated(articles).filter(F.col("kind").isin(*PERSON_STATES) & ~F.col("live")).select("article_id", F.col("source").alias("newsroom"), "kind", "proven", "at", "band")
    each = keys.join(own, "article_id").withColumn("slot", F.floor(F.col("at") / F.col("band")))
    a, b = each.alias("a"), each.withColumn("slot", F.explode(F.array(F.col("slot") - 1, F.col("slot"), F.col("slot") + 1))).alias("b")
    met = a.join(b, F.expr("a.key = b.key AND a.kind = b.kind AND a.slot = b.slot AND a.article_id < b.article_id"))
    met = met.filter("a.newsroom <> b.newsroom AND abs(a.at - b.at) <= a.band AND (a.in_title OR b.in_title) AND (a.proven = b.proven OR a.proven = '' OR b.proven = '')")
    return met.groupBy(F.col("a.article_id").alias("a_id"), F.col("b.article_id").alias("b_id")).agg(F.count(F.lit(1)).alias("n_keys"))
