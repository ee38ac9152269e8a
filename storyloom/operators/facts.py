"""What a text is about: ordered word rules, staged title and subtitle, competitions named, and weighted evidence for a sport."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import first_match

# Weights of evidence; evidence from the article itself or its source is explicit.
WEIGHTS = {"source_url_hint": 100, "basketball_only_source": 100, "title_keyword": 80, "subtitle_keyword": 60, "competition_keyword": 55, "entity_derived": 40, "llm": 20}
EXPLICIT = ("source_url_hint", "basketball_only_source", "title_keyword", "subtitle_keyword", "competition_keyword")
#: Hebrew letters, and those that may be prefixed to a word.
LETTER, PREFIX = "א-ת", "ובהלמשכ"
# Certainty from weak to confirmed.
CERTAINTY = ("weak", "probable", "confirmed")


def whole_word(word: str, prefixed: bool = True) -> str:
    """A pattern for a Hebrew word: no letter follows it, and none stands before it but up to three prefix letters."""
    return f"(^|[^{LETTER}]){f'[{PREFIX}]{{0,3}}' if prefixed else ''}{word}($|[^{LETTER}])"


@dataclass(frozen=True)
class WordRule:
    """``name`` for texts that one of ``patterns`` matches and none of ``unless`` does."""

    name: str
    patterns: tuple[str, ...]
    unless: tuple[str, ...] = ()

    def holds(self, text: Column) -> Column:
        hit = text.rlike("|".join(f"(?:{p})" for p in self.patterns))
        return hit & ~text.rlike("|".join(f"(?:{p})" for p in self.unless)) if self.unless else hit


def by_rules(text: Column, rules: tuple[WordRule, ...], default: str | None = None) -> Column:
    """The name of the first rule that holds for the lower-cased text; a null text is empty."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return first_match([(r.holds(low), r.name) for r in rules], default)


def proposals(text: Column, rules: tuple[WordRule, ...]) -> Column:
    """Names of all rules that hold, in the rules' order."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_compact(F.array(*[F.when(r.holds(low), F.lit(r.name)) for r in rules]))


def classified(df: DataFrame, sports: tuple[WordRule, ...], leagues: dict[str, tuple[WordRule, ...]], events: tuple[WordRule, ...], valid: dict[str, tuple[str, ...]]) -> DataFrame:
    """Adds sport, league, event_type, certainty and from_subtitle: the title decides, the subtitle only fills gaps.

    Leagues are looked for among those of the sport.  Of the events proposed, in order, the first that is valid for the
    sport (``valid``: event to sports; unlisted events go with any) counts; from the subtitle it is probable at most, and
    without one the event is news."""
    sport_t, sport_s = by_rules(F.col("title"), sports), by_rules(F.col("subtitle"), sports)
    out = df.withColumn("sport", F.coalesce(sport_t, sport_s, F.lit("unknown")))
    league = lambda c: F.coalesce(F.lit(None).cast("string"), *[F.when(F.col("sport") == s, by_rules(F.col(c), r)) for s, r in leagues.items()])
    out = out.withColumn("league", F.coalesce(league("title"), league("subtitle")))

    def event(c: str) -> Column:
        fits = lambda e: first_match([((e == k) & ~F.col("sport").isin(*v), "no") for k, v in valid.items()]).isNull()
        return F.get(F.filter(proposals(F.col(c), events), fits), F.lit(0))

    out = out.withColumn("title_event", event("title")).withColumn("subtitle_event", event("subtitle"))
    certainty = F.when(F.col("title_event").isNotNull(), "confirmed").when(F.col("subtitle_event").isNotNull(), "probable").otherwise("weak")
    filled = F.col("title_event").isNull() & F.col("subtitle_event").isNotNull()
    return out.withColumn("event_type", F.coalesce("title_event", "subtitle_event", F.lit("news"))).withColumn("certainty", certainty).withColumn("from_subtitle", filled).drop("title_event", "subtitle_event")


def with_league_sport(df: DataFrame, sport_of: dict[str, str]) -> DataFrame:
    """A league that belongs to one sport decides the sport; leagues that are not listed leave it."""
    return df.withColumn("sport", F.coalesce(first_match([(F.col("league") == k, v) for k, v in sport_of.items()]), F.col("sport")))


def validated_event(df: DataFrame, title_local: tuple[str, ...]) -> DataFrame:
    """Events that only a title can tell (``title_local``) turn to news if they came from the subtitle, and other events
    from there are probable at most; importance may only fall, to ``low`` for what turned to news."""
    demoted = F.col("from_subtitle") & F.col("event_type").isin(*title_local)
    capped = F.col("from_subtitle") & (F.col("certainty") == "confirmed")
    return (
        df.withColumn("demoted", demoted)
        .withColumn("certainty", F.when(F.col("demoted"), "weak").when(capped, "probable").otherwise(F.col("certainty")))
        .withColumn("event_type", F.when(F.col("demoted"), "news").otherwise(F.col("event_type")))
        .withColumn("importance", F.when(F.col("demoted"), "low").otherwise(F.col("importance")))
    )


def competitions_named(text: Column, names: dict[str, tuple[str, ...]]) -> Column:
    """Ids of the competitions that a lower-cased text names, by where each is first claimed: longer names claim their
    places before shorter ones, and what is claimed is not claimed again.  One pass over the names, which are few."""
    pairs = sorted(((i, n) for i, ns in names.items() for n in ns), key=lambda p: (-len(p[1]), p[1]))
    each = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(n).alias("name"), F.lit("\x01" * len(n)).alias("mask")) for i, n in pairs])
    start = F.struct(F.lower(F.coalesce(text, F.lit(""))).alias("left"), F.array().cast("array<struct<at:int,id:string>>").alias("hits"))

    def claim(state: Column, name: Column) -> Column:
        at = F.call_function("instr", state["left"], name["name"])
        new = (at > 0) & ~F.exists(state["hits"], lambda h: h["id"] == name["id"])
        hits = F.when(new, F.concat(state["hits"], F.array(F.struct(at.cast("int").alias("at"), name["id"].alias("id"))))).otherwise(state["hits"])
        return F.struct(F.replace(state["left"], name["name"], name["mask"]).alias("left"), hits.alias("hits"))

    return F.transform(F.array_sort(F.aggregate(each, start, claim)["hits"]), lambda h: h["id"])


def evidence(hint: Column, sure: Column, title: Column, subtitle: Column, competitions: Column, entities: Column, proposed: Column) -> Column:
    """Array of (weight, source, sport), strongest first.  ``hint`` and ``proposed`` are a sport or null, ``sure`` whether
    the source has basketball only, the others arrays of sports; entities count if they agree on one sport."""
    none = F.array().cast("array<string>")
    one = lambda c: F.when(c.isNotNull() & (c != "unknown"), F.array(c)).otherwise(none)
    agreed = F.array_distinct(F.array_compact(entities))
    parts = {
        "source_url_hint": one(hint), "basketball_only_source": F.when(sure, F.array(F.lit("basketball"))).otherwise(none), "title_keyword": title,
        "subtitle_keyword": subtitle, "competition_keyword": competitions, "entity_derived": F.when(F.size(agreed) == 1, agreed).otherwise(none), "llm": one(proposed),
    }

    def weighed(kind: str, sports: Column) -> Column:
        return F.transform(F.coalesce(sports, none), lambda s: F.struct(F.lit(WEIGHTS[kind]).alias("weight"), F.lit(kind).alias("source"), s.alias("sport")))

    return F.concat(*[weighed(k, v) for k, v in parts.items()])


def resolved_sport(found: Column, current: Column) -> Column:
    """(sport, rule) by the strongest explicit evidence; the rule says what decided and is null where nothing conflicts.

    Without explicit evidence the sport stays.  Equal explicit weights for several sports keep it if it is one of them,
    else nothing is claimed.  Evidence is ordered by weight, equal weights by place."""
    explicit = F.filter(found, lambda e: e["source"].isin(*EXPLICIT))
    top = F.array_max(F.transform(explicit, lambda e: e["weight"]))
    tops = F.array_distinct(F.transform(F.filter(explicit, lambda e: e["weight"] == top), lambda e: e["sport"]))
    several = F.size(F.array_distinct(F.transform(found, lambda e: e["sport"]))) > 1
    # Parts stand by falling weight already, so the first for a sport is its strongest.
    first = lambda a: F.get(F.filter(a, lambda e: e["sport"] == current), F.lit(0))["source"]
    outweighs = lambda a: F.concat(first(a), F.lit("_outweighs"))
    said = lambda sport, rule: F.struct(sport.alias("sport"), rule.cast("string").alias("rule"))
    nothing, unknown = F.lit(None), F.lit("unknown")
    return (
        F.when(F.size(explicit) == 0, said(current, F.when(several & (current != "unknown"), F.coalesce(outweighs(found), F.lit("weighted_evidence")))))
        .when((F.size(tops) > 1) & F.array_contains(tops, current), said(current, F.lit("equal_weight_tie_kept")))
        .when(F.size(tops) > 1, said(unknown, F.lit("equal_weight_tie_abstain")))
        .when(F.get(tops, F.lit(0)) != current, said(F.get(tops, F.lit(0)), F.lit("weighted_evidence_override")))
        .when(several, said(current, outweighs(explicit)))
        .otherwise(said(current, nothing))
    )


def agreed_league(entities: DataFrame, memberships: DataFrame) -> DataFrame:
    """article_id and league if all entities with any membership are members of just that one.

    ``entities``: article_id, entity; ``memberships``: entity, league."""
    met = entities.select("article_id", "entity").distinct().join(memberships.select("entity", "league").distinct(), "entity")
    return met.groupBy("article_id").agg(F.min("league").alias("league"), F.count_distinct("league").alias("n")).filter("n = 1").select("article_id", "league")


def hinted_sport(source: Column, url: Column, hints: dict[str, dict[str, str]]) -> Column:
    """The sport that a source's own URLs say: source to (part of the URL to sport), parts in order."""
    return first_match([((source == s) & url.contains(part), sport) for s, parts in hints.items() for part, sport in parts.items()])


def pruned(entities: Column, sport: Column, clubs: dict[str, str]) -> Column:
    """Entities without the clubs of another sport than the article's, each once, in order."""
    other = lambda e: first_match([((e == k) & (sport != v), "x") for k, v in clubs.items()]).isNotNull()
    return F.array_distinct(F.filter(entities, lambda e: ~other(e)))


# How important a report may be, from least to most, and what is assumed where nothing is said.
IMPORTANCE = ("low", "medium", "high", "very_high")
LEAST_CONFIDENCE = 0.65


def first_object(raw: Column) -> Column:
    """The first balanced JSON object of a text, with keys such as "reason:" mended; null if there is none."""
    mended = F.regexp_replace(F.coalesce(raw, F.lit("")), r'"(\w+):"\s*:', '"$1":')
    opened = F.regexp_extract(mended, r"(?s)\{.*", 0)
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("text"))

    def close(acc: Column, part: Column) -> Column:
        depth = acc["depth"] + F.length(part) - F.length(F.replace(part, F.lit("{"), F.lit(""))) - 1
        done = (acc["depth"] == 0) & (acc["text"] != "")
        return F.when(done, acc).otherwise(F.struct(depth.alias("depth"), F.concat(acc["text"], part, F.lit("}")).alias("text")))

    pieces = F.split(opened, r"\}")
    found = F.aggregate(F.slice(pieces, F.lit(1), F.size(pieces) - 1), start, close)
    return F.when((found["depth"] == 0) & (found["text"] != ""), found["text"])


def parsed_proposal(raw: Column, sports: tuple[str, ...], events: tuple[str, ...], most_entities: int = 10, longest_reason: int = 500, leagues: tuple[str, ...] = ()) -> Column:
    """A model's answer as (sport, league, event_type, importance, confidence, entities, reason).

    The first balanced object of the text is read; null if there is none or it is no JSON.  What is not among the known
    values becomes unknown, no league, news and medium; a confidence that is missing, no number or outside 0 to 1 counts
    as none at all (0); lists and reasons are cut to their limits."""
    names = ("sport", "league", "event_type", "importance", "confidence", "entities", "reason")
    text = first_object(raw)
    got = F.from_json(text, ", ".join(f"{n} string" for n in names) + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    known = lambda name, values, other: F.when(got[name].isin(*values), got[name]).otherwise(F.lit(other)) if values else F.lit(other).cast("string")
    sure = got["confidence"].try_cast("double")
    return F.when(
        text.isNotNull() & got["_corrupt"].isNull(),
        F.struct(
            known("sport", sports, "unknown").alias("sport"),
            known("league", leagues, None).alias("league"),
            known("event_type", events, "news").alias("event_type"),
            known("importance", IMPORTANCE, "medium").alias("importance"),
            F.when((sure >= 0) & (sure <= 1), sure).otherwise(0.0).alias("confidence"),
            F.slice(F.filter(F.coalesce(F.from_json(got["entities"], "array<string>"), F.array().cast("array<string>")), lambda e: e.isNotNull()), 1, most_entities).alias("entities"),
            F.substring(F.coalesce(got["reason"], F.lit("")), 1, longest_reason).alias("reason"),
        ),
    )


def guarded(df: DataFrame, leagues: dict[str, str], least: float = LEAST_CONFIDENCE) -> DataFrame:
    """Adds final_sport, final_league, final_event, final_certainty, final_importance, classified_by and guards (the
    guardrails that fired, in order): a model's answer stands, and what the text proves corrects it, one guardrail after
    the other.

    unsupported: a sport that is not modelled is unknown.  football_club: a club that only plays football.  committed:
    words of one sport only.  rules_sport, rules_league, rules_event: what the rules found where the model found nothing.
    evidence: an event that the text does not bear falls back to the rules' event, or to news.  importance: never below
    the rules'.  league_sport: a league has its sport.  hint: what the source's address says, unless the text commits to
    another sport.  No answer, or one below ``least``, leaves the rules' facts.

    ``df``: said (struct of parsed_proposal) or null; sport, league, event_type, certainty and importance of the rules;
    unsupported and football_club (booleans), committed and hint (sports or null), and borne (array of (event, certainty):
    the events that the text bears)."""
    c, said = F.col, F.col("said")
    rank = lambda of: F.coalesce(F.array_position(F.array(*[F.lit(i) for i in IMPORTANCE]), of), F.lit(0))
    certain = lambda event: F.get(F.transform(F.filter("borne", lambda x: x["event"] == event), lambda x: x["certainty"]), F.lit(0))
    used = said.isNotNull() & (said["confidence"] >= least)
    out = df.withColumns({"_s": said["sport"], "_l": said["league"], "_e": said["event_type"], "_i": said["importance"], "_g": F.array().cast("array<string>")})

    def guard(name: str, fires: Column, **to: Column) -> None:
        nonlocal out
        out = out.withColumn("_f", F.coalesce(fires, F.lit(False)))
        changed = {k: F.when(c("_f"), v).otherwise(c(k)) for k, v in to.items()}
        out = out.withColumns({**changed, "_g": F.when(c("_f"), F.array_append("_g", F.lit(name))).otherwise(c("_g"))})

    none = F.lit(None).cast("string")
    out = out.withColumn("_l", F.when(c("unsupported"), none).otherwise(c("_l")))
    guard("unsupported", c("unsupported") & (c("_s") != "unknown"), _s=F.lit("unknown"))
    guard("football_club", ~c("unsupported") & c("football_club") & (c("_s") != "football"), _s=F.lit("football"), _l=c("league"))
    guard("committed", (c("_s") != "unknown") & (c("committed") != c("_s")), _s=c("committed"), _l=F.when(c("sport") == c("committed"), c("league")))
    guard("rules_sport", (c("_s") == "unknown") & (c("sport") != "unknown") & ~c("unsupported"), _s=c("sport"))
    guard("rules_league", c("_l").isNull() & c("league").isNotNull(), _l=c("league"))
    guard("rules_event", (c("event_type") != "news") & (c("_e") == "news"), _e=c("event_type"))
    fallback = F.when((c("event_type") != c("_e")) & certain(c("event_type")).isNotNull(), c("event_type")).otherwise("news")
    borne = F.coalesce(certain(c("_e")), F.when(c("_e") == "news", "confirmed"))
    guard("evidence", borne.isNull(), _e=fallback)
    agreed = (c("_e") == c("event_type")) | (c("_e") == "news")
    out = out.withColumn("_c", F.when(F.array_contains("_g", "evidence"), F.coalesce(certain(c("_e")), F.lit("confirmed"))).when(agreed, "confirmed").otherwise(certain(c("_e"))))
    guard("importance", rank(c("_i")) < rank(c("importance")), _i=c("importance"))
    of_league = first_match([(c("_l") == k, v) for k, v in leagues.items()])
    guard("league_sport", of_league != c("_s"), _s=of_league)
    guard("hint", (c("hint") != c("_s")) & ~c("unsupported") & (c("committed").isNull() | (c("committed") == c("hint"))), _s=c("hint"))
    final = {"sport": "_s", "league": "_l", "event": "_e", "certainty": "_c", "importance": "_i"}
    own = {"sport": "sport", "league": "league", "event": "event_type", "certainty": "certainty", "importance": "importance"}
    out = out.withColumns({f"final_{k}": F.when(F.coalesce(used, F.lit(False)), c(v)).otherwise(c(own[k])) for k, v in final.items()})
    by = F.when(~F.coalesce(used, F.lit(False)), "rules").when(F.size("_g") > 0, "model_guarded").otherwise("model")
    guards = F.when(F.coalesce(used, F.lit(False)), c("_g")).otherwise(F.array().cast("array<string>"))
    return out.withColumns({"classified_by": by, "guards": guards}).drop("_s", "_l", "_e", "_i", "_g", "_f", "_c")


def merged(df: DataFrame, least: float = 0.65) -> DataFrame:
    """Adds final_sport, final_event, final_importance and merge_rule from the rules' and a model's answer, in order: an
    answer below ``least`` or none keeps the rules'; a sport the rules proved stands against the model's; an event the
    rules confirmed stands; else the model fills what the rules left open.  Importance never falls by the model's word.

    ``df``: sport, proven (boolean), event_type, certainty, importance, said (struct as above with importance) or null."""
    said = F.col("said")
    rank = lambda c: first_match([(c == v, str(i)) for i, v in enumerate(("very_low", "low", "medium", "high", "very_high"))], "0").cast("int")
    rule = first_match(
        [
            (said.isNull() | F.coalesce(said["confidence"] < least, F.lit(True)), "rules_only"),
            (F.col("proven") & (said["sport"] != F.col("sport")) & (said["sport"] != "unknown"), "rules_sport_stands"),
            ((F.col("certainty") == "confirmed") & (said["event_type"] != F.col("event_type")), "rules_event_stands"),
            ((F.col("sport") == "unknown") & (said["sport"] != "unknown"), "model_fills_sport"),
            ((F.col("event_type") == "news") & (said["event_type"] != "news"), "model_fills_event"),
        ],
        "agreed",
    )
    fills = F.col("merge_rule").isin("model_fills_sport", "model_fills_event")
    out = df.withColumn("merge_rule", rule)
    out = out.withColumn("final_sport", F.when(fills & (F.col("sport") == "unknown"), said["sport"]).otherwise(F.col("sport")))
    out = out.withColumn("final_event", F.when(fills & (F.col("event_type") == "news"), said["event_type"]).otherwise(F.col("event_type")))
    raised = (F.col("merge_rule") != "rules_only") & (rank(said["importance"]) > rank(F.col("importance")))
    return out.withColumn("final_importance", F.when(raised, said["importance"]).otherwise(F.col("importance")))
