"""License scans by ordered signature rules, in DataFrame functions only.

A text is normalised to its words (letters and digits) with single spaces; several hundred regular expressions, built
from the tables below, are tried on the texts that hold a keyword of their group.  Every place where a rule matches is a
detection (start, end, label, priority).  A detection inside a longer one, or inside an equally long one of higher
priority, is suppressed; the labels of what remains are the method's.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table

#: What stands between words once A-Z are lower-cased, and before that.
OTHER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OTHER_RAW = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: The phrases of the base scan and their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

# Names of licenses as they are written once punctuation is gone, with the versions they come in.
# Family: (label, keyword that a text must hold, names, versions).
FAMILIES = (
    ("gpl", "gnu", ("gnu general public license", "gnu gpl"), ("1", "2", "3")),
    ("gpl", "gpl", ("gpl", "gplv"), ("1", "2", "3")),
    ("lgpl", "gnu", ("gnu lesser general public license", "gnu library general public license", "gnu lgpl"), ("2", "2 1", "3")),
    ("lgpl", "lgpl", ("lgpl", "lgplv"), ("2", "2 1", "3")),
    ("agpl", "affero", ("gnu affero general public license", "affero general public license"), ("1", "3")),
    ("agpl", "agpl", ("agpl", "agplv"), ("1", "3")),
    ("gfdl", "free documentation", ("gnu free documentation license",), ("1 1", "1 2", "1 3")),
    ("apache", "apache", ("apache license", "apache software license", "asl"), ("1 0", "1 1", "2 0", "2")),
    ("mpl", "mozilla", ("mozilla public license", "mpl"), ("1 0", "1 1", "2 0")),
    ("epl", "eclipse", ("eclipse public license", "epl"), ("1 0", "2 0")),
    ("cddl", "common development", ("common development and distribution license", "cddl"), ("1 0", "1 1")),
    ("cpl", "common public", ("common public license", "cpl"), ("0 5", "1 0")),
    ("eupl", "european union", ("european union public license", "european union public licence", "eupl"), ("1 0", "1 1", "1 2")),
    ("osl", "open software", ("open software license", "osl"), ("1 0", "1 1", "2 0", "2 1", "3 0")),
    ("afl", "academic free", ("academic free license", "afl"), ("1 1", "1 2", "2 0", "2 1", "3 0")),
    ("artistic", "artistic", ("artistic license", "perl artistic license"), ("1 0", "2 0")),
    ("bsl", "boost", ("boost software license", "bsl"), ("1 0",)),
    ("zpl", "zope", ("zope public license", "zpl"), ("1 1", "2 0", "2 1")),
    ("python", "python", ("python software foundation license", "psf license", "python license"), ("2", "3")),
    ("php", "php license", ("php license",), ("3 0", "3 01")),
    ("lppl", "latex", ("latex project public license", "lppl"), ("1 0", "1 1", "1 2", "1 3a", "1 3c")),
    ("ofl", "open font", ("sil open font license", "open font license", "ofl"), ("1 0", "1 1")),
    ("ms-pl", "microsoft", ("microsoft public license", "ms pl"), ("1",)),
    ("ms-rl", "microsoft", ("microsoft reciprocal license", "ms rl"), ("1",)),
    ("odbl", "database", ("open database license", "odbl"), ("1 0",)),
    ("bsd", "bsd", ("bsd license", "bsd style license", "berkeley software distribution license"), ("2", "3", "4")),
    ("cecill", "cecill", ("cecill free software license agreement", "cecill"), ("1 0", "1 1", "2 0", "2 1")),
    ("qpl", "q public", ("q public license", "qpl"), ("1 0",)),
    ("upl", "universal permissive", ("universal permissive license", "upl"), ("1 0",)),
    ("sspl", "server side", ("server side public license", "sspl"), ("1",)),
    ("busl", "business source", ("business source license", "busl"), ("1 0", "1 1")),
    ("mulan", "mulan", ("mulan psl", "mulan permissive software license"), ("1", "2")),
)
#: (label, keyword, expression): licenses that carry no version, and telling sentences of others.
SINGLE = (
    ("mit", "mit license", "mit license"),
    ("mit", "licensed under", "licensed under (?:the )?mit"),
    ("mit", "expat", "expat license"),
    ("mit", "permission is hereby", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "as is without warranty", "the software is provided as is without warranty of any kind"),
    ("mit", "x11", "x11 license"),
    ("mit-0", "mit no attribution", "mit no attribution(?: license)?"),
    ("isc", "isc", "isc license"),
    ("isc", "permission to use", "permission to use copy modify and or distribute this software for any purpose"),
    ("zlib", "zlib", "zlib(?: libpng)? license"),
    ("zlib", "express or implied warranty", "this software is provided as is without any express or implied warranty"),
    ("unlicense", "unlicense", "(?:the )?unlicense"),
    ("unlicense", "unencumbered", "free and unencumbered software released into the public domain"),
    ("wtfpl", "wtfpl", "wtfpl"),
    ("public-domain", "public domain", "(?:released|dedicated|placed) (?:in|into|to) the public domain"),
    ("cc0", "cc0", "cc0(?: 1 0)?(?: universal)?"),
    ("bsd", "bsd", "bsd [234] clause(?: license)?"),
    ("bsd", "bsd", "(?:new|modified|simplified|revised) bsd license"),
    ("bsd", "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "neither the name", "neither the name of .{1,80}? may be used to endorse or promote products"),
    ("0bsd", "0bsd", "0bsd"),
    ("gpl", "free software foundation", "as published by the free software foundation"),
    ("proprietary", "all rights reserved", "all rights reserved"),
    ("proprietary", "proprietary", "proprietary and confidential"),
    ("proprietary", "unauthorized", "unauthorized (?:copying|distribution|reproduction) (?:of this .{1,40}? )?is (?:strictly )?prohibited"),
    ("copyright", "copyright", "copyright (?:c )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})*"),
    ("spdx", "spdx", "spdx license identifier [a-z0-9]+(?: [0-9]+)*"),
)
#: Creative Commons: terms, versions and the long names of the terms.
CC_TERMS = (("by", "attribution"), ("by sa", "attribution sharealike"), ("by nc", "attribution noncommercial"), ("by nd", "attribution noderivatives"), ("by nc sa", "attribution noncommercial sharealike"), ("by nc nd", "attribution noncommercial noderivatives"))
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
#: How a version follows a name, and how a sentence grants a license.
VERSIONED, LATER, GRANT = "{n}(?: version| v)? ?{v}", "(?: or (?:any )?later(?: version)?)?", "(?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?{n}"


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    pattern: str
    priority: int


def rules() -> list[Rule]:
    """All rules in order; where two detections are equally long, the one with the higher priority stays."""
    out: list[Rule] = []

    def add(label: str, keyword: str, pattern: str, priority: int) -> None:
        out.append(Rule(label, keyword, pattern, priority))

    for label, keyword, names, versions in FAMILIES:
        family = keyword
        for n in names:
            # A name without the family's keyword is its own.
            keyword = family if family in n else n
            for v in versions:
                add(f"{label}-{v.replace(' ', '.')}", keyword, VERSIONED.format(n=n, v=v) + LATER, 30)
            if " " in n:
                add(label, keyword, n, 20)
                add(label, keyword, GRANT.format(n=n), 25)
    for short, long in CC_TERMS:
        label = "cc-" + short.replace(" ", "-")
        for name, keyword in ((f"cc {short}", "cc by"), (f"creative commons {long}", "creative commons")):
            add(label, keyword, name, 20)
            add(label, keyword, f"{name} license", 21)
            for v in CC_VERSIONS:
                add(f"{label}-{v.replace(' ', '.')}", keyword, f"{name} {v}(?: (?:international|unported|generic))?(?: license)?", 30)
    for label, keyword, pattern in SINGLE:
        add(label, keyword, pattern, 15)
    return out


def normalised(text: Column) -> Column:
    """Lower-cased words with one space between, before and after them."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(ascii_lower(text), OTHER, " ")), F.lit(" "))


#: Values that a running sum or maximum takes at once: its work on n values is of n * BLOCK, not of n * n.
BLOCK = 512


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once; in a lambda's body an expression is else worked out at every mention."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """The running sum or maximum (``op``) of an array of positive ints, in blocks whose results are then carried on."""
    none = F.array().cast("array<int>")

    def along(part: Column) -> Column:
        start = F.struct(F.lit(0).alias("last"), none.alias("all"))
        step = lambda acc, x: _let(op(acc["last"], x), lambda y: F.struct(y.alias("last"), F.array_append(acc["all"], y).alias("all")))
        return F.aggregate(part, start, step)["all"]

    def carried(blocks: Column) -> Column:
        # What comes before a block: nothing, and then the last values of those before.
        before = F.concat(F.array(F.lit(0)), along(F.transform(blocks, lambda b: F.element_at(b, -1))))
        return F.flatten(F.zip_with(blocks, F.slice(before, F.lit(1), F.size(blocks)), lambda b, o: F.transform(b, lambda x: op(o, x))))

    split = lambda v: F.transform(F.sequence(F.lit(1), F.size(v), F.lit(BLOCK)), lambda s: along(F.slice(v, s, F.lit(BLOCK))))
    return _let(values, lambda v: F.when(F.size(v) == 0, none).otherwise(_let(split(v), carried)))


def _places(norm: Column, pattern: Column | str) -> Column:
    """(at, until) of the matches of a pattern of words, as places (1-based) of the spaces before and after each.

    The space after a match may be the one before the next.  The expression takes what lies before a match along, from the end of
    the last one and nowhere else, so that it reads a text once and places are running sums of lengths."""
    word = pattern if isinstance(pattern, Column) else F.lit(pattern)
    whole = F.concat(F.lit(r"\G.*?( "), word, F.lit("(?= ))"))
    sizes = lambda group: F.transform(F.regexp_extract_all(norm, whole, F.lit(group)), lambda m: F.length(m))
    found = F.zip_with(running(sizes(0), lambda x, y: x + y), sizes(1), lambda end, n: F.struct((end - n + 1).alias("at"), (end + 1).alias("until")))
    return F.when(F.rlike(norm, F.concat(F.lit(" "), word, F.lit("(?= )"))), found).otherwise(F.array().cast("array<struct<at:int,until:int>>"))


DETECTION = "array<struct<at:int,until:int,label:string,priority:int>>"


def detect(norm: Column, ordered: list[Rule]) -> Column:
    """All detections in a normalised text; a rule is tried only where a word begins with its keyword."""
    groups: dict[str, list[str]] = {}
    for r in ordered:  # no pattern holds a quote or a backslash
        groups.setdefault(r.keyword, []).append(f"named_struct('pattern', '{r.pattern}', 'label', '{r.label}', 'priority', {r.priority})")
    table = F.expr("array(" + ", ".join(f"named_struct('keyword', ' {k}', 'rules', array({', '.join(rs)}))" for k, rs in groups.items()) + ")")

    def of(rule: Column) -> Column:
        return F.transform(_places(norm, rule["pattern"]), lambda p: F.struct(p["at"].alias("at"), p["until"].alias("until"), rule["label"].alias("label"), rule["priority"].alias("priority")))

    tried = F.flatten(F.transform(F.filter(table, lambda g: norm.contains(g["keyword"])), lambda g: g["rules"]))
    return F.when(norm == "", F.array().cast(DETECTION)).otherwise(F.flatten(F.transform(tried, of)).cast(DETECTION))


def unsuppressed(found: Column) -> Column:
    """The detections that no other contains: longer ones win, of equal ones the higher priority, then the first label.

    In order of start, the longer and better first, a detection is inside an earlier one if that ends no sooner; so one
    running maximum of ends tells.  Of equal detections the first stays."""
    keyed = F.transform(found, lambda d: F.struct(d["at"].alias("at"), (-d["until"]).alias("less"), (-d["priority"]).alias("lower"), d["label"].alias("label")))

    def apart(ordered: Column) -> Column:
        ends = running(F.transform(ordered, lambda d: -d["less"]), lambda x, y: F.greatest(x, y))
        before = F.slice(F.concat(F.array(F.lit(0)), ends), F.lit(1), F.size(ordered))
        return F.filter(F.zip_with(ordered, before, lambda d, e: F.struct(d.alias("d"), (e < -d["less"]).alias("stays"))), lambda x: x["stays"])

    own = _let(F.array_sort(keyed), apart)
    return F.transform(own, lambda x: F.struct(x["d"]["at"].alias("at"), (-x["d"]["less"]).alias("until"), x["d"]["label"].alias("label"), (-x["d"]["lower"]).alias("priority")))


def _words_before(norm: Column, at: Column) -> Column:
    """Number of the word that follows the space at ``at``."""
    return F.length(F.regexp_replace(F.substring(norm, F.lit(1), at), "[^ ]+", "")) - 1


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of (doc_id, text).

    Null and empty texts have no words and no labels.  ``score`` is 1 - 0.5 ** evidence, where a detection that states a
    version or a grant counts 2 and any other, or a base phrase, 1.  Repeated rows give repeated results."""
    ordered = rules()
    # Keywords in the raw text: anything but letters and digits may stand between their words.
    gate = sorted({r.keyword for r in ordered} | {p for p, _ in BASE})
    likely = F.col("text").rlike("(?i)(?<![a-z0-9])(?:" + "|".join(k.replace(" ", OTHER_RAW) for k in gate) + ")")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n_words = F.size(F.array_remove(F.split("text", OTHER_RAW), ""))
    normal = texts.select("doc_id", n_words.cast("long").alias("n_words"), F.when(likely, normalised(F.col("text"))).otherwise(F.lit("")).alias("norm"))
    norm = F.col("norm")

    def places(phrase: str, label: str) -> Column:
        return F.transform(_places(norm, phrase), lambda p: F.struct(p["at"].alias("at"), F.lit(label).alias("label")))

    base = F.flatten(F.array(*[places(p, b) for p, b in BASE]))
    found = normal.withColumn("base", base).withColumn("detections", detect(norm, ordered))
    found = found.withColumn("kept", unsuppressed(F.col("detections")))
    at = F.transform("base", lambda b: b["at"])
    base_labels = F.array_sort(F.array_distinct(F.transform("base", lambda b: b["label"])))
    labels = F.array_sort(F.array_union(base_labels, F.transform("kept", lambda d: d["label"])))
    evidence = F.aggregate("kept", F.size("base"), lambda acc, d: acc + F.when(d["priority"] >= 25, 2).otherwise(1))
    some = F.size("base") > 0
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.when(some, _words_before(norm, F.array_min(at))).cast("long").alias("first_word"),
        F.when(some, _words_before(norm, F.array_max(at))).cast("long").alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        (1 - F.pow(F.lit(0.5), evidence)).alias("score"),
    )


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan every whole text of ``documents``."""
    return scan(table(spark, sf_dir, "documents"))
