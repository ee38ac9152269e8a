"""Benchmark decontamination by templates, in DataFrame functions only.

Numbers, units after numbers and names become typed placeholders, so a question with other parameters keeps its
template.  Five-word windows of templates and of raw words are hash-joined with those of the benchmark; template windows
on one alignment of a text with an item count only if the text's parameters map one to one to the item's.  A text leaks
an item if it meets at least 0.8 of the places at which the item has a window.

Items of one template whose parameters repeat alike are one class, matched once however many items it has.  A text that
leaks a class meets at least one of its probes, the fewest places that 0.8 cannot do without; so only texts that hold a
probe's rarest word are looked at closely, and only pairs of a text and a class that share a probe's window are judged.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, join_checked, table, written

WINDOW, SHARE = 5, 0.8
NUMBER, UNIT, NAME = "\x01", "\x02", "\x03"
# Units that may follow a number.
UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre "
    "kilometres mg g kg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ml l liter liters litre litres gallon "
    "gallons s sec ms second seconds min minute minutes h hr hour hours day days week weeks month months year years percent "
    "degree degrees dollar dollars cent cents euro euros usd eur mph kmh hz khz mhz ghz w kw v kv a j kj cal kcal pa kpa bar n k mol"
).split()


# Words that are no names though a sentence may start with them. Names are an open class, these are not.
PLAIN = (
    "the an this that these those each every both all some any no another other such "
    "he she it we they you his her its our their your my him them us me one who whom whose which what how why when where whether "
    "if then else so as at by for from in into of on onto to with without within over under after before during until since while about "
    "and or but nor not yet because although though there here now once only also "
    "is are was were be been am do does did has have had can could will would shall should may might must let "
    "find give given suppose assume calculate compute determine show prove explain write solve "
    "der die das den dem des ein eine einen einem einer er sie es wir ihr und oder aber wenn wie was wer wo warum im am zu mit von auf "
    "le la les un une des il elle nous vous ils elles et ou mais si comment quand que qui quel quelle dans sur avec pour par "
    "el los las una unos unas yo ella ellos ellas y o pero como cuando quien cual en con por para"
).split()
#: ASCII punctuation, and quotes, dashes and other marks, one by one so that the class is a bit set.
MARKS = r"[!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~\u00a1\u00ab\u00bb\u00bf\u2010-\u2027]"
OPEN = r"[\"'(\[{\u00ab\u201c\u201e\u2018\u201a\u00bf\u00a1]*"
SLOTS = (NUMBER, UNIT, NAME)


def _spaced(text: Column) -> Column:
    """One space for every run of white space, so that wrapping does not matter."""
    return F.regexp_replace(text, f"[{SPACE}]+", " ")


def _split(text: Column) -> Column:
    return F.split(F.regexp_replace(F.lower(text), MARKS, ""), " ")


def template(text: Column) -> Column:
    """The template's words, one for each white-space separated word of the text, so that places agree with raw words."""
    t = F.regexp_replace(_spaced(text), r"(?<!\S)(?=\S*[0-9])\S+", NUMBER)
    t = F.regexp_replace(t, rf"(?<=\x01 )(?i:{'|'.join(sorted(UNITS, key=len, reverse=True))})(?![A-Za-z])\S*", UNIT)
    # A capitalised word wherever it stands.
    t = F.regexp_replace(t, rf"(?<!\S){OPEN}(?=\p{{Lu}}\p{{Ll}})(?!(?i:{'|'.join(sorted(set(PLAIN)))})(?!\p{{L}}))\p{{Lu}}\p{{Ll}}+(?!\p{{L}})\S*", NAME)
    return _split(t)


def raw_words(text: Column) -> Column:
    """Raw words without punctuation, at the same places."""
    return _split(_spaced(text))


def _hash(kind: str, size, *words: Column) -> Column:
    """The hash of a window; an array of words and as many columns hash alike."""
    return F.xxhash64(F.lit(kind), F.lit(size).cast("int"), *words)


def _held(texts: DataFrame, *keys: str) -> DataFrame:
    """keys and word of every word of ``text``, without punctuation."""
    held = F.split(F.regexp_replace(F.lower("text"), MARKS, ""), f"[{SPACE}]+")
    return texts.select(*keys, F.explode(held).alias("word"))


def benchmark_places(benchmark: DataFrame, texts: DataFrame, size: int = WINDOW) -> DataFrame:
    """One row per item and place: item_id, class, place, s (words in the window), th and rh (hashes of the window of the
    template and of raw words), literal (the template's window has a word of its own), slots (place in the window and
    number of the parameter) and best (what a text must hold to meet the place: the window's rarest word in ``texts``).

    An item of fewer words than ``size`` has one window of them all.  Places of punctuation alone are none."""
    whole = F.trim(_spaced(F.col("text")))
    items = benchmark.filter("text IS NOT NULL AND item_id IS NOT NULL").select("item_id", template(whole).alias("t"), raw_words(whole).alias("r")).distinct()
    # Parameters are numbered by where they stand first, numbers, units and names apart.
    typed = F.zip_with("t", "r", lambda t, r: F.when(t.isin(*SLOTS), F.concat(t, r)))
    items = items.withColumn("typed", typed).withColumn("p", F.transform("typed", lambda v: F.coalesce(F.array_position("typed", v), F.lit(0))))
    items = items.withColumn("class", F.md5(F.concat_ws("\x04", F.col("t"), F.col("p").cast("array<string>")))).withColumn("s", F.least(F.lit(size), F.size("t")))
    each = items.select("item_id", "class", "t", "r", "p", "s", F.explode(F.sequence(F.lit(0), F.size("t") - F.col("s"))).alias("place"))
    cut = {c: F.slice(F.col(c), F.col("place") + 1, F.col("s")) for c in ("t", "r", "p")}
    each = each.select("item_id", "class", "place", "s", *[v.alias(c) for c, v in cut.items()]).filter(F.exists("r", lambda w: w != ""))
    own = F.filter("t", lambda w: (w != "") & ~w.isin(*SLOTS))
    numbered = F.transform("p", lambda p, k: F.struct(k.alias("k"), p.alias("a")))
    each = written(
        each.select(
            "item_id", "class", "place", "s", F.xxhash64(F.lit("t"), "s", "t").alias("th"), F.xxhash64(F.lit("r"), "s", "r").alias("rh"),
            (F.size(own) > 0).alias("literal"), F.filter(numbered, lambda x: x["a"] > 0).alias("slots"),
            F.array_distinct(F.when(F.size(own) > 0, own).otherwise(F.filter("r", lambda w: w != ""))).alias("words"),
        )
    )
    words = each.select("item_id", "class", "place", F.explode("words").alias("word"))
    vocabulary = written(words.select("word").distinct())
    spread = written(join_checked(_held(texts), vocabulary, "word", "inner").groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    ranked = join_checked(words, spread, "word").fillna(0, ["n"])
    best = ranked.groupBy("item_id", "class", "place").agg(F.min(F.struct("n", "word")).alias("best"))
    return each.drop("words").join(best, ["item_id", "class", "place"])


def _windows(texts: DataFrame, size: int) -> DataFrame:
    """who, at, r (raw words) and kind and h (hash of the template's or the raw window) of the windows of (who, t, r)."""
    n = F.size("t") - (size - 1)
    zipped = F.arrays_zip(*[F.slice(F.col(c), F.lit(k + 1), n).alias(f"{c}{k}") for c in ("t", "r") for k in range(size)])
    each = texts.filter(F.size("t") >= size).select("who", F.posexplode(zipped).alias("at", "z"))
    both = F.array(*[F.struct(F.lit(c).alias("kind"), _hash(c, size, *[F.col(f"z.{c}{k}") for k in range(size)]).alias("h")) for c in ("t", "r")])
    return each.select("who", "at", F.array(*[F.col(f"z.r{k}") for k in range(size)]).alias("r"), F.inline(both))


def leaks(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, share: float = SHARE) -> DataFrame:
    """One row per text and item that it leaks: doc_id, item_id, n_windows (places met), coverage and kind (``exact`` if
    the text has the item's own parameters at all of them, else ``reparameterised``).

    ``docs`` has doc_id and text, ``benchmark`` item_id and text; other columns are not looked at.  Null and empty texts
    match nothing.  Repeated rows give one row; rows with a null id are told apart by their text.  Equal texts are
    matched once.  A window of placeholders alone does not count for a template, or any three numbers would match."""
    texts = docs.select("doc_id", "text", F.md5(F.col("text").cast("binary")).alias("who")).filter("text IS NOT NULL")
    places = written(benchmark_places(benchmark, texts, size))
    per_class = places.select("class", "place", "s", "th", "literal", "slots", "best").dropDuplicates(["class", "place"])
    counts = written(per_class.groupBy("class").agg(F.count(F.lit(1)).alias("n_places")))
    # Probes: without so many places no text reaches the share; those whose word is rarest.
    order = Window.partitionBy("class").orderBy(F.col("best.n"), F.col("best.word"), "place")
    fewest = F.col("n_places") - F.ceil(F.col("n_places") * share - 1e-9) + 1
    probes = written(per_class.join(counts, "class").withColumn("k", F.row_number().over(order)).filter(F.col("k") <= fewest).select("class", "place"))
    chosen = places.join(probes, ["class", "place"])
    anchors = written(chosen.select(F.col("best.word").alias("word")).distinct())
    near = written(join_checked(_held(texts, "doc_id", "who"), anchors, "word", "inner").select("doc_id", "who").distinct())
    near_texts = join_checked(texts.select("who", "text"), written(near.select("who").distinct()), "who", "left_semi").dropDuplicates(["who"])
    near_texts = near_texts.select("who", template(F.col("text")).alias("t"), raw_words(F.col("text")).alias("r"))

    # What a class's windows say: template windows of the class, raw ones of the class or, with parameters, of an item.
    item = F.when(F.size("slots") > 0, F.col("item_id"))
    says = written(
        per_class.filter("literal").select("class", "place", F.lit("t").alias("kind"), F.col("th").alias("h"), "slots", F.lit(None).cast(places.schema["item_id"].dataType).alias("item_id"))
        .unionByName(places.select("class", "place", F.lit("r").alias("kind"), F.col("rh").alias("h"), "slots", item.alias("item_id")))
        .distinct()
    )
    sizes = [r.s for r in places.select("s").distinct().collect()]  # at most ``size`` values
    hit = None
    if sizes:
        near_texts = written(near_texts)
        every = reduce(DataFrame.unionByName, [_windows(near_texts, k) for k in sizes])
        hit = join_checked(every, written(says.select("kind", "h").distinct()), ["kind", "h"], "left_semi")
    else:
        hit = _windows(near_texts, size).limit(0)
    hit = written(hit)
    probed = written(says.join(probes, ["class", "place"], "left_semi").select("kind", "h", "class").distinct())
    pairs = written(join_checked(hit.select("who", "kind", "h").distinct(), probed, ["kind", "h"], "inner").select("who", "class").distinct())
    met = written(hit.join(pairs, "who").join(says, ["class", "kind", "h"]).withColumn("shift", F.col("at") - F.col("place")))

    by = ["who", "class", "shift"]
    told = met.filter("kind = 't'").select(*by, "r", F.explode("slots").alias("x")).select(*by, F.col("x.a").alias("a"), F.get("r", F.col("x.k")).alias("b")).distinct()
    mixed = told.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("a").alias("na"), F.countDistinct("b").alias("nb")).filter("n <> na OR n <> nb").select(*by)
    spot = ["who", "class", "place"]
    kept = met.filter("kind = 't'").join(mixed, by, "left_anti").select(*spot, "slots").unionByName(met.filter("kind = 'r' AND item_id IS NULL").select(*spot, "slots"))
    common = written(kept.groupBy(*spot).agg((F.max(F.size("slots")) > 0).cast("int").alias("slotted")))
    shared = written(common.groupBy("who", "class").agg(F.count(F.lit(1)).alias("n"), F.sum("slotted").alias("slotted")))
    own = met.filter("kind = 'r' AND item_id IS NOT NULL").select(*spot, "item_id").distinct().join(common.select(*spot, F.lit(0).alias("new")), spot, "left")
    own = written(own.groupBy("who", "class", "item_id").agg(F.count(F.lit(1)).alias("as_is"), F.sum(F.coalesce("new", F.lit(1))).alias("new")))
    # All items of a class that the text leaks by its template, and those whose own parameters it has.
    members = written(places.select("class", "item_id").distinct())
    enough = shared.join(counts, "class").filter(F.col("n") >= F.col("n_places") * share - 1e-9)
    pool = join_checked(enough.select("who", "class"), members, "class", "inner").unionByName(own.select("who", "class", "item_id")).distinct()
    judged = pool.join(shared, ["who", "class"], "left").join(own, ["who", "class", "item_id"], "left").join(counts, "class").fillna(0, ["n", "slotted", "as_is", "new"])
    judged = judged.select("who", "item_id", "n_places", (F.col("n") + F.col("new")).alias("n"), (F.col("slotted") + F.col("new") == F.col("as_is")).alias("exact"))
    found = written(judged.filter(F.col("n") >= F.col("n_places") * share - 1e-9))
    apart = F.when(F.col("doc_id").isNull(), F.col("who"))
    return (
        join_checked(near, found, "who", "inner")
        .groupBy("doc_id", apart.alias("apart"), "item_id")
        .agg(F.max("n").alias("n_windows"), F.max(F.col("n") / F.col("n_places")).alias("coverage"), F.max("exact").alias("exact"))
        .select("doc_id", "item_id", "n_windows", "coverage", F.when(F.col("exact"), "exact").otherwise("reparameterised").alias("kind"))
    )


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaks of ``benchmark`` into every whole text of ``documents``."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

