"""The gates that make two articles candidates of one story, and counts over the articles that pass them.

A count over an article's own time band is a difference of sums, not a list of pairs: time is cut into slots as long as the
band, so a band is all of its own slot, the end of the slot before and the start of the slot after.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import NEVER_GROUPED, WINDOW_HOURS, case
from ..functions.hebrew import LIVE_PARTS, LIVE_WORD

# Sports that count as proven, and states whose stories are about a person.
PROVEN_SPORTS = ("basketball", "football", "tennis")
PERSON_STATES = ("signing", "release", "negotiation", "candidate", "rumor", "major_trade", "injury", "grand_slam_winner", "title_win")
MOST_STORY, RATIO = 6, 0.01


def in_play(title: Column, subtitle: Column) -> Column:
    """Whether an article reports a match that is still being played."""
    text = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(subtitle, F.lit(""))))
    parts = [text.contains(p) for p in LIVE_PARTS]
    return parts[0] | parts[1] | parts[2] | parts[3] | text.rlike(rf"(^|\s){LIVE_WORD}(\s|$)")


def clusterable(event: Column) -> Column:
    return F.coalesce(event.isin(*WINDOW_HOURS) & ~event.isin(*NEVER_GROUPED), F.lit(False))


def gated(articles: DataFrame) -> DataFrame:
    """The articles with what the gates ask for: kind (the event type, null if its stories are never grouped), live,
    proven (the sport, empty if it is not proven), at (microseconds) and band (microseconds)."""
    return articles.select(
        "*",
        F.when(clusterable(F.col("event_type")), F.col("event_type")).alias("kind"),
        in_play(F.col("title"), F.col("subtitle")).alias("live"),
        F.when(F.col("sport").isin(*PROVEN_SPORTS), F.col("sport")).otherwise("").alias("proven"),
        F.unix_micros("published_at").alias("at"),
        (case(F.col("event_type"), WINDOW_HOURS, 24).cast("long") * F.lit(3_600_000_000)).alias("band"),
    )


def band_counts(entries: DataFrame, probes: DataFrame) -> DataFrame:
    """For each distinct (key, kind, proven, at, band) of ``probes``, n: how many ``entries`` (the same columns) of its key
    and kind lie within the band of it and do not have another proven sport.

    Entries are summed by time and sport before they move, so a slot holds no more rows than points in time, however many
    articles share a key."""
    slot = F.floor(F.col("at") / F.col("band"))
    sums = [F.count(F.lit(1)).alias("n_any"), F.count(F.when(F.col("proven") == "", 1)).alias("n_open")]
    sums += [F.count(F.when(F.col("proven") == s, 1)).alias(f"n_{s}") for s in PROVEN_SPORTS]
    names = ["n_any", "n_open", *(f"n_{s}" for s in PROVEN_SPORTS)]
    points = entries.filter("kind IS NOT NULL").groupBy("key", "kind", "band", "at").agg(*sums).withColumn("slot", slot)
    asked = probes.filter("kind IS NOT NULL").select("key", "kind", "proven", "at", "band").distinct().withColumn("slot", slot)
    own, low, high = F.col("slot"), F.col("at") - F.col("band"), F.col("at") + F.col("band")
    last = F.lit((1 << 63) - 1)
    # place: where in the slot the probe stands; side -1 stands before the entries of its time, 1 after them.
    at = lambda s, p, side: F.struct(s.alias("slot"), p.alias("place"), F.lit(side).alias("side"))
    parts = asked.select("key", "kind", "proven", "at", F.explode(F.array(at(own, last, 1), at(own - 1, low, -1), at(own + 1, high, 1))).alias("p")).select("key", "kind", "proven", "at", "p.*")
    rows = points.select("key", "kind", "slot", F.col("at").alias("place"), F.lit(0).alias("side"), F.lit(None).cast("string").alias("proven"), F.lit(None).cast("long").alias("at"), *names)
    rows = rows.unionByName(parts.select("key", "kind", "slot", "place", "side", "proven", "at", *[F.lit(0).cast("long").alias(n) for n in names]))
    within = Window.partitionBy("key", "kind", "slot")
    upto = within.orderBy("place", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fits = F.when(F.col("proven") == "", F.col("any"))
    for s in PROVEN_SPORTS:
        fits = fits.when(F.col("proven") == s, F.col("open") + F.col(s))
    found = rows.select("*", *[F.sum(n).over(upto).alias(f"upto_{n}") for n in names], *[F.sum(n).over(within).alias(f"all_{n}") for n in names])
    found = found.filter("side <> 0").select(
        "key", "kind", "proven", "at", *[F.when(F.col("side") == 1, F.col(f"upto_{n}")).otherwise(F.col(f"all_{n}") - F.col(f"upto_{n}")).alias(n[2:]) for n in names]
    )
    return found.withColumn("n", fits).groupBy("key", "kind", "proven", "at").agg(F.sum("n").alias("n"))


def scoped_frequency(articles: DataFrame, generic: DataFrame | None = None, most: int = MOST_STORY, ratio: float = RATIO) -> DataFrame:
    """article_id, token, df, population and evidence for each token of each article whose stories are grouped.

    The population of an article are the articles that the gates admit beside it: its kind of event, within its band, not
    in play, of no other proven sport; itself among them, if not in play.  df counts those with the token.  A token is
    evidence if its df is at most ``most`` or at most ``ratio`` of the population, and it is not in ``generic`` (token).
    ``articles``: article_id, event_type, sport, published_at, title, subtitle, tokens (distinct)."""
    own = gated(articles).select("article_id", "kind", "proven", "at", "band", "live", "tokens").filter("kind IS NOT NULL")
    each = own.select("article_id", "kind", "proven", "at", "band", "live", F.explode("tokens").alias("key"))
    df = band_counts(each.filter("NOT live"), each)
    whole = own.withColumn("key", F.lit(""))
    population = band_counts(whole.filter("NOT live"), whole).select("kind", "proven", "at", F.col("n").alias("population"))
    # Counts are joined to one another first: both have a row per point in time, fewer than articles.
    counts = df.withColumnRenamed("n", "df").join(population, ["kind", "proven", "at"])
    if generic is not None:
        counts = counts.join(generic.select(F.col("token").alias("key"), F.lit(True).alias("listed")).distinct(), "key", "left")
    else:
        counts = counts.withColumn("listed", F.lit(None).cast("boolean"))
    rare = (F.col("df") <= most) | (F.col("df") <= F.col("population") * ratio)
    out = each.join(counts, ["key", "kind", "proven", "at"])
    return out.select("article_id", F.col("key").alias("token"), "df", "population", (F.col("listed").isNull() & rare).alias("evidence"))
