"""Coherent stories out of connected components, by rounds of joins over all components at once.

Members are admitted one after the other, in order of time, by rules that look at who was admitted before.  Between two
admissions nothing changes, so the next member of every component is the first admissible article behind the last one
admitted: one round finds it for all components, and a story of six needs four rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .gates import PROVEN_SPORTS
from .graph import saved

# Members of a story, hours it may span, members that a newcomer must match unless it matches the first.
MOST, SPAN_HOURS, TOUCHES = 6, 72.0, 2


def _links(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Every edge inside a component from both ends, with what is known of either."""
    side = lambda s: members.select(
        F.col("component").alias(f"{s}_component"), F.col("article_id").alias(f"{s}_id"), F.unix_micros("published_at").alias(f"{s}_at"), F.col("source").alias(f"{s}_source"), F.col("event_type").alias(f"{s}_event"),
        F.when(F.col("sport").isin(*PROVEN_SPORTS), F.col("sport")).otherwise("").alias(f"{s}_proven"),
    )
    intra = F.col("intra") if "intra" in edges.columns else F.lit(False)
    one = edges.select("a_id", "b_id", intra.alias("intra")).filter("a_id <> b_id")
    both = one.unionByName(one.select(F.col("b_id").alias("a_id"), F.col("a_id").alias("b_id"), "intra")).groupBy("a_id", "b_id").agg(F.max("intra").alias("intra"))
    found = both.join(side("a"), "a_id").join(side("b"), "b_id").filter("a_component = b_component")
    return found.withColumnRenamed("a_component", "component").drop("b_component")


def _member(s: str) -> Column:
    return F.struct(F.col(f"{s}_at").alias("at"), F.col(f"{s}_id").alias("id"), F.col(f"{s}_source").alias("source"), F.col(f"{s}_proven").alias("proven"))


def _agree(one: Column, two: Column) -> Column:
    return (one == two) | (one == "") | (two == "")


def coherent(members: DataFrame, edges: DataFrame, most: int = MOST, span_hours: float = SPAN_HOURS, touches: int = TOUCHES) -> DataFrame:
    """component, article_id and story (its earliest member) of the coherent story of each component, if it has one.

    The earliest edge (by its earlier end, then by ids) is the start, and there is no story if its ends may not share one.
    Others follow in (published_at, article_id) order while there are fewer than ``most``: those that match the earliest
    member or ``touches`` members, of one event, of no other proven sport, within ``span_hours`` of all, and of another
    source than any member but those that an edge marked ``intra`` proves they repeat.  Who is passed over is not asked
    again.  ``members``: component, article_id, published_at, source, event_type, sport; ``edges``: a_id, b_id and, if
    there is such a column, intra."""
    span = F.lit(int(span_hours * 3_600_000_000))
    links = saved(_links(members, edges))
    start = F.struct(F.least("a_at", "b_at"), "a_id", "b_id")
    seed = links.filter("a_id < b_id").groupBy("component").agg(F.min_by(F.struct("*"), start).alias("s")).select("s.*")
    fits = (F.col("a_event") == F.col("b_event")) & (F.col("intra") | ~F.col("a_source").eqNullSafe(F.col("b_source"))) & _agree(F.col("a_proven"), F.col("b_proven")) & (F.abs(F.col("a_at") - F.col("b_at")) <= span)
    empty = F.lit(None).cast("struct<at:bigint,id:string>")
    state = saved(seed.filter(fits).select("component", F.col("a_event").alias("event"), F.array_sort(F.array(_member("a"), _member("b"))).alias("members"), empty.alias("last")))
    for _ in range(most - 2):
        each = state.select("component", F.explode("members.id").alias("b_id"), F.get("members.id", F.lit(0)).alias("first"))
        met = links.join(each, ["component", "b_id"]).groupBy("component", "a_id", "a_at", "a_source", "a_event", "a_proven")
        met = met.agg(F.count(F.lit(1)).alias("n"), F.max(F.col("b_id") == F.col("first")).alias("founder"), F.collect_set(F.when(F.col("intra"), F.col("b_id"))).alias("repeats"))
        place = F.struct(F.col("a_at").alias("at"), F.col("a_id").alias("id"))
        own = (
            (F.col("founder") | (F.col("n") >= touches))
            & (F.col("last").isNull() | (place > F.col("last")))
            & ~F.array_contains("members.id", F.col("a_id"))
            & (F.col("a_event") == F.col("event"))
            & F.forall("members", lambda m: _agree(m["proven"], F.col("a_proven")) & (F.abs(m["at"] - F.col("a_at")) <= span) & (~m["source"].eqNullSafe(F.col("a_source")) | F.array_contains("repeats", m["id"])))
        )
        new = met.join(state, "component").filter(own).groupBy("component").agg(F.min(place).alias("place"), F.min_by(_member("a"), place).alias("new"))
        grown = saved(state.join(new, "component", "left").select("component", "event", F.when(F.col("new").isNull(), F.col("members")).otherwise(F.array_sort(F.array_append("members", F.col("new")))).alias("members"), "last", "place"))
        if grown.filter("place IS NOT NULL").isEmpty():
            break
        # A component without a newcomer has none in later rounds either: its pointer need not move.
        state = grown.select("component", "event", "members", F.coalesce("place", "last").alias("last"))
    return state.select("component", F.explode("members.id").alias("article_id"), F.get("members.id", F.lit(0)).alias("story"))


def kept_edges(stories: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges whose ends are in one story, with that story."""
    a = stories.select(F.col("article_id").alias("a_id"), "story")
    b = stories.select(F.col("article_id").alias("b_id"), F.col("story").alias("other"))
    return edges.join(a, "a_id").join(b, "b_id").filter("story = other").drop("other")


def built(stories: DataFrame, members: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per story: anchor_id, representative_id, member_ids (sorted), event_state, sport (if the members know exactly
    one) and n_edges.  The representative has most facts (an event, a competition, an entity), is surest, latest and of
    the smallest id.  ``members`` as for ``coherent``, and certainty, competition and n_entities."""
    own = stories.select("article_id", "story").join(members, "article_id")
    facts = (F.col("n_entities") > 0).cast("int") + F.col("competition").isNotNull().cast("int") + (F.col("event_type") != "news").cast("int")
    sure = F.when(F.col("certainty") == "confirmed", 2).when(F.col("certainty") == "probable", 1).otherwise(0)
    best = F.struct((-facts).alias("f"), (-sure).alias("s"), (-F.unix_micros("published_at")).alias("t"), "article_id")
    sports = F.collect_set(F.when(F.col("sport") != "unknown", F.col("sport")))
    rows = own.groupBy(F.col("story").alias("anchor_id")).agg(
        F.min_by("article_id", best).alias("representative_id"), F.array_sort(F.collect_set("article_id")).alias("member_ids"), F.first("event_type").alias("event_state"), F.when(F.size(sports) == 1, F.get(sports, F.lit(0))).alias("sport")
    )
    counted = kept_edges(stories, edges.select(F.least("a_id", "b_id").alias("a_id"), F.greatest("a_id", "b_id").alias("b_id")).distinct()).groupBy(F.col("story").alias("anchor_id")).agg(F.count(F.lit(1)).alias("n_edges"))
    return rows.join(counted, "anchor_id")


def reconciled(proposed: DataFrame, existing: DataFrame, scope: DataFrame, least: int = 2) -> DataFrame:
    """cluster_id, article_id and change of a new snapshot of memberships, after ``proposed`` (story, article_id) was found
    for the articles of ``scope`` (article_id); ``existing`` has the memberships before (cluster_id, article_id).

    A proposal goes on under the id of the cluster that holds most of its members (the smallest id of equal ones), or else
    under one made from its anchor.  Where two claim one id both go on under it, as members moved together do.  Members in
    scope that no proposal has leave; those out of scope stay, unless a proposal has them.  A cluster of fewer than
    ``least`` members ends.  change: created or retained (the cluster), kept_out_of_scope, unclustered, or removed (left
    alone by a cluster that ended); the last two have a null cluster_id."""
    held = proposed.join(existing, "article_id").groupBy("story", "cluster_id").agg(F.count(F.lit(1)).alias("n"))
    best = held.groupBy("story").agg(F.min_by("cluster_id", F.struct((-F.col("n")).alias("n"), "cluster_id")).alias("cluster_id"))
    minted = F.concat(F.lit("cluster_"), F.substring(F.sha1("story"), 1, 16))
    named = proposed.select("story").distinct().join(best, "story", "left")
    named = named.select("story", F.coalesce("cluster_id", minted).alias("new_id"), F.when(F.col("cluster_id").isNull(), "created").otherwise("retained").alias("how"))
    own = proposed.join(named, "story").select("article_id", "new_id", "how")
    every = own.join(existing, "article_id", "full_outer").join(scope.select("article_id", F.lit(True).alias("asked")), "article_id", "left")
    stays = F.col("new_id").isNull() & F.col("asked").isNull()
    to = F.when(stays, F.col("cluster_id")).otherwise(F.col("new_id"))
    change = F.when(stays, "kept_out_of_scope").when(F.col("new_id").isNull(), "unclustered").otherwise(F.col("how"))
    moved = every.select("article_id", to.alias("cluster_id"), change.alias("change"), "asked", F.col("cluster_id").alias("was"))
    sizes = moved.filter("cluster_id IS NOT NULL").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"), F.max(F.coalesce("asked", F.lit(False)) | (F.col("change") != "kept_out_of_scope")).alias("reached"))
    lost = moved.filter("was IS NOT NULL AND asked").select(F.col("was").alias("cluster_id"), F.lit(True).alias("hit")).distinct()
    sizes = sizes.join(lost, "cluster_id", "left")
    # Only clusters that the scope reaches are looked at; others are left as they are, whatever their size.
    ends = (F.col("size") < least) & (F.col("reached") | F.col("hit").isNotNull())
    out = moved.join(sizes.filter(ends).select("cluster_id", F.lit(True).alias("ended")), "cluster_id", "left")
    return out.select("article_id", F.when(F.col("ended").isNull(), F.col("cluster_id")).alias("cluster_id"), F.when(F.col("ended").isNotNull(), "removed").otherwise(F.col("change")).alias("change"))
