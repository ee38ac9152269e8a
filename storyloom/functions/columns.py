"""Column builders shared by the operators; all of them stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ranks of feed decisions, and how long (hours) two reports of one kind of event may lie apart.
DECISIONS = ("hidden", "low_feed", "feed", "high_feed", "push")
WINDOW_HOURS = {
    "signing": 24, "release": 24, "major_trade": 24, "negotiation": 24, "candidate": 24, "rumor": 24, "news": 24,
    "match_result": 12, "finals_result": 12, "title_win": 12, "grand_slam_winner": 12, "playoff_result": 12,
    "regular_season_result": 12, "early_round_result": 12, "injury": 48,
}
NEVER_GROUPED = ("schedule", "preview", "interview", "analysis", "opinion")


def case(of: Column, values: dict, default=None) -> Column:
    """A literal lookup as one CASE."""
    out = F.lit(default)
    for k, v in reversed(list(values.items())):
        out = F.when(of == k, F.lit(v)).otherwise(out)
    return out


def decision_rank(of: Column) -> Column:
    return case(of, {d: i for i, d in enumerate(DECISIONS)}, 0)


def story_id(url: Column) -> Column:
    """rss_ and the first 20 hex digits of the URL's SHA-1: equal URLs have equal ids."""
    return F.concat(F.lit("rss_"), F.substring(F.sha1(url), 1, 20))


def hours_between(a: Column, b: Column) -> Column:
    return (F.unix_micros(a) - F.unix_micros(b)) / F.lit(3.6e9)


def title_tokens(text: Column, least: int = 3) -> Column:
    """Distinct lower-cased words of letters and digits with at least ``least`` characters, sorted; null gives none."""
    parts = F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"))
    return F.sort_array(F.filter(parts, lambda t: F.length(t) >= least))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct tokens; 0 if either is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(shared / (F.size(a) + F.size(b) - shared))


def rate(part: Column, whole: Column, places: int = 4) -> Column:
    """part / whole, rounded half-even; null where the whole is not positive, never 0."""
    return F.when(whole > 0, F.bround(part / whole, places))


def clean_html(html: Column, most: int = 240) -> Column:
    """Visible text of HTML: scripts, styles and tags go, the five basic entities are decoded, white space is squeezed,
    and the first ``most`` characters stay."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.substring(F.trim(F.regexp_replace(t, r"[ \t\r\n]+", " ")), 1, most)


def language_of_url(url: Column, known=("en", "fr", "de", "es", "he", "it"), default: str = "en") -> Column:
    """The first path segment that is a known language code, else the default."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), rf"://[^/]+/({'|'.join(known)})(?:/|$)", 1)
    return F.when(found == "", F.lit(default)).otherwise(found)


def exact_sum(of: Column) -> Column:
    """The sum of doubles that does not depend on their order: to twelve decimal places, then as a double.  Where a value
    fits no decimal (not finite, or 1e16 and more), the plain sum."""
    exact = of.try_cast("decimal(28,12)")
    return F.when(F.count(exact) == F.count(of), F.sum(exact).cast("double")).otherwise(F.sum(of))
