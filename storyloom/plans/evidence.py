"""Queries over evidence in texts and over the catalog."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import title_tokens
from ..operators import evidence as E
from ..sources.tables import articles, read
from .registry import ART, _tokens, query

#: Words of the provided texts; a real feed brings its own table.
RULES = (
    E.EventRule("license", "confirmed", (("licensed", "license"), ("apache", "mit", "gnu"))),
    E.EventRule("notice", "probable", (("copyright", "licensed"),), ("apache",)),
    E.EventRule("match_result", "probable", (("the", "der", "les"), ("with", "mit", "avec")), ("for", "für")),
    E.EventRule("injury", "probable", (("from", "von"),)),
)


def _sql_rules() -> str:
    quoted = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    whens = []
    for r in RULES:
        parts = [f"list_has_any(tk, {quoted(g)})" for g in r.groups] + ([f"NOT list_has_any(tk, {quoted(r.blockers)})"] if r.blockers else [])
        whens.append((" AND ".join(parts), r.event, r.certainty))
    case = lambda k, other: "CASE " + " ".join(f"WHEN {w[0]} THEN '{w[k]}'" for w in whens) + f" ELSE '{other}' END"
    return f"WITH {ART}, t AS (SELECT article_id, {_tokens('text')} AS tk FROM art) SELECT article_id, {case(1, 'news')} AS event, {case(2, 'weak')} AS certainty FROM t"


@query("event_evidence", _sql_rules())
def event_evidence(spark, sf_dir):
    return articles(spark, sf_dir).select("article_id", E.event_of(title_tokens(F.col("text")), RULES).alias("e")).select("article_id", "e.event", "e.certainty")


@query(
    "claims",
    f"""WITH {ART}, w AS (SELECT article_id, list_filter(string_split(lower(title), ' '), lambda x: x <> '') AS ws FROM art)
SELECT article_id, len(list_filter(range(1, len(ws) + 1), lambda i: ws[i] IN ('the', 'of', 'de') AND coalesce(ws[i - 1], '') NOT IN ('and', 'to', 'la'))) > 0 AS claimed FROM w""",
)
def claims(spark, sf_dir):
    ws = F.filter(F.split(F.lower("title"), " "), lambda x: x != "")
    return articles(spark, sf_dir).select("article_id", ws.alias("ws")).select("article_id", E.claimed(F.col("ws"), ("the", "of", "de"), ("and", "to", "la")).alias("claimed"))


@query(
    "anchor_rescue",
    f"""WITH {ART}, a AS (SELECT article_id, lower(split_part(title, ' ', 1) || ' ' || split_part(title, ' ', 2)) AS anchor, doc_id % 2 = 0 AS in_title FROM art),
w AS (SELECT *, list_filter(string_split(anchor, ' '), lambda x: x <> '') AS ws FROM a),
k AS (SELECT article_id, key, bool_or(in_title) AS in_title FROM (SELECT article_id, in_title, unnest(list_distinct([anchor] || ws || list_transform(list_filter(ws, lambda x: length(x) > 3), lambda x: '-' || substr(x, 2, 100)))) AS key FROM w) GROUP BY 1, 2),
r AS (SELECT key FROM k GROUP BY key HAVING count(*) <= 6)
SELECT x.article_id AS a_id, y.article_id AS b_id, count(*) AS n_keys FROM k x JOIN r USING (key) JOIN k y ON x.key = y.key AND x.article_id < y.article_id AND (x.in_title OR y.in_title) GROUP BY 1, 2""",
)
def anchor_rescue(spark, sf_dir):
    w = F.split("title", " ")
    anchor = F.lower(F.concat(F.coalesce(F.get(w, F.lit(0)), F.lit("")), F.lit(" "), F.coalesce(F.get(w, F.lit(1)), F.lit(""))))
    return E.rescued(articles(spark, sf_dir).select("article_id", anchor.alias("anchor"), (F.col("doc_id") % 2 == 0).alias("in_title")))


@query(
    "entity_reach",
    """WITH e AS (SELECT DISTINCT l_orderkey AS article_id, l_suppkey AS entity FROM lineitem)
SELECT article_id, s_nationkey AS competition, min(entity) AS through FROM e JOIN supplier ON entity = s_suppkey GROUP BY 1, 2""",
)
def entity_reach(spark, sf_dir):
    own = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("article_id"), F.col("l_suppkey").alias("entity")).distinct()
    return E.reach(own, read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entity"), F.col("s_nationkey").alias("competition")))


@query("alias_entities")
def alias_entities(spark, sf_dir):
    """Claiming spans has no SQL; tests hold it against examples."""
    texts = articles(spark, sf_dir).select("article_id", F.col("text"))
    return E.alias_spans(texts, {"apache license": "license:apache", "apache": None, "mit license": "license:mit", "gnu general public license": "license:gpl", "cc by": "license:cc"})


_LINKS = (("orders", "o_custkey", "customer", "c_custkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("labels", "doc_id", "documents", "doc_id"), ("documents", "doc_id", "labels", "doc_id"), ("lineitem", "l_orderkey", "orders", "o_orderkey"))


def _sql_integrity() -> str:
    parts = []
    for child, key, parent, pk in _LINKS:
        name = f"{child}.{key}"
        parts.append(f"SELECT '{name}' AS \"check\", 'missing_key' AS problem, count(*) AS n FROM {child} WHERE {key} IS NULL")
        parts.append(f"SELECT '{name}', 'no_parent', count(*) FROM {child} WHERE {key} IS NOT NULL AND {key} NOT IN (SELECT {pk} FROM {parent})")
        parts.append(f"SELECT '{name}', 'listed_twice', coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM {parent} GROUP BY {pk} HAVING count(*) > 1)")
    return f"SELECT \"check\", problem, CAST(n AS BIGINT) AS n FROM ({' UNION ALL '.join(parts)}) WHERE n > 0"


@query("catalog_integrity", _sql_integrity())
def catalog_integrity(spark, sf_dir):
    return reduce(DataFrame.union, [E.integrity(read(spark, sf_dir, c), k, read(spark, sf_dir, p), pk, f"{c}.{k}") for c, k, p, pk in _LINKS])
