"""Queries on names as anchors of stories, and on counts over the articles that the gates admit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import WINDOW_HOURS, title_tokens
from ..operators import gates as T
from ..operators import names as N
from ..operators.graph import saved
from ..sources.tables import articles, read
from .registry import ART, _tokens, query

#: The provided texts are in Latin script; what is vocabulary in them is read off their titles.
RULES = N.NameRules(word=r"\p{L}+", prefixes="dls", punctuation=r"[\p{P}\p{S}]", role_titles=("the", "le", "der"), possessives=("of", "de", "von"), opponents=("with", "pour", "and"))
LISTED, NON_NAME = 0.05, 0.02
GENERIC = ("the", "and", "les", "des", "der", "und")


def _vocabulary(art: DataFrame) -> DataFrame:
    """(word, kinds): words of a twentieth of the titles are listed, those of a fiftieth are no names."""
    each = art.select(F.explode(F.array_distinct(N.words(F.col("title"), RULES))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.col("total")
    rated = each.crossJoin(F.broadcast(art.agg(F.count(F.lit(1)).alias("total")))).filter(share >= NON_NAME)
    return rated.select("word", F.when(share >= LISTED, N.LISTED).otherwise(N.NON_NAME).alias("kinds"))


def _articles(spark, sf_dir) -> DataFrame:
    return articles(spark, sf_dir).select("article_id", "title", "subtitle", "event_type", "sport", "published_at", "source", "text", "doc_id")


def _candidates(spark, sf_dir, frequencies: DataFrame | None = None) -> DataFrame:
    art = _articles(spark, sf_dir)
    return N.candidates(art, saved(_vocabulary(art)), RULES, frequencies=frequencies)


def _judged(spark, sf_dir) -> DataFrame:
    """The candidates, held against the language of the conversations."""
    language = saved(N.word_frequencies(read(spark, sf_dir, "conversations"), RULES))
    return N.validated(_candidates(spark, sf_dir, language), language, RULES)


def _anchors(spark, sf_dir) -> DataFrame:
    return N.story_anchors(_judged(spark, sf_dir))


_STATES = ", ".join(f"'{s}'" for s in WINDOW_HOURS)
_PROVEN = ", ".join(f"'{s}'" for s in T.PROVEN_SPORTS)
_HOURS = " ".join(f"WHEN '{k}' THEN {v}" for k, v in WINDOW_HOURS.items())
_PREFIX = "[" + ", ".join(f"'{c}'" for c in RULES.prefixes) + "]"
GATES = f"""{ART}, g AS MATERIALIZED (
  SELECT *, substr(text, 81, 240) AS subtitle, CASE WHEN event_type IN ({_STATES}) THEN event_type END AS kind,
    contains(lower(concat_ws(' ', coalesce(title, ''), coalesce(substr(text, 81, 240), ''))), 'live') AS live,
    CASE WHEN sport IN ({_PROVEN}) THEN sport END AS proven, epoch_us(published_at) AS at, 3600000000 * CASE event_type {_HOURS} ELSE 24 END AS band
  FROM art), pop AS MATERIALIZED (
  SELECT x.article_id AS x, p.article_id AS p FROM g x JOIN g p ON x.kind = p.kind AND NOT p.live AND abs(x.at - p.at) <= x.band AND coalesce(x.proven = p.proven, true))"""
_WORDS = r"list_filter(regexp_extract_all(regexp_replace(lower(coalesce({}, '')), '[\p{{P}}\p{{S}}]', ' ', 'g'), '\p{{L}}+'), lambda w: length(w) > 1)"
_FORMS = f"CASE WHEN length({{0}}) > 3 AND list_contains({_PREFIX}, substr({{0}}, 1, 1)) THEN [{{0}}, substr({{0}}, 2)] ELSE [{{0}}] END"
FOUND = f"""{GATES}, t AS (
  SELECT article_id, 'title' AS source, {_WORDS.format('title')} AS ws FROM g UNION ALL SELECT article_id, 'subtitle', {_WORDS.format('subtitle')} FROM g), m AS MATERIALIZED (
  SELECT article_id, source, ws, i - 1 AS i, ws[i] AS w, CASE WHEN i > 1 THEN ws[i - 1] END AS prev, CASE WHEN i > 2 THEN ws[i - 2] END AS prev2
  FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM t)), v AS MATERIALIZED (
  SELECT w, CASE WHEN n / total >= {LISTED} THEN 1 ELSE 2 END AS kinds FROM (SELECT w, count(DISTINCT article_id) AS n FROM m WHERE source = 'title' GROUP BY w), (SELECT count(*) AS total FROM g) WHERE n / total >= {NON_NAME}),
d AS (SELECT w, length(w) AS n, list_contains({_PREFIX}, substr(w, 1, 1)) AS p1, length(w) > 3 AND list_contains({_PREFIX}, substr(w, 1, 1)) AND list_contains({_PREFIX}, substr(w, 2, 1)) AS p2 FROM (SELECT DISTINCT w FROM m)),
fr AS (
  SELECT d.w, true AS free FROM d LEFT JOIN v v0 ON v0.w = d.w LEFT JOIN v v1 ON v1.w = substr(d.w, 2) LEFT JOIN v v2 ON v2.w = substr(d.w, 3)
  WHERE v0.w IS NULL AND NOT coalesce(p1 AND (n > 3 AND v1.kinds > 0 OR n = 3 AND v1.kinds = 2), false) AND NOT coalesce(p2 AND (n > 4 AND v2.kinds > 0 OR n = 4 AND v2.kinds = 2), false)),
f0 AS (SELECT m.*, coalesce(free, false) AS free FROM m LEFT JOIN fr USING (w)),
f1 AS (SELECT *, CASE WHEN free AND lead(free) OVER b THEN lead(w) OVER b END AS nx, free AND coalesce(lead(free) OVER b, false) OR free AND coalesce(lag(free) OVER b, false) AS paired FROM f0 WINDOW b AS (PARTITION BY article_id, source ORDER BY i)),
f AS MATERIALIZED (SELECT *, list(w) FILTER (paired) OVER (PARTITION BY article_id, source) AS pairs FROM f1),
lx AS MATERIALIZED (SELECT DISTINCT article_id, unnest({_FORMS.format('w')}) AS key FROM (SELECT article_id, unnest([w, nx]) AS w FROM f WHERE nx IS NOT NULL)),
lw AS MATERIALIZED (SELECT DISTINCT article_id, w AS key FROM (SELECT article_id, unnest([w, nx]) AS w FROM f WHERE nx IS NOT NULL)),
kn AS (SELECT DISTINCT a.article_id, a.key FROM (SELECT DISTINCT article_id, unnest({_FORMS.format('w')}) AS key FROM f WHERE free) a JOIN pop ON pop.x = a.article_id JOIN lx ON lx.article_id = pop.p AND lx.key = a.key),
sk AS (SELECT DISTINCT a.article_id, a.key FROM (SELECT DISTINCT article_id, w AS key FROM f WHERE free) a JOIN pop ON pop.x = a.article_id JOIN lw ON lw.article_id = pop.p AND lw.key = a.key),
lone AS (SELECT f.*, EXISTS (SELECT 1 FROM kn WHERE kn.article_id = f.article_id AND list_contains({_FORMS.format('f.w')}, kn.key)) AS known, EXISTS (SELECT 1 FROM sk WHERE sk.article_id = f.article_id AND sk.key = f.w) AS spelt FROM f WHERE free),
c0 AS (
  SELECT article_id, source, i AS token_start, i + 2 AS token_end, w || ' ' || nx AS anchor, 'name_bigram' AS generation_rule, 'strong' AS confidence, prev, prev2, ws, false AS population_corroborated FROM f WHERE nx IS NOT NULL
  UNION ALL SELECT article_id, source, i, i + 1, w, 'corroborated_single', 'weak', prev, prev2, ws, known FROM lone WHERE known OR spelt OR list_has_any({_FORMS.format('w')}, coalesce(pairs, []))),
c AS MATERIALIZED (
  SELECT *, CASE WHEN prev IN ('of', 'de', 'von') OR prev IN ('the', 'le', 'der') OR prev2 IN ('the', 'le', 'der') THEN 'role_holder' WHEN prev IN ('with', 'pour', 'and') THEN 'opponent' ELSE 'unknown' END AS role FROM c0)"""
JUDGED = f"""{FOUND}, fq AS MATERIALIZED (
  SELECT w, round(log10(n / sum(n) OVER ()) + 9, 2) AS zipf FROM (SELECT w, count(*) AS n FROM (SELECT unnest({_WORDS.format('text')}) AS w FROM conversations) GROUP BY w)),
z AS (SELECT anchor, max(coalesce(zipf, 0)) AS z FROM (SELECT anchor, unnest({_FORMS.format('w')}) AS w FROM (SELECT DISTINCT anchor, unnest(string_split(anchor, ' ')) AS w FROM c)) LEFT JOIN fq USING (w) GROUP BY anchor),
j AS MATERIALIZED (
  SELECT *, CASE WHEN z >= 4.4 THEN 'ordinary_word' WHEN z <= 3.4 THEN 'rare_in_language' ELSE 'uncertain_band' END AS reason_code,
    CASE WHEN z >= 4.4 THEN 'rejected' WHEN z <= 3.4 THEN 'accepted' ELSE 'abstained' END AS decision FROM c JOIN z USING (anchor))"""
STORED = f"""{JUDGED}, st AS MATERIALIZED (
  SELECT article_id, anchor, role, source, reason_code FROM j WHERE decision = 'accepted' AND role = 'unknown'
  QUALIFY row_number() OVER (PARTITION BY article_id, anchor ORDER BY source <> 'title', generation_rule <> 'name_bigram', token_start) = 1)"""
KEYS = f"""{STORED}, k AS MATERIALIZED (
  SELECT article_id, key, bool_or(source = 'title') AS in_title FROM (
    SELECT article_id, source, unnest(list_distinct([anchor, 'translit:' || anchor] || flatten(list_transform(string_split(anchor, ' '), lambda w: {_FORMS.format('w')})))) AS key FROM st) GROUP BY 1, 2)"""


@query("gate_population", f"WITH {GATES} SELECT article_id, kind, count(p) AS population FROM g LEFT JOIN pop ON x = article_id WHERE kind IS NOT NULL GROUP BY 1, 2")
def gate_population(spark, sf_dir):
    """How many articles the gates admit beside each article."""
    own = T.gated(_articles(spark, sf_dir)).withColumn("key", F.lit("")).filter("kind IS NOT NULL")
    counts = T.band_counts(own.filter("NOT live"), own)
    return own.join(counts, ["kind", "proven", "at"]).select("article_id", "kind", F.col("n").alias("population"))


@query(
    "scoped_evidence",
    f"""WITH {GATES}, tk AS MATERIALIZED (SELECT article_id, unnest({_tokens("title || ' ' || subtitle")}) AS token FROM g WHERE kind IS NOT NULL),
n AS (SELECT x AS article_id, count(*) AS population FROM pop GROUP BY x),
df AS (SELECT a.article_id, a.token, count(b.token) AS df FROM tk a LEFT JOIN (SELECT x, token FROM pop JOIN tk ON tk.article_id = pop.p) b ON b.x = a.article_id AND b.token = a.token GROUP BY 1, 2)
SELECT article_id, token, df, coalesce(population, 0) AS population, (df <= 6 OR df <= coalesce(population, 0) * 0.01::DOUBLE) AND token NOT IN {GENERIC} AS evidence FROM df LEFT JOIN n USING (article_id)""",
)
def scoped_evidence(spark, sf_dir):
    """Which tokens of an article are evidence by their frequency among the articles that the gates admit beside it."""
    art = _articles(spark, sf_dir).withColumn("tokens", title_tokens(F.concat_ws(" ", "title", "subtitle")))
    return T.scoped_frequency(art, spark.createDataFrame([(g,) for g in GENERIC], "token string"))


@query(
    "anchor_candidates",
    f"""WITH {FOUND} SELECT article_id, source, CAST(token_start AS INT) AS token_start, CAST(token_end AS INT) AS token_end, anchor, generation_rule, confidence, role, population_corroborated,
  array_to_string(ws[greatest(token_start - 2, 1):token_start], ' ') AS before, array_to_string(ws[token_end + 1:token_end + 3], ' ') AS after FROM c""",
)
def anchor_candidates(spark, sf_dir):
    """Names found by their neighbours or known to the articles around, with role and context."""
    found = _candidates(spark, sf_dir)
    sides = {"before": F.array_join("left_context", " "), "after": F.array_join("right_context", " ")}
    return found.withColumns(sides).drop("entity_id", "left_context", "right_context")


@query("anchor_decisions", f"WITH {JUDGED} SELECT decision, reason_code, generation_rule, role, count(*) AS n, count(DISTINCT anchor) AS n_anchors, round(max(z), 2) AS most_zipf FROM j GROUP BY 1, 2, 3, 4")
def anchor_decisions(spark, sf_dir):
    """How many candidates are accepted, rejected and left open, and why."""
    by = ("decision", "reason_code", "generation_rule", "role")
    return _judged(spark, sf_dir).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("anchor").alias("n_anchors"), F.round(F.max("max_zipf"), 2).alias("most_zipf"))


@query("story_anchors", f"WITH {STORED} SELECT article_id, anchor, role, source, reason_code FROM st")
def story_anchors(spark, sf_dir):
    """The accepted names that articles may be about."""
    return _anchors(spark, sf_dir)


@query(
    "anchor_pairs",
    f"""WITH {KEYS} SELECT x.article_id AS a_id, p.article_id AS b_id, count(*) AS n_keys
FROM g x JOIN k a ON a.article_id = x.article_id JOIN k b ON b.key = a.key JOIN g p ON p.article_id = b.article_id
WHERE x.article_id < p.article_id AND x.kind = p.kind AND x.kind IN ({", ".join(f"'{s}'" for s in T.PERSON_STATES)}) AND NOT x.live AND NOT p.live AND x.source <> p.source
  AND abs(x.at - p.at) <= x.band AND coalesce(x.proven = p.proven, true) AND (a.in_title OR b.in_title) GROUP BY 1, 2""",
)
def anchor_pairs(spark, sf_dir):
    """Pairs of articles that a headlined name holds together."""
    return N.subject_pairs(N.anchor_keys(_anchors(spark, sf_dir), RULES), _articles(spark, sf_dir))


@query("stale_anchors", f"WITH {ART} SELECT article_id, event_type FROM art WHERE doc_id % 3 <> 1")
def stale_anchors(spark, sf_dir):
    """Articles whose anchors are of an older validator, or missing, and must be found anew."""
    art = _articles(spark, sf_dir)
    stored = art.filter("doc_id % 3 > 0").select("article_id", F.when(F.col("doc_id") % 3 == 1, "v2").otherwise("v1").alias("validator_version"))
    return N.refreshed(art, stored, "v2").select("article_id", "event_type")
