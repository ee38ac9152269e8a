"""All queries of the library outside its training-data subpackage, each with SQL that gives the same rows."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import WINDOW_HOURS, clean_html, hours_between, language_of_url, story_id, title_tokens
from ..operators import articles as A
from ..operators import coherence as C
from ..operators import graph as G
from ..operators import learning as L
from ..operators import metrics as M
from ..operators import scoring as S
from ..operators import similarity as P
from ..operators.evidence import claimed
from ..operators.gates import in_play
from ..sources.tables import EVENT_TYPES, SPORTS, articles, pick, read
from ..streaming.stories import StoryFeed

QUERIES: dict = {}
SQL: dict = {}

NOW = datetime(2024, 1, 5, tzinfo=timezone.utc)
LATER = datetime(2024, 2, 1, tzinfo=timezone.utc)


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


ART = f"""art AS (
  SELECT doc_id, 'rss_' || substr(sha1(url), 1, 20) AS article_id, url, source, lang, text, substr(text, 1, 80) AS title,
    TIMESTAMP '2024-01-01' + to_minutes(30 * doc_id) AS published_at, ({_list(EVENT_TYPES)})[1 + doc_id % 6] AS event_type,
    ({_list(SPORTS)})[1 + doc_id % 4] AS sport
  FROM (SELECT *, 'https://news.example/' || source || '/' || doc_id AS url FROM documents))"""


def _tokens(of: str) -> str:
    return f"list_sort(list_distinct(list_filter(string_split(regexp_replace(lower(coalesce({of}, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda t: length(t) >= 3)))"


RANK = "CASE {} WHEN 'push' THEN 4 WHEN 'high_feed' THEN 3 WHEN 'feed' THEN 2 WHEN 'low_feed' THEN 1 ELSE 0 END"
LADDER = "CASE WHEN toxic = 1 THEN 'hidden' WHEN quality IS NULL THEN 'low_feed' WHEN quality = 0 THEN 'hidden' WHEN lang = 'en' THEN 'high_feed' ELSE 'feed' END"
#: Articles a minute apart with the tokens of whole texts, and candidate pairs of one kind of event within 48 hours.
MARKERS, CONDITIONALS = ("the", "of", "de"), ("and", "to", "la")
#: Words that are no evidence, however rare.
GENERIC = ("licensed", "copyright", "permission", "software", "warranty")
PAIRS = f"""{ART}, tk AS (SELECT article_id, source, lang, event_type, sport, TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS published_at, title, {_tokens('text')} AS tokens,
  'c' || CAST(doc_id // 4 % 3 AS VARCHAR) AS competition, 'e' || CAST(doc_id // 8 % 25 AS VARCHAR) AS entity, substr(text, 81, 240) AS subtitle, 'room' || CAST(doc_id % 5 AS VARCHAR) AS room, list_filter(string_split(lower(title), ' '), lambda x: x <> '') AS ws FROM art),
ex AS (SELECT article_id, event_type, published_at, unnest(tokens) AS token FROM tk),
rare AS (SELECT token FROM ex WHERE token NOT IN {GENERIC} GROUP BY token HAVING count(*) <= 6 OR count(*) <= (SELECT count(*) FROM art) * 0.01::DOUBLE),
cand AS (
  SELECT a.article_id AS a_id, b.article_id AS b_id, count(*) AS n_rare
  FROM ex a JOIN rare USING (token) JOIN ex b ON a.token = b.token AND a.event_type = b.event_type AND a.article_id < b.article_id
  WHERE abs(epoch_us(a.published_at) - epoch_us(b.published_at)) <= 48 * 3600000000 GROUP BY 1, 2),
cl AS (SELECT article_id, len(list_filter(range(1, len(ws) + 1), lambda i: ws[i] IN {MARKERS} AND coalesce(ws[i - 1], '') NOT IN {CONDITIONALS})) > 0 AS claim FROM tk),
pr AS (
  SELECT a_id, b_id, n_rare, len(list_intersect(a.tokens, b.tokens)) AS sh, len(a.tokens) AS na, len(b.tokens) AS nb,
    CASE WHEN len(a.tokens) = 0 OR len(b.tokens) = 0 THEN 0.0 ELSE len(list_intersect(a.tokens, b.tokens)) / (len(a.tokens) + len(b.tokens) - len(list_intersect(a.tokens, b.tokens))) END AS j,
    a.source AS s1, b.source AS s2, a.event_type AS e1, b.event_type AS e2, a.sport AS p1, b.sport AS p2, concat_ws(' ', a.title, a.subtitle) AS t1, concat_ws(' ', b.title, b.subtitle) AS t2, a.lang AS g1, b.lang AS g2, a.room AS q1, b.room AS q2, a.entity AS n1, b.entity AS n2, a.competition AS k1, b.competition AS k2, ca.claim AS c1, cb.claim AS c2,
    abs(epoch_us(a.published_at) - epoch_us(b.published_at)) / 3600000000.0 AS hours
  FROM cand JOIN tk a ON a.article_id = a_id JOIN tk b ON b.article_id = b_id JOIN cl ca ON ca.article_id = a_id JOIN cl cb ON cb.article_id = b_id)"""


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return articles(spark, sf_dir).join(labels, "doc_id", "left").withColumn("decision", S.label_decision(F.col("quality"), F.col("toxic"), F.col("lang")))


def _us(c) -> F.Column:
    return F.unix_micros(c)


def _paired(spark: SparkSession, sf_dir: str, least: float = 0.0, kept: tuple[str, ...] = ()) -> DataFrame:
    """Candidate pairs with what is kept of both sides; those of a similarity under ``least`` are left out."""
    ws = F.filter(F.split(F.lower("title"), " "), lambda x: x != "")
    art = articles(spark, sf_dir).select(
        "article_id", "source", "lang", "event_type", "sport", in_play(F.col("title"), F.col("subtitle")).alias("live"),
        F.timestamp_micros(F.lit(1704067200000000) + F.col("doc_id") * 60000000).alias("published_at"),
        title_tokens(F.col("text")).alias("tokens"),
        F.concat(F.lit("c"), (F.floor(F.col("doc_id") / 4) % 3).cast("string")).alias("competition"),
        F.concat(F.lit("room"), (F.col("doc_id") % 5).cast("string")).alias("room"),
        F.array(F.concat(F.lit("e"), (F.floor(F.col("doc_id") / 8) % 25).cast("string"))).alias("entities"),
        claimed(ws, MARKERS, CONDITIONALS).alias("claim"),
    )
    return P.candidate_pairs(art, generic=GENERIC, least=least, kept=kept)


@query(
    "feed_ranked",
    f"""WITH {ART}, d AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn, count(*) OVER (PARTITION BY text) AS n_copies FROM art)
SELECT article_id, source, lang, epoch_us(published_at) AS published_us, n_copies, {LADDER} AS decision
FROM d LEFT JOIN labels USING (doc_id) WHERE rn = 1 AND published_at >= TIMESTAMP '2024-01-05' - INTERVAL 36 HOURS
ORDER BY {RANK.format(LADDER)} DESC, published_at DESC, article_id LIMIT 50""",
)
def feed_ranked(spark, sf_dir):
    """Exact copies folded, stale articles dropped, labels turned to decisions, the fifty first in feed order."""
    first = A.fresh(A.dedup(_decided(spark, sf_dir), "text", "doc_id"), NOW)
    return S.ranked(first, 50).select("article_id", "source", "lang", _us("published_at").alias("published_us"), "n_copies", "decision")


@query("dedup_exact", "SELECT min(doc_id) AS doc_id, count(*) AS n_copies FROM documents GROUP BY text")
def dedup_exact(spark, sf_dir):
    return A.dedup(read(spark, sf_dir, "documents"), "text", "doc_id").select("doc_id", "n_copies")


@query("freshness_window", f"WITH {ART} SELECT article_id FROM art WHERE published_at >= TIMESTAMP '2024-01-05' - INTERVAL 36 HOURS")
def freshness_window(spark, sf_dir):
    return A.fresh(articles(spark, sf_dir), NOW).select("article_id")


@query(
    "timestamp_clamp",
    f"""WITH {ART}, t AS (SELECT article_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE published_at END AS p FROM art)
SELECT article_id, epoch_us(CASE WHEN p IS NULL OR p > TIMESTAMP '2024-01-05 00:15:00' THEN TIMESTAMP '2024-01-05' ELSE p END) AS used_us,
  CASE WHEN p IS NULL THEN 'ingest_fallback' WHEN p > TIMESTAMP '2024-01-05 00:15:00' THEN 'clamped_future' END AS note FROM t""",
)
def timestamp_clamp(spark, sf_dir):
    art = articles(spark, sf_dir).withColumn("published_at", F.when(F.col("doc_id") % 7 != 0, F.col("published_at")))
    return A.normalised_time(art, NOW).select("article_id", _us("at_used").alias("used_us"), F.col("at_note").alias("note"))


@query(
    "lang_detect",
    "SELECT page_id, coalesce(nullif(regexp_extract(coalesce(url, ''), '://[^/]+/(en|fr|de|es|he|it)(?:/|$)', 1), ''), 'en') AS lang FROM pages",
)
def lang_detect(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", language_of_url(F.col("url")).alias("lang"))


@query(
    "source_filter",
    """SELECT page_id, url FROM pages WHERE NOT contains(url, 'spam') AND NOT contains(url, 'casino') AND (contains(url, 'example.net') OR contains(url, 'example.org'))
AND coalesce(nullif(regexp_extract(url, '://[^/]+/(en|fr|de|es|he|it)(?:/|$)', 1), ''), 'en') IN ('en', 'fr')""",
)
def source_filter(spark, sf_dir):
    return A.source_filter(read(spark, sf_dir, "pages"), ("spam", "casino"), ("example.net", "example.org"), ("en", "fr")).select("page_id", "url")


@query("token_df", f"WITH {ART}, e AS (SELECT unnest({_tokens('title')}) AS token FROM art) SELECT token, count(*) AS df FROM e GROUP BY token")
def token_df(spark, sf_dir):
    return P.document_frequency(articles(spark, sf_dir).select(title_tokens(F.col("title")).alias("tokens")))


@query("jaccard_pairs", f"WITH {PAIRS} SELECT a_id, b_id, n_rare, round(j, 4) AS jaccard FROM pr WHERE j >= 0.35")
def jaccard_pairs(spark, sf_dir):
    return _paired(spark, sf_dir, 0.35).select("a_id", "b_id", "n_rare", F.round(P.alike(), 4).alias("jaccard"))


_WINDOW = "CASE e1 " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in WINDOW_HOURS.items()) + " ELSE 24 END"
_LISTED = ", ".join(f"'{x}'" for x in WINDOW_HOURS)


@query(
    "pair_verdict_reasons",
    f"""WITH {PAIRS}, tr AS (SELECT *, CASE WHEN e1 = 'news' OR p1 = 'unknown' OR p2 = 'unknown' THEN 'C' WHEN k1 = k2 OR n1 = n2 THEN 'A' ELSE 'B' END AS tier FROM pr), v AS (
  SELECT tier,
    CASE WHEN s1 = s2 THEN 'same_source' WHEN e1 NOT IN ({_LISTED}) OR e2 NOT IN ({_LISTED}) THEN 'not_clusterable_state' WHEN e1 <> e2 THEN 'event_state_incompatible' WHEN c1 <> c2 THEN 'claim_reversal_mismatch'
      WHEN contains(lower(t1), 'live') OR contains(lower(t2), 'live') THEN 'in_play' WHEN hours > {_WINDOW} THEN 'outside_time_window'
      WHEN p1 <> 'unknown' AND p2 <> 'unknown' AND p1 <> p2 THEN 'cross_sport' WHEN j < CASE tier WHEN 'A' THEN 0.30 ELSE 0.35 END THEN 'below_threshold'
      WHEN n_rare < CASE tier WHEN 'C' THEN 2 ELSE 1 END THEN 'no_discriminative_evidence' END AS reason FROM tr)
SELECT tier, coalesce(reason, 'accepted') AS reason, count(*) AS n FROM v GROUP BY 1, 2""",
)
def pair_verdict_reasons(spark, sf_dir):
    return P.verdicts(_paired(spark, sf_dir, kept=("source", "event_type", "sport", "competition", "entities", "claim", "live"))).groupBy("tier", F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("republish_pairs", f"WITH {PAIRS} SELECT a_id, b_id FROM pr WHERE g1 = g2 AND e1 = e2 AND e1 <> 'news' AND hours <= 6 AND j >= 0.40 AND sh / greatest(least(na, nb), 1) >= 0.55 AND n_rare >= 2")
def republish_pairs(spark, sf_dir):
    """Pairs in which a newsroom repeats itself; a language counts as one here, as the tables' sources hardly do."""
    both = _paired(spark, sf_dir, 0.40, ("lang", "event_type"))
    return P.republished(both.withColumns({s: F.col(s).withField("source", F.col(f"{s}.lang")) for s in "ab"})).select("a_id", "b_id")


def _components(spark, sf_dir):
    return G.components(jaccard_pairs(spark, sf_dir).select("a_id", "b_id"))


COMP = f"""{PAIRS}, e AS (SELECT a_id AS a, b_id AS b FROM pr WHERE j >= 0.35 UNION SELECT b_id, a_id FROM pr WHERE j >= 0.35),
reach AS (SELECT a, a AS b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
comp AS (SELECT a AS article_id, min(b) AS component FROM reach GROUP BY a)"""


@query("story_components", f"WITH RECURSIVE {COMP} SELECT article_id, component FROM comp")
def story_components(spark, sf_dir):
    return _components(spark, sf_dir).select("article_id", "component")


def _members(spark, sf_dir):
    art = articles(spark, sf_dir).withColumn("certainty", pick(("confirmed", "probable", "weak"), F.col("doc_id")))
    return art.join(_components(spark, sf_dir), "article_id")


@query(
    "cluster_representative",
    f"""WITH RECURSIVE {COMP}, m AS (
  SELECT component, article_id, published_at, (sport <> 'unknown')::INT + (event_type <> 'news')::INT AS facts, CASE doc_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS sure FROM comp JOIN art USING (article_id))
SELECT component, first(article_id ORDER BY facts DESC, sure DESC, published_at DESC, article_id) AS representative,
  first(article_id ORDER BY published_at, article_id) AS anchor, count(*) AS n_members FROM m GROUP BY component""",
)
def cluster_representative(spark, sf_dir):
    return G.representative(_members(spark, sf_dir))


@query(
    "cluster_card",
    f"""WITH RECURSIVE {COMP}, m AS (
  SELECT component AS cluster_id, article_id, source, published_at, {LADDER} AS decision FROM comp JOIN art USING (article_id) LEFT JOIN labels USING (doc_id))
SELECT cluster_id, first(article_id ORDER BY {RANK.format('decision')} DESC, published_at DESC, article_id) AS displayed,
  first(decision ORDER BY {RANK.format('decision')} DESC, published_at DESC, article_id) AS decision, count(DISTINCT source) AS n_sources, epoch_us(max(published_at)) AS sort_us, count(*) AS n_visible
FROM m WHERE decision <> 'hidden' GROUP BY cluster_id""",
)
def cluster_card(spark, sf_dir):
    scored = _decided(spark, sf_dir).join(_components(spark, sf_dir), "article_id").withColumnRenamed("component", "cluster_id")
    return S.cards(scored).select("cluster_id", "displayed", "decision", "n_sources", _us("sort_at").alias("sort_us"), "n_visible")


@query(
    "member_overlap",
    f"""WITH RECURSIVE {COMP}, old AS (SELECT 'old_' || (doc_id % 40) AS cluster_id, article_id FROM art),
s AS (SELECT component, cluster_id, count(*) AS n FROM comp JOIN old USING (article_id) GROUP BY 1, 2)
SELECT component, first(cluster_id ORDER BY n DESC, cluster_id) AS cluster_id, max(n) AS n_shared FROM s GROUP BY component""",
)
def member_overlap(spark, sf_dir):
    old = articles(spark, sf_dir).select(F.concat(F.lit("old_"), (F.col("doc_id") % 40).cast("string")).alias("cluster_id"), "article_id")
    return G.kept_ids(_components(spark, sf_dir), old)


_IDS = f"""{PAIRS}, ed AS MATERIALIZED (
  SELECT a_id, b_id, q1 = q2 AS intra FROM pr WHERE q1 <> q2 AND j >= 0.35 OR q1 = q2 AND e1 <> 'news' AND hours <= 6 AND j >= 0.40 AND sh / greatest(least(na, nb), 1) >= 0.55 AND n_rare >= 2),
e AS (SELECT a_id AS a, b_id AS b FROM ed UNION SELECT b_id, a_id FROM ed), reach AS (SELECT a, a AS b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
mem AS MATERIALIZED (
  SELECT component, article_id, epoch_us(published_at) AS pt, room AS source, event_type, CASE WHEN sport IN ('basketball', 'football', 'tennis') THEN sport ELSE '' END AS proven, sport
  FROM (SELECT a AS article_id, min(b) AS component FROM reach GROUP BY a) JOIN tk USING (article_id))"""


def _stories_sql(rounds: int = 4, span: int = 72 * 3_600_000_000) -> str:
    """Greedy admission in SQL: the start, then one member a round."""
    agree = "({0}.proven = {1}.proven OR {0}.proven = '' OR {1}.proven = '')"
    parts = [f"""{_IDS}, ln AS MATERIALIZED (SELECT x.component, x.article_id AS a, y.article_id AS b, bool_or(intra) AS intra FROM (SELECT * FROM ed UNION ALL SELECT b_id, a_id, intra FROM ed) JOIN mem x ON x.article_id = a_id JOIN mem y ON y.article_id = b_id GROUP BY 1, 2, 3),
sd AS (SELECT ln.component, a, b FROM ln JOIN mem x ON x.article_id = a JOIN mem y ON y.article_id = b WHERE a < b QUALIFY row_number() OVER (PARTITION BY ln.component ORDER BY least(x.pt, y.pt), a, b) = 1),
st0 AS MATERIALIZED (SELECT m.*, -1::BIGINT AS lat, '' AS lid FROM sd JOIN ln USING (component, a, b) JOIN mem x ON x.article_id = a JOIN mem y ON y.article_id = b JOIN mem m ON m.article_id IN (a, b)
  WHERE x.event_type = y.event_type AND (intra OR x.source <> y.source) AND {agree.format('x', 'y')} AND abs(x.pt - y.pt) <= {span})"""]
    for k in range(rounds):
        parts.append(f"""f{k} AS (SELECT component, first(article_id ORDER BY pt, article_id) AS founder, any_value(lat) AS lat, any_value(lid) AS lid, any_value(event_type) AS event_type, count(*) AS size FROM st{k} GROUP BY component),
t{k} AS (SELECT ln.component, a, count(*) AS n, bool_or(b = founder) AS hit FROM ln JOIN st{k} s ON s.article_id = b JOIN f{k} f ON f.component = ln.component WHERE a NOT IN (SELECT article_id FROM st{k}) GROUP BY 1, 2),
p{k} AS (SELECT c.* FROM t{k} t JOIN mem c ON c.article_id = t.a JOIN f{k} f ON f.component = t.component WHERE (n >= 2 OR hit) AND (c.pt, c.article_id) > (lat, lid) AND c.event_type = f.event_type AND size < 6
  AND NOT EXISTS (SELECT 1 FROM st{k} m WHERE m.component = t.component AND (NOT {agree.format('m', 'c')} OR abs(m.pt - c.pt) > {span} OR m.source = c.source AND NOT EXISTS (SELECT 1 FROM ln i WHERE i.a = c.article_id AND i.b = m.article_id AND i.intra)))
  QUALIFY row_number() OVER (PARTITION BY c.component ORDER BY c.pt, c.article_id) = 1),
st{k + 1} AS MATERIALIZED (SELECT s.component, s.article_id, s.pt, s.source, s.event_type, s.proven, s.sport, coalesce(p.pt, s.lat) AS lat, coalesce(p.article_id, s.lid) AS lid FROM st{k} s LEFT JOIN p{k} p USING (component)
  UNION ALL SELECT component, article_id, pt, source, event_type, proven, sport, pt, article_id FROM p{k})""")
    parts.append(f"story AS MATERIALIZED (SELECT component, article_id, first_value(article_id) OVER (PARTITION BY component ORDER BY pt, article_id) AS story, sport, event_type, pt FROM st{rounds})")
    return "WITH RECURSIVE " + ",\n".join(parts)


STORIES = _stories_sql()


def _linked(spark, sf_dir):
    """Edges between newsrooms, and within one where it repeats itself, and the articles they join."""
    pairs = _paired(spark, sf_dir, 0.35, ("room", "event_type"))
    pairs = G.saved(pairs.withColumns({s: F.col(s).withField("source", F.col(f"{s}.room")) for s in "ab"}))
    across = pairs.filter(F.col("a.source") != F.col("b.source")).select("a_id", "b_id", F.lit(False).alias("intra"))
    edges = G.saved(across.unionByName(P.republished(pairs).select("a_id", "b_id", F.lit(True).alias("intra"))))
    art = articles(spark, sf_dir).withColumn("published_at", F.timestamp_micros(F.lit(1704067200000000) + F.col("doc_id") * 60000000))
    art = art.withColumn("source", F.concat(F.lit("room"), (F.col("doc_id") % 5).cast("string"))).withColumn("certainty", pick(("confirmed", "probable", "weak"), F.col("doc_id")))
    return art.join(G.components(edges), "article_id").select("component", "article_id", "published_at", "source", "event_type", "sport", "certainty", "doc_id"), edges


@query("coherent_stories", f"{STORIES} SELECT component, article_id, story FROM story")
def coherent_stories(spark, sf_dir):
    """The coherent story of each component, found in rounds over all components at once."""
    members, edges = _linked(spark, sf_dir)
    return C.coherent(members, edges)


@query("replayed_stories", f"{STORIES} SELECT article_id, story FROM story")
def replayed_stories(spark, sf_dir):
    """The same stories, from articles that come in three batches out of order, each grouped as it comes."""
    members, edges = _linked(spark, sf_dir)

    def match(new, known):
        side = lambda s: known.join(new.select("article_id", F.lit(True).alias("new")), "article_id", "left").select(F.col("article_id").alias(f"{s}_id"), F.col("new").alias(f"new_{s}"))
        return edges.join(side("a"), "a_id").join(side("b"), "b_id").filter("new_a OR new_b").select("a_id", "b_id", "intra")

    feed = StoryFeed(spark, G.shared_folder(spark), match)
    for k in range(3):
        feed.add(members.filter(F.col("doc_id") % 3 == k), k)
    return feed.stories().select("article_id", "story")


@query(
    "built_clusters",
    f"""{STORIES}, r AS (SELECT s.*, doc_id % 3 AS d, (doc_id % 2 = 0)::INT + (doc_id % 5 > 0)::INT + (s.event_type <> 'news')::INT AS facts FROM story s JOIN art USING (article_id))
SELECT story AS anchor_id, first(article_id ORDER BY facts DESC, CASE d WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END DESC, pt DESC, article_id) AS representative_id, array_to_string(list_sort(list(article_id)), ',') AS member_ids,
  any_value(event_type) AS event_state, CASE WHEN count(DISTINCT nullif(sport, 'unknown')) = 1 THEN max(nullif(sport, 'unknown')) END AS sport,
  (SELECT count(*) FROM (SELECT DISTINCT a_id, b_id FROM ed) JOIN story x ON x.article_id = a_id JOIN story y ON y.article_id = b_id WHERE x.story = r.story AND y.story = r.story) AS n_edges FROM r GROUP BY story""",
)
def built_clusters(spark, sf_dir):
    """One row per coherent story: anchor, representative, members, event, sport and the edges kept."""
    members, edges = _linked(spark, sf_dir)
    known = members.withColumn("competition", F.when(F.col("doc_id") % 5 > 0, F.lit("c"))).withColumn("n_entities", (F.col("doc_id") % 2 == 0).cast("int"))
    found = C.built(G.saved(C.coherent(members, edges)), known, edges)
    return found.withColumn("member_ids", F.array_join("member_ids", ","))


@query(
    "reconciled_clusters",
    f"""{STORIES}, old AS (SELECT 'old_' || CAST(doc_id // 40 AS VARCHAR) AS cluster_id, article_id FROM art WHERE doc_id % 3 > 0), scope AS (SELECT article_id FROM art WHERE doc_id % 7 > 0),
pr2 AS (SELECT DISTINCT story, article_id FROM story JOIN scope USING (article_id)),
bst AS (SELECT story, cluster_id FROM pr2 JOIN old USING (article_id) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY story ORDER BY count(*) DESC, cluster_id) = 1),
nm AS (SELECT article_id, coalesce(cluster_id, 'cluster_' || substr(sha1(story), 1, 16)) AS new_id, CASE WHEN cluster_id IS NULL THEN 'created' ELSE 'retained' END AS how FROM pr2 LEFT JOIN bst USING (story)),
mv AS MATERIALIZED (
  SELECT article_id, CASE WHEN new_id IS NULL AND s.article_id IS NULL THEN cluster_id ELSE new_id END AS cluster_id, CASE WHEN new_id IS NULL AND s.article_id IS NULL THEN 'kept_out_of_scope' WHEN new_id IS NULL THEN 'unclustered' ELSE how END AS change, cluster_id AS was, s.article_id IS NOT NULL AS asked
  FROM nm FULL JOIN old USING (article_id) LEFT JOIN scope s USING (article_id)),
sz AS (SELECT cluster_id FROM mv WHERE cluster_id IS NOT NULL GROUP BY 1 HAVING count(*) < 2 AND (bool_or(change <> 'kept_out_of_scope') OR cluster_id IN (SELECT was FROM mv WHERE was IS NOT NULL AND asked)))
SELECT article_id, CASE WHEN sz.cluster_id IS NULL THEN mv.cluster_id END AS cluster_id, CASE WHEN sz.cluster_id IS NOT NULL THEN 'removed' ELSE change END AS change FROM mv LEFT JOIN sz ON sz.cluster_id = mv.cluster_id""",
)
def reconciled_clusters(spark, sf_dir):
    """Memberships after a part of the articles is grouped anew over clusters that were there before."""
    members, edges = _linked(spark, sf_dir)
    art = articles(spark, sf_dir).select("article_id", "doc_id")
    scope = art.filter("doc_id % 7 > 0").select("article_id")
    proposed = C.coherent(members, edges).join(scope, "article_id", "left_semi").select("story", "article_id")
    existing = art.filter("doc_id % 3 > 0").select(F.concat(F.lit("old_"), F.floor(F.col("doc_id") / 40).cast("string")).alias("cluster_id"), "article_id")
    return C.reconciled(G.saved(proposed), existing, scope)


@query(
    "learned_features",
    """WITH e AS (SELECT user_id, 'f' || (CAST(json_extract(props, '$.k') AS INT) % 10) AS feature, CASE WHEN event_type = 'error' THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
  greatest(0, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 86400000000.0::DOUBLE) AS age FROM events WHERE event_type IN ('purchase', 'signup', 'error')),
g AS (SELECT user_id, feature, count(*) AS n_events, round_even(sum(w * pow(0.5::DOUBLE, age / 90)), 3) AS net FROM e GROUP BY 1, 2)
SELECT user_id, feature, n_events, CASE WHEN net = 0 THEN 0.0::DOUBLE ELSE net END AS net, abs(net) >= 3 AS active FROM g""",
)
def learned_features(spark, sf_dir):
    feature = F.concat(F.lit("f"), (F.get_json_object("props", "$.k").cast("int") % 10).cast("string"))
    events = read(spark, sf_dir, "events").select("user_id", feature.alias("feature"), "event_type", F.col("ts").cast("timestamp").alias("ts"))
    return L.learned_features(events, {"purchase": 1, "signup": 1, "error": -1}, LATER).select("user_id", "feature", "n_events", "net", "active")


@query(
    "authority_resolution",
    """WITH a AS (SELECT user_id, event_type AS scope, event_id % 5 AS target, event_id % 5 - 2 AS level, event_id % 3 AS o, event_id AS pos FROM events)
SELECT user_id, scope, target, level, ['explicit', 'learned', 'calibration'][o + 1] AS origin, pos
FROM a QUALIFY row_number() OVER (PARTITION BY user_id, scope, target ORDER BY o, pos DESC) = 1""",
)
def authority_resolution(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    rows = e.select("user_id", F.col("event_type").alias("scope"), (F.col("event_id") % 5).alias("target"), (F.col("event_id") % 5 - 2).alias("level"), pick(("explicit", "learned", "calibration"), F.col("event_id")).alias("origin"), F.col("event_id").alias("pos"))
    return L.effective(rows)


@query(
    "calibration_stats",
    """WITH r AS (SELECT source, CAST((doc_id * doc_id) % 5 - 2 AS INT) AS rating FROM documents),
g AS (SELECT source, count(*) AS n, avg(rating) AS mean, coalesce(stddev_samp(rating), 0) AS spread, CAST(greatest(-2, least(2, round_even(quantile_cont(rating, 0.5), 0))) AS INT) AS mid,
  count(*) FILTER (rating = -2) AS nn, count(*) FILTER (rating >= 0) AS np, count(*) FILTER (rating < 0) AS nl, count(*) FILTER (rating > 0) AS nh FROM r GROUP BY source),
s AS (SELECT *, CASE WHEN mid = -2 AND NOT (nn >= 2 AND np = 0) THEN -1 ELSE mid END AS strict FROM g)
SELECT source, n, round_even(mean, 4) AS mean, round_even(spread, 4) AS spread, n >= 2 AS enough, spread >= 1.2 AS contradictory,
  CAST(CASE WHEN nl >= 2 AND nh >= 2 AND strict > 0 THEN strict - 1 WHEN nl >= 2 AND nh >= 2 AND strict < 0 THEN strict + 1 ELSE strict END AS INT) AS level FROM s""",
)
def calibration_stats(spark, sf_dir):
    return L.calibration_stats(read(spark, sf_dir, "documents").select("source", ((F.col("doc_id") * F.col("doc_id")) % 5 - 2).cast("int").alias("rating")), ["source"])


@query(
    "event_delta",
    f"""WITH {ART}, r AS (SELECT lang, event_type, greatest(-2, least(2, doc_id % 6 - 3)) AS rating FROM art), s AS (SELECT lang, avg(rating) AS m FROM r GROUP BY lang),
k AS (SELECT lang, event_type, avg(rating) AS m, count(*) AS n FROM r GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT k.lang, event_type, n, CAST(greatest(-2, least(2, round_even(round_even(k.m - s.m, 9), 0))) AS INT) AS delta FROM k JOIN s USING (lang) WHERE greatest(-2, least(2, round_even(round_even(k.m - s.m, 9), 0))) <> 0""",
)
def event_delta(spark, sf_dir):
    rated = articles(spark, sf_dir).select("lang", "event_type", F.greatest(F.lit(-2), F.least(F.lit(2), F.col("doc_id") % 6 - 3)).alias("rating"))
    return L.event_deltas(rated, "lang", "event_type")


@query(
    "participant_intersection",
    """WITH own AS (SELECT DISTINCT l_orderkey AS article_id, l_partkey % 2000 AS entity FROM lineitem),
mem AS (SELECT DISTINCT p_partkey % 2000 AS entity, p_size % 3 AS competition FROM part),
z AS (SELECT article_id, count(*) AS n FROM own GROUP BY 1 HAVING count(*) >= 2), c AS (SELECT article_id, competition FROM own JOIN mem USING (entity) JOIN z USING (article_id) GROUP BY article_id, competition, z.n HAVING count(*) = z.n)
SELECT article_id, min(competition) AS competition FROM c GROUP BY article_id HAVING count(*) = 1""",
)
def participant_intersection(spark, sf_dir):
    own = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("article_id"), (F.col("l_partkey") % 2000).alias("entity"))
    members = read(spark, sf_dir, "part").select((F.col("p_partkey") % 2000).alias("entity"), (F.col("p_size") % 3).alias("competition"))
    return L.participants(own, members)


@query(
    "quality_breakdown",
    """WITH d AS (SELECT lang, source, coalesce(CAST(quality AS VARCHAR), 'unknown') AS quality, coalesce(CAST(toxic AS VARCHAR), 'unknown') AS toxic FROM documents LEFT JOIN labels USING (doc_id)), u AS (
  SELECT 'lang' AS dim, coalesce(lang, 'unknown') AS value FROM d UNION ALL SELECT 'source', coalesce(source, 'unknown') FROM d UNION ALL SELECT 'quality', quality FROM d UNION ALL SELECT 'toxic', toxic FROM d)
SELECT dim, value, count(*) AS n FROM u GROUP BY 1, 2""",
)
def quality_breakdown(spark, sf_dir):
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    return M.breakdowns(d, ["lang", "source", "quality", "toxic"])


@query(
    "run_metrics",
    """SELECT user_id, count(*) AS n_runs, count(*) FILTER (event_type = 'error') AS n_failed, round_even(count(*) FILTER (event_type = 'error') / count(*), 4) AS failure_rate,
  round(avg(value), 1) AS mean, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY user_id""",
)
def run_metrics(spark, sf_dir):
    return M.run_metrics(read(spark, sf_dir, "events"), ["user_id"], F.col("event_type") != "error", "value")


@query("latency_p95", "SELECT event_type, count(*) AS n, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type")
def latency_p95(spark, sf_dir):
    return M.run_metrics(read(spark, sf_dir, "events"), ["event_type"], F.lit(True), "value").select("event_type", F.col("n_runs").alias("n"), "p95")


@query("latest_run_per_user", "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_run_per_user(spark, sf_dir):
    return M.latest(read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type", "value")


@query(
    "failure_streak",
    """WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events QUALIFY k <= 20)
SELECT user_id, coalesce(min(k) FILTER (event_type NOT IN ('error', 'view')), max(k) + 1) - 1 AS streak FROM r GROUP BY user_id""",
)
def failure_streak(spark, sf_dir):
    return M.failure_streak(read(spark, sf_dir, "events"), "user_id", "ts", "event_id", F.col("event_type").isin("error", "view"))


@query(
    "retention_plan",
    f"""WITH {ART}, c AS (SELECT article_id, doc_id, doc_id // 60 AS cluster_id, published_at >= TIMESTAMP '2024-01-15' - INTERVAL 14 DAYS AND doc_id % 60 <> 7 AS f, published_at FROM art),
d AS (SELECT article_id, doc_id, cluster_id, CASE WHEN doc_id % 60 = 7 THEN published_at - INTERVAL 60 DAYS ELSE published_at - INTERVAL 10 DAYS END AS p FROM c),
live AS (SELECT DISTINCT cluster_id FROM d WHERE p >= TIMESTAMP '2024-01-15' - INTERVAL 14 DAYS), used AS (SELECT doc_id FROM labels WHERE toxic = 1)
SELECT article_id, CASE WHEN p >= TIMESTAMP '2024-01-15' - INTERVAL 14 DAYS THEN 'fresh' WHEN live.cluster_id IS NOT NULL THEN 'live_cluster' WHEN used.doc_id IS NOT NULL THEN 'feedback' END AS retained_because
FROM d LEFT JOIN live USING (cluster_id) LEFT JOIN used USING (doc_id)""",
)
def retention_plan(spark, sf_dir):
    art = articles(spark, sf_dir)
    back = F.when(F.col("doc_id") % 60 == 7, F.expr("INTERVAL 60 DAYS")).otherwise(F.expr("INTERVAL 10 DAYS"))
    art = art.withColumn("published_at", F.col("published_at") - back)
    members = art.select("article_id", F.floor(F.col("doc_id") / 60).alias("cluster_id"))
    used = art.join(read(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id"), "doc_id", "left_semi")
    return A.retention(art, members, used, datetime(2024, 1, 15, tzinfo=timezone.utc), 14).select("article_id", "retained_because")


@query(
    "outbox_new_stories",
    """WITH s AS (SELECT 's' || doc_id AS story_id, doc_id AS first_at, unnest(range(doc_id, doc_id + 6)) AS article_id FROM documents), told AS (SELECT doc_id FROM labels WHERE toxic = 1),
gone AS (SELECT DISTINCT story_id FROM s JOIN told ON article_id = doc_id), n AS (SELECT * FROM s WHERE story_id NOT IN (SELECT story_id FROM gone)),
f AS (SELECT article_id, min({'a': first_at, 'b': story_id}).b AS winner FROM n GROUP BY article_id), lose AS (SELECT DISTINCT story_id FROM n JOIN f USING (article_id) WHERE winner <> story_id)
SELECT DISTINCT story_id FROM n WHERE story_id NOT IN (SELECT story_id FROM lose)""",
)
def outbox_new_stories(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    stories = d.select(F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("story_id"), F.col("doc_id").alias("first_at"), F.sequence(F.col("doc_id"), F.col("doc_id") + 5).alias("members"))
    told = read(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").alias("article_id"))
    return A.plan_stories(stories, told).select("story_id")


@query(
    "dismissed_antijoin",
    "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT event_id FROM events WHERE event_type IN ('error', 'view') AND event_id % 7 <> 0)",
)
def dismissed_antijoin(spark, sf_dir):
    feedback = read(spark, sf_dir, "events").select(F.col("event_id").alias("article_id"), F.col("event_type").alias("action"), (F.col("event_id") % 7 == 0).alias("retracted"))
    art = read(spark, sf_dir, "documents").withColumn("article_id", F.col("doc_id"))
    return A.without_dismissed(art, feedback, ("error", "view")).select("doc_id")


_IMPORTANCE = ("very_high", "high", "medium", "low")
_NEW = """CASE WHEN i = 0 AND p >= 80 THEN 'high_feed' WHEN i = 1 AND p >= 80 THEN 'feed' WHEN i = 2 AND p >= 70 THEN 'feed' WHEN i = 1 THEN 'feed' WHEN i = 2 THEN 'low_feed' WHEN i = 3 AND p >= 70 THEN 'low_feed' ELSE 'hidden' END"""


def _both(spark, sf_dir):
    d = _decided(spark, sf_dir)
    return d.select("article_id", F.col("decision").alias("old"), S.importance_decision(pick(_IMPORTANCE, F.col("doc_id")), F.col("doc_id") * 7 % 100).alias("new"))


_BOTH = f"{ART}, b AS (SELECT article_id, {LADDER} AS old, {_NEW} AS new FROM (SELECT *, doc_id % 4 AS i, doc_id * 7 % 100 AS p FROM art LEFT JOIN labels USING (doc_id)))"


@query(
    "shadow_report",
    f"""WITH {_BOTH}, r AS (SELECT *, {RANK.format('old')} AS o, {RANK.format('new')} AS w FROM b)
SELECT count(*) AS n, count(*) FILTER (o = w) AS n_same, round_even(count(*) FILTER (o = w) / count(*), 4) AS same_rate, count(*) FILTER (w > o) AS n_promoted, count(*) FILTER (w < o) AS n_demoted,
  count(*) FILTER (old = 'high_feed') AS n_high_old, count(*) FILTER (new = 'high_feed') AS n_high_new FROM r""",
)
def shadow_report(spark, sf_dir):
    return S.shadow_report(_both(spark, sf_dir))


@query("before_after_diff", f"WITH {_BOTH} SELECT article_id, old AS before, CASE WHEN new <> 'hidden' THEN new END AS after, CASE WHEN new = 'hidden' THEN 'removed' ELSE 'changed' END AS change FROM b WHERE old IS DISTINCT FROM CASE WHEN new <> 'hidden' THEN new END")
def before_after_diff(spark, sf_dir):
    both = _both(spark, sf_dir)
    return S.snapshot_diff(both.select("article_id", F.col("old").alias("decision")), both.filter("new <> 'hidden'").select("article_id", F.col("new").alias("decision")), "article_id", "decision")


_AFF = """aff AS (SELECT c_custkey % 40 AS user_id, ['sport', 'competition', 'team'][c_custkey % 3 + 1] AS scope,
  CASE c_custkey % 3 WHEN 0 THEN ['football', 'basketball', 'tennis', 'unknown'][c_custkey % 4 + 1] WHEN 1 THEN 'comp' || (c_custkey % 7) ELSE 'team' || (c_custkey % 11) END AS target, c_nationkey % 5 - 2 AS level
  FROM customer QUALIFY row_number() OVER (PARTITION BY 1, 2, 3 ORDER BY c_custkey DESC) = 1)""".replace("PARTITION BY 1, 2, 3", "PARTITION BY user_id, scope, target")


@query(
    "affinity_decisions",
    f"""WITH {ART}, {_AFF}, k AS (
  SELECT article_id, 'sport' AS scope, sport AS target, 1 AS narrow FROM art UNION ALL SELECT article_id, 'competition', 'comp' || (doc_id % 7), 2 FROM art UNION ALL SELECT article_id, 'team', 'team' || (doc_id % 11), 3 FROM art),
m AS (SELECT *, CASE WHEN level >= 0 THEN level + 1 ELSE 0 END AS points FROM aff JOIN k USING (scope, target)),
g AS (SELECT user_id, article_id, max({{'p': points, 'b': -narrow}}) FILTER (level > -2) AS best, max(narrow) FILTER (level = -2) AS ex, max(narrow) FILTER (level > -2) AS al, bool_or(scope = 'team' AND level >= 1) AS fo FROM m GROUP BY 1, 2),
s AS (SELECT user_id, article_id, CAST(CASE WHEN ex IS NOT NULL AND coalesce(al, 0) <= ex THEN 0 ELSE coalesce(best.p, 0) + CASE WHEN fo AND best.b > -3 THEN 1 ELSE 0 END END AS INT) AS score FROM g)
SELECT *, CASE WHEN score <= 0 THEN 'hidden' WHEN score = 1 THEN 'low_feed' WHEN score = 2 THEN 'feed' ELSE 'high_feed' END AS decision FROM s""",
)
def affinity_decisions(spark, sf_dir):
    c = F.col("c_custkey")
    target = F.when(c % 3 == 0, pick(SPORTS, c)).when(c % 3 == 1, F.concat(F.lit("comp"), (c % 7).cast("string"))).otherwise(F.concat(F.lit("team"), (c % 11).cast("string")))
    rows = read(spark, sf_dir, "customer").select((c % 40).alias("user_id"), pick(("sport", "competition", "team"), c).alias("scope"), target.alias("target"), (F.col("c_nationkey") % 5 - 2).alias("level"), F.lit("explicit").alias("origin"), c.alias("pos"))
    art = articles(spark, sf_dir).select("article_id", "sport", F.concat(F.lit("comp"), (F.col("doc_id") % 7).cast("string")).alias("competition"), F.concat(F.lit("team"), (F.col("doc_id") % 11).cast("string")).alias("entity"))
    return S.affinity_decision(art, L.effective(rows).select("user_id", "scope", "target", "level"))


@query(
    "catalog_search_topk",
    """SELECT kind, id, name FROM (SELECT 0 AS o, 'region' AS kind, CAST(r_regionkey AS BIGINT) AS id, r_name AS name FROM region UNION ALL SELECT 1, 'nation', n_nationkey, n_name FROM nation
  UNION ALL SELECT 2, 'supplier', s_suppkey, s_name FROM supplier) WHERE contains(lower(name), 'a') ORDER BY o, name, id LIMIT 12""",
)
def catalog_search_topk(spark, sf_dir):
    parts = [read(spark, sf_dir, t).select(F.lit(i).alias("o"), F.lit(t).alias("kind"), F.col(k).cast("long").alias("id"), F.col(n).alias("name")) for i, (t, k, n) in enumerate((("region", "r_regionkey", "r_name"), ("nation", "n_nationkey", "n_name"), ("supplier", "s_suppkey", "s_name")))]
    found = parts[0].unionByName(parts[1]).unionByName(parts[2]).filter(F.lower("name").contains("a"))
    return found.orderBy("o", "name", "id").limit(12).select("kind", "id", "name")


@query(
    "age_histogram",
    f"WITH {ART}, h AS (SELECT (epoch_us(TIMESTAMP '2024-01-05') - epoch_us(published_at)) / 3600000000.0 AS h FROM art) SELECT CASE WHEN h < 0 THEN 'future' WHEN h <= 12 THEN '0-12' WHEN h <= 24 THEN '12-24' WHEN h <= 36 THEN '24-36' ELSE '>36' END AS age, count(*) AS n FROM h GROUP BY 1",
)
def age_histogram(spark, sf_dir):
    return M.age_histogram(articles(spark, sf_dir), hours_between(F.lit(NOW), F.col("published_at")))


@query(
    "clean_html_title",
    r"""SELECT page_id, substr(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[ \t\r\n]+', ' ', 'g')), 1, 240) AS visible FROM pages""",
)
def clean_html_title(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", clean_html(F.col("html")).alias("visible"))


@query(
    "truth_pair_confusion",
    f"""WITH {PAIRS}, said AS (SELECT a_id, b_id FROM pr WHERE j >= 0.35), truth AS (
  SELECT a.article_id AS a_id, b.article_id AS b_id FROM art a JOIN art b ON a.text = b.text AND a.article_id < b.article_id)
SELECT count(*) FILTER (s.a_id IS NOT NULL AND t.a_id IS NOT NULL) AS tp, count(*) FILTER (t.a_id IS NULL) AS fp, count(*) FILTER (s.a_id IS NULL) AS fn
FROM said s FULL JOIN truth t ON s.a_id = t.a_id AND s.b_id = t.b_id""",
)
def truth_pair_confusion(spark, sf_dir):
    art = articles(spark, sf_dir).select("article_id", F.sha1("text").alias("h"))
    return M.copy_confusion(jaccard_pairs(spark, sf_dir), art)


@query("story_ids", "SELECT doc_id, 'rss_' || substr(sha1('https://news.example/' || source || '/' || doc_id), 1, 20) AS article_id FROM documents")
def story_ids(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", story_id(F.concat(F.lit("https://news.example/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"))).alias("article_id"))
