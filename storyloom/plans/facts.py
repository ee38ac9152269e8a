"""Queries of classification, evidence, topics and preferences.  Word tables are of the provided texts' words."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import DECISIONS, exact_sum
from ..operators import facts as E
from ..operators import preferences as W
from ..operators import similarity as P
from ..operators import topics as T
from ..operators.graph import saved
from ..sources.tables import articles, pick, read
from .registry import ART, RANK, query



def _word(w: str) -> str:
    return rf"(^|[^\p{{L}}]){w}($|[^\p{{L}}])"


SPORTS = (
    E.WordRule("basketball", (_word("the") + ".*" + _word("of"),), (_word("live"),)), E.WordRule("football", (_word("der"), _word("die"))),
    E.WordRule("tennis", (_word("que"), _word("les?"))), E.WordRule("chess", (E.whole_word("שחמט"),)),
)
LEAGUES = {"basketball": (E.WordRule("EuroLeague", (_word("and"),)), E.WordRule("NBA", (_word("to"),))), "football": (E.WordRule("Bundesliga", (_word("und"),)),)}
EVENTS = (E.WordRule("signing", (_word("in"),), (_word("was"),)), E.WordRule("injury", (_word("des"), _word("with"))), E.WordRule("title_win", (_word("is"), _word("la"))))
VALID = {"title_win": ("basketball", "tennis"), "signing": ("basketball", "football", "unknown")}


def _holds(r, of: str) -> str:
    parts = ["(" + " OR ".join(f"regexp_matches({of}, '{p}')" for p in r.patterns) + ")"] + [f"NOT regexp_matches({of}, '{p}')" for p in r.unless]
    return " AND ".join(parts)


def _case(rules, of: str) -> str:
    return "CASE " + " ".join(f"WHEN {_holds(r, of)} THEN '{r.name}'" for r in rules) + " END"


def _leagues(of: str) -> str:
    return "CASE " + " ".join(f"WHEN sport = '{s}' THEN {_case(r, of)}" for s, r in LEAGUES.items()) + " END"


def _event(of: str) -> str:
    fits = {e: f" AND sport IN ({', '.join(repr(s) for s in v)})" for e, v in VALID.items()}
    return "CASE " + " ".join(f"WHEN {_holds(r, of)}{fits.get(r.name, '')} THEN '{r.name}'" for r in EVENTS) + " END"


CLASSIFIED = f"""{ART}, lw AS (SELECT doc_id, article_id, source, url, lower(title) AS t, lower(substr(text, 81, 240)) AS s FROM art),
sp AS (SELECT *, coalesce({_case(SPORTS, 't')}, {_case(SPORTS, 's')}, 'unknown') AS sport FROM lw),
lg AS (SELECT *, coalesce({_leagues('t')}, {_leagues('s')}) AS league, {_event('t')} AS te, {_event('s')} AS se FROM sp),
cs AS (SELECT doc_id, article_id, source, url, sport, league, coalesce(te, se, 'news') AS event_type, CASE WHEN te IS NOT NULL THEN 'confirmed' WHEN se IS NOT NULL THEN 'probable' ELSE 'weak' END AS certainty, te IS NULL AND se IS NOT NULL AS from_subtitle FROM lg)"""


def _classified(spark, sf_dir):
    return E.classified(articles(spark, sf_dir).drop("sport", "event_type"), SPORTS, LEAGUES, EVENTS, VALID)


@query("classified", f"WITH {CLASSIFIED} SELECT article_id, sport, league, event_type, certainty, from_subtitle FROM cs")
def classified(spark, sf_dir):
    return _classified(spark, sf_dir).select("article_id", "sport", "league", "event_type", "certainty", "from_subtitle")


@query("league_sport", f"WITH {CLASSIFIED} SELECT article_id, CASE league WHEN 'NBA' THEN 'basketball' WHEN 'Bundesliga' THEN 'football' WHEN 'EuroLeague' THEN 'handball' ELSE sport END AS sport FROM cs")
def league_sport(spark, sf_dir):
    return E.with_league_sport(_classified(spark, sf_dir), {"NBA": "basketball", "Bundesliga": "football", "EuroLeague": "handball"}).select("article_id", "sport")


@query(
    "validated_event",
    f"""WITH {CLASSIFIED} SELECT article_id, from_subtitle AND event_type IN ('title_win', 'injury') AS demoted, CASE WHEN from_subtitle AND event_type IN ('title_win', 'injury') THEN 'news' ELSE event_type END AS event_type,
  CASE WHEN from_subtitle AND event_type IN ('title_win', 'injury') THEN 'weak' ELSE certainty END AS certainty, CASE WHEN from_subtitle AND event_type IN ('title_win', 'injury') THEN 'low' WHEN league IS NULL THEN 'medium' ELSE 'high' END AS importance FROM cs""",
)
def validated_event(spark, sf_dir):
    df = _classified(spark, sf_dir).withColumn("importance", F.when(F.col("league").isNull(), "medium").otherwise("high"))
    return E.validated_event(df, ("title_win", "injury")).select("article_id", "demoted", "event_type", "certainty", "importance")


NAMES = {"comp:a": ("the", "of the"), "comp:b": ("and the", "and"), "comp:c": ("th", "in the"), "comp:d": ("que", "der")}
_NAMES = sorted(((i, n) for i, ns in NAMES.items() for n in ns), key=lambda p: (-len(p[1]), p[1]))


@query(
    "competitions_named",
    f"""WITH RECURSIVE {ART}, nm(k, id, name) AS (VALUES {', '.join(f"({k}, '{i}', '{n}')" for k, (i, n) in enumerate(_NAMES))}),
st AS (SELECT article_id, 0 AS k, lower(title) AS rest, NULL::VARCHAR AS id, 0 AS pos FROM art
  UNION ALL SELECT article_id, st.k + 1, replace(rest, name, repeat(chr(1), length(name))), nm.id, instr(rest, name) FROM st JOIN nm ON nm.k = st.k),
f AS (SELECT article_id, id, first(pos ORDER BY k) AS pos FROM st WHERE pos > 0 GROUP BY 1, 2)
SELECT article_id, coalesce(string_agg(id, ',' ORDER BY pos, id), '') AS named FROM art LEFT JOIN f USING (article_id) GROUP BY 1""",
)
def competitions_named(spark, sf_dir):
    return articles(spark, sf_dir).select("article_id", F.array_join(E.competitions_named(F.col("title"), NAMES), ",").alias("named"))


_COMP_SPORT = {"comp:a": "basketball", "comp:b": "football", "comp:c": "basketball", "comp:d": "tennis"}
_HOLD = lambda col: ", ".join(f"CASE WHEN {_holds(r, col)} THEN '{r.name}' END" for r in SPORTS)


@query(
    "resolved_sport",
    f"""WITH {ART}, a AS (SELECT article_id, doc_id, lower(title) AS t, lower(substr(text, 81, 240)) AS s, sport AS cur, source FROM art),
e AS (
  SELECT article_id, 100 AS w, 'source_url_hint' AS src, 'tennis' AS sp, 0 AS o FROM a WHERE source = 'src1'
  UNION ALL SELECT article_id, 100, 'basketball_only_source', 'basketball', 1 FROM a WHERE source IN ('src1', 'src2')
  UNION ALL SELECT article_id, 80, 'title_keyword', sp, 2 FROM (SELECT article_id, unnest([{_HOLD('t')}]) AS sp FROM a) WHERE sp IS NOT NULL
  UNION ALL SELECT article_id, 60, 'subtitle_keyword', sp, 3 FROM (SELECT article_id, unnest([{_HOLD('s')}]) AS sp FROM a) WHERE sp IS NOT NULL
  UNION ALL SELECT article_id, 40, 'entity_derived', 'football', 5 FROM a WHERE doc_id % 3 = 0
  UNION ALL SELECT article_id, 20, 'llm', 'basketball', 6 FROM a WHERE doc_id % 2 = 0),
x AS (SELECT *, src NOT IN ('entity_derived', 'llm') AS ex FROM e),
g AS (SELECT article_id, count(*) FILTER (ex) AS n_ex, max(w) FILTER (ex) AS top, count(DISTINCT sp) AS n_sp FROM x GROUP BY 1),
tp AS (SELECT x.article_id, list_sort(list(DISTINCT sp)) AS tops FROM x JOIN g USING (article_id) WHERE ex AND w = top GROUP BY 1),
own AS (SELECT x.article_id, first(src ORDER BY w DESC, o) AS any_src, first(src ORDER BY w DESC, o) FILTER (ex) AS ex_src FROM x JOIN a USING (article_id) WHERE sp = cur GROUP BY 1),
r AS (SELECT article_id, cur, coalesce(n_ex, 0) AS n_ex, coalesce(n_sp, 0) > 1 AS several, tops, any_src, ex_src FROM a LEFT JOIN g USING (article_id) LEFT JOIN tp USING (article_id) LEFT JOIN own USING (article_id))
SELECT article_id, CASE WHEN n_ex = 0 THEN cur WHEN len(tops) > 1 AND list_contains(tops, cur) THEN cur WHEN len(tops) > 1 THEN 'unknown' ELSE tops[1] END AS sport,
  CASE WHEN n_ex = 0 THEN CASE WHEN several AND cur <> 'unknown' THEN coalesce(any_src || '_outweighs', 'weighted_evidence') END WHEN len(tops) > 1 AND list_contains(tops, cur) THEN 'equal_weight_tie_kept'
    WHEN len(tops) > 1 THEN 'equal_weight_tie_abstain' WHEN tops[1] <> cur THEN 'weighted_evidence_override' WHEN several THEN ex_src || '_outweighs' END AS rule FROM r""",
)
def resolved_sport(spark, sf_dir):
    a = articles(spark, sf_dir)
    none = F.array().cast("array<string>")
    found = E.evidence(
        F.when(F.col("source") == "src1", F.lit("tennis")), F.col("source").isin("src1", "src2"), E.proposals(F.col("title"), SPORTS), E.proposals(F.col("subtitle"), SPORTS), none,
        F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("football"))).otherwise(none), F.when(F.col("doc_id") % 2 == 0, F.lit("basketball")),
    )
    return a.withColumn("found", found).select("article_id", E.resolved_sport(F.col("found"), F.col("sport")).alias("r")).select("article_id", "r.sport", "r.rule")


@query(
    "agreed_league",
    "WITH m AS (SELECT DISTINCT l_orderkey AS article_id, s_nationkey AS league FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_acctbal > 0) SELECT article_id, min(league) AS league FROM m GROUP BY 1 HAVING count(*) = 1",
)
def agreed_league(spark, sf_dir):
    own = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("article_id"), F.col("l_suppkey").alias("entity"))
    return E.agreed_league(own, read(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("entity"), F.col("s_nationkey").alias("league")))


@query("hinted_sport", f"WITH {ART} SELECT article_id, CASE WHEN source = 'src1' AND contains(url, '/1') THEN 'football' WHEN source = 'src1' AND contains(url, '5') THEN 'tennis' WHEN source = 'src2' AND contains(url, '7') THEN 'basketball' END AS hint FROM art")
def hinted_sport(spark, sf_dir):
    return articles(spark, sf_dir).select("article_id", E.hinted_sport(F.col("source"), F.col("url"), {"src1": {"/1": "football", "5": "tennis"}, "src2": {"7": "basketball"}}).alias("hint"))


@query(
    "pruned_entities",
    f"""WITH {ART}, k AS (SELECT *, doc_id // 4 % 3 AS k FROM art) SELECT article_id, array_to_string(list_filter(CASE k WHEN 0 THEN ['club0', 'player'] WHEN 1 THEN ['club1', 'player', 'club0'] ELSE ['player', 'club1'] END, lambda x: NOT (sport <> 'basketball' AND x = 'club0') AND NOT (sport <> 'football' AND x = 'club1')), ',') AS entities FROM k""",
)
def pruned_entities(spark, sf_dir):
    k = F.floor(F.col("doc_id") / 4) % 3
    lists = F.when(k == 0, F.array(F.lit("club0"), F.lit("player"), F.lit("club0"))).when(k == 1, F.array(F.lit("club1"), F.lit("player"), F.lit("club0"))).otherwise(F.array(F.lit("player"), F.lit("club1")))
    return articles(spark, sf_dir).select("article_id", F.array_join(E.pruned(lists, F.col("sport"), {"club0": "basketball", "club1": "football"}), ",").alias("entities"))


def _raw(sport, event, confidence):
    return F.concat(F.lit('Sure: {"sport": "'), sport, F.lit('", "event_type": "'), event, F.lit('", "confidence": '), confidence.cast("string"), F.lit(', "entities": ["x", "y", "z"], "importance": "high", "note": {"a": 1}, "reason:": "because it says so"} or {"sport": "tennis"}'))


@query(
    "parsed_proposal",
    f"""WITH {ART} SELECT article_id, CASE WHEN doc_id % 5 <> 0 THEN CASE WHEN doc_id % 4 = 3 THEN 'unknown' ELSE sport END END AS sport, CASE WHEN doc_id % 5 <> 0 THEN CASE WHEN event_type IN ('signing', 'injury') THEN event_type ELSE 'news' END END AS event_type,
  CASE WHEN doc_id % 5 <> 0 THEN CASE WHEN doc_id % 15 <= 10 THEN (doc_id % 15) / 10.0 ELSE 0 END END::DOUBLE AS confidence, CASE WHEN doc_id % 5 <> 0 THEN 'x,y' END AS entities, CASE WHEN doc_id % 5 <> 0 THEN 'high' END AS importance, CASE WHEN doc_id % 5 <> 0 THEN 'because' END AS reason FROM art""",
)
def parsed_proposal(spark, sf_dir):
    sport = F.when(F.col("doc_id") % 4 == 3, "curling").otherwise(F.col("sport"))
    raw = F.when(F.col("doc_id") % 5 != 0, _raw(sport, F.col("event_type"), (F.col("doc_id") % 15) / 10)).when(F.col("doc_id") % 10 == 0, "no object { here")
    said = E.parsed_proposal(raw, ("football", "basketball", "tennis"), ("signing", "injury"), 2, 7)
    return articles(spark, sf_dir).select("article_id", said.alias("s")).select("article_id", "s.sport", "s.event_type", "s.confidence", F.array_join("s.entities", ",").alias("entities"), "s.importance", "s.reason")


_LEAGUE_SPORT = {"NBA": "basketball", "EuroLeague": "basketball", "Bundesliga": "football"}
_RANK = "coalesce(list_position(['low', 'medium', 'high', 'very_high'], {}), 0)"


@query(
    "guarded_answers",
    f"""WITH {CLASSIFIED}, m AS (
  SELECT *, CASE WHEN doc_id % 7 <> 0 THEN (doc_id % 10 + 3) / 10.0 END AS conf, ['football', 'basketball', 'unknown'][1 + doc_id % 3] AS s0, CASE WHEN doc_id % 4 = 0 THEN 'NBA' WHEN doc_id % 4 = 1 THEN 'Bundesliga' END AS l0, ['news', 'signing', 'injury'][1 + doc_id // 3 % 3] AS e0, ['low', 'medium', 'high'][1 + doc_id % 3] AS i0,
    CASE WHEN league IS NULL THEN 'low' ELSE 'very_high' END AS imp, doc_id % 11 = 0 AS uns, doc_id % 5 = 0 AS club, CASE WHEN doc_id % 6 = 0 THEN 'basketball' WHEN doc_id % 6 = 1 THEN 'football' END AS com, CASE WHEN doc_id % 9 = 0 THEN 'tennis' WHEN doc_id % 9 = 1 THEN 'basketball' END AS hint,
    CASE WHEN doc_id % 8 < 4 THEN 'probable' END AS b_sig, CASE WHEN event_type = 'injury' THEN 'weak' END AS b_inj FROM cs),
g0 AS (SELECT *, CASE WHEN uns THEN NULL ELSE l0 END AS l1, CASE WHEN uns THEN 'unknown' ELSE s0 END AS s1, CASE WHEN uns AND s0 <> 'unknown' THEN ['unsupported'] ELSE [] END AS t1 FROM m),
g1 AS (SELECT *, NOT uns AND club AND s1 <> 'football' AS f FROM g0), g2 AS (SELECT *, CASE WHEN f THEN 'football' ELSE s1 END AS s2, CASE WHEN f THEN league ELSE l1 END AS l2, CASE WHEN f THEN t1 || ['football_club'] ELSE t1 END AS t2 FROM g1),
g3 AS (SELECT * EXCLUDE (f), coalesce(s2 <> 'unknown' AND com <> s2, false) AS f FROM g2), g4 AS (SELECT *, CASE WHEN f THEN com ELSE s2 END AS s3, CASE WHEN NOT f THEN l2 WHEN sport = com THEN league END AS l3, CASE WHEN f THEN t2 || ['committed'] ELSE t2 END AS t3 FROM g3),
g5 AS (SELECT *, CASE WHEN s3 = 'unknown' AND sport <> 'unknown' AND NOT uns THEN sport ELSE s3 END AS s4, CASE WHEN s3 = 'unknown' AND sport <> 'unknown' AND NOT uns THEN t3 || ['rules_sport'] ELSE t3 END AS t4 FROM g4),
g6 AS (SELECT *, coalesce(l3, league) AS l4, CASE WHEN l3 IS NULL AND league IS NOT NULL THEN t4 || ['rules_league'] ELSE t4 END AS t5, CASE WHEN e0 = 'news' THEN event_type ELSE e0 END AS e1 FROM g5),
g7 AS (SELECT *, CASE WHEN e0 = 'news' AND event_type <> 'news' THEN t5 || ['rules_event'] ELSE t5 END AS t6, CASE e1 WHEN 'signing' THEN b_sig WHEN 'injury' THEN b_inj WHEN 'news' THEN 'confirmed' END AS b1, CASE event_type WHEN 'signing' THEN b_sig WHEN 'injury' THEN b_inj END AS br FROM g6),
g8 AS (SELECT *, CASE WHEN b1 IS NOT NULL THEN e1 WHEN event_type <> e1 AND br IS NOT NULL THEN event_type ELSE 'news' END AS e2, CASE WHEN b1 IS NULL THEN t6 || ['evidence'] ELSE t6 END AS t7 FROM g7),
g9 AS (SELECT *, CASE WHEN b1 IS NULL THEN CASE WHEN e2 = 'news' THEN 'confirmed' ELSE br END WHEN e2 = event_type OR e2 = 'news' THEN 'confirmed' ELSE b1 END AS c2, CASE WHEN {_RANK.format('i0')} < {_RANK.format('imp')} THEN imp ELSE i0 END AS i1, CASE WHEN {_RANK.format('i0')} < {_RANK.format('imp')} THEN t7 || ['importance'] ELSE t7 END AS t8,
  CASE l4 WHEN 'NBA' THEN 'basketball' WHEN 'EuroLeague' THEN 'basketball' WHEN 'Bundesliga' THEN 'football' END AS ls FROM g8),
g10 AS (SELECT *, CASE WHEN ls <> s4 THEN ls ELSE s4 END AS s5, CASE WHEN ls <> s4 THEN t8 || ['league_sport'] ELSE t8 END AS t9 FROM g9), g11 AS (SELECT * EXCLUDE (f), coalesce(hint <> s5 AND NOT uns AND (com IS NULL OR com = hint), false) AS f FROM g10),
g12 AS (SELECT *, CASE WHEN f THEN hint ELSE s5 END AS s6, CASE WHEN f THEN t9 || ['hint'] ELSE t9 END AS t10, coalesce(conf >= 0.65, false) AS used FROM g11)
SELECT article_id, CASE WHEN used THEN s6 ELSE sport END AS final_sport, CASE WHEN used THEN l4 ELSE league END AS final_league, CASE WHEN used THEN e2 ELSE event_type END AS final_event, CASE WHEN used THEN c2 ELSE certainty END AS final_certainty, CASE WHEN used THEN i1 ELSE imp END AS final_importance,
  CASE WHEN NOT used THEN 'rules' WHEN len(t10) > 0 THEN 'model_guarded' ELSE 'model' END AS classified_by, CASE WHEN used THEN array_to_string(t10, ',') ELSE '' END AS guards FROM g12""",
)
def guarded_answers(spark, sf_dir):
    """A model's answers, corrected by what the texts prove."""
    i = F.col("doc_id")
    said = F.when(i % 7 != 0, F.struct(
        pick(("football", "basketball", "unknown"), i).alias("sport"), F.when(i % 4 == 0, "NBA").when(i % 4 == 1, "Bundesliga").alias("league"), pick(("news", "signing", "injury"), F.floor(i / 3)).alias("event_type"), pick(("low", "medium", "high"), i).alias("importance"), ((i % 10 + 3) / 10).alias("confidence"),
    ))
    bears = lambda event, certainty, holds: F.when(holds, F.struct(F.lit(event).alias("event"), F.lit(certainty).alias("certainty")))
    df = _classified(spark, sf_dir).withColumns({
        "said": said, "importance": F.when(F.col("league").isNull(), "low").otherwise("very_high"), "unsupported": i % 11 == 0, "football_club": i % 5 == 0, "committed": F.when(i % 6 == 0, "basketball").when(i % 6 == 1, "football"),
        "hint": F.when(i % 9 == 0, "tennis").when(i % 9 == 1, "basketball"), "borne": F.array_compact(F.array(bears("signing", "probable", i % 8 < 4), bears("injury", "weak", F.col("event_type") == "injury"))),
    })
    found = E.guarded(df, _LEAGUE_SPORT)
    return found.select("article_id", *[f"final_{k}" for k in ("sport", "league", "event", "certainty", "importance")], "classified_by", F.array_join("guards", ",").alias("guards"))


@query(
    "merged_answers",
    f"""WITH {CLASSIFIED}, m AS (SELECT *, CASE WHEN doc_id % 7 <> 0 THEN (doc_id % 10 + 3) / 10.0 END AS c, ['football', 'basketball', 'unknown'][1 + doc_id % 3] AS ms, ['news', 'signing'][1 + doc_id // 3 % 2] AS me, CASE WHEN league IS NULL THEN 'low' ELSE 'high' END AS imp FROM cs),
r AS (SELECT *, CASE WHEN c IS NULL OR c < 0.65 THEN 'rules_only' WHEN league IS NOT NULL AND ms <> sport AND ms <> 'unknown' THEN 'rules_sport_stands' WHEN certainty = 'confirmed' AND me <> event_type THEN 'rules_event_stands'
  WHEN sport = 'unknown' AND ms <> 'unknown' THEN 'model_fills_sport' WHEN event_type = 'news' AND me <> 'news' THEN 'model_fills_event' ELSE 'agreed' END AS merge_rule FROM m)
SELECT article_id, merge_rule, CASE WHEN merge_rule LIKE 'model%' AND sport = 'unknown' THEN ms ELSE sport END AS final_sport, CASE WHEN merge_rule LIKE 'model%' AND event_type = 'news' THEN me ELSE event_type END AS final_event,
  CASE WHEN merge_rule <> 'rules_only' AND imp = 'low' THEN 'medium' ELSE imp END AS final_importance FROM r""",
)
def merged_answers(spark, sf_dir):
    i = F.col("doc_id")
    said = F.when(i % 7 != 0, F.struct(((i % 10 + 3) / 10).alias("confidence"), pick(("football", "basketball", "unknown"), i).alias("sport"), pick(("news", "signing"), F.floor(i / 3)).alias("event_type"), F.lit("medium").alias("importance")))
    df = _classified(spark, sf_dir).withColumn("said", said).withColumn("proven", F.col("league").isNotNull()).withColumn("importance", F.when(F.col("league").isNull(), "low").otherwise("high"))
    return E.merged(df).select("article_id", "merge_rule", "final_sport", "final_event", "final_importance")


@query(
    "generic_tokens",
    f"WITH {ART}, w AS (SELECT DISTINCT unnest(string_split(lower(title), ' ')) AS token FROM art) SELECT token, token IN ('the', 'of') AS generic FROM w",
)
def generic_tokens(spark, sf_dir):
    words = articles(spark, sf_dir).select(F.explode(F.split(F.lower("title"), " ")).alias("token")).distinct()
    return words.select("token", P.generic_token(F.col("token"), ("the", "of")).alias("generic"))


@query("name_skeletons", "SELECT v AS name, s AS skeleton FROM (VALUES ('יוון', 'ין'), ('וולטר', 'ולטר'), ('מיכאל ויקטור', 'מכאל וקטר'), ('team:וו', 'team:וו'), ('דוד', 'דד')) t(v, s)")
def name_skeletons(spark, sf_dir):
    names = spark.createDataFrame([("יוון",), ("וולטר",), ("מיכאל ויקטור",), ("team:וו",), ("דוד",)], "name string")
    return names.select("name", P.skeleton(F.col("name")).alias("skeleton"))


# Orders as articles, regions as users: nations are competitions, suppliers teams, and what suppliers' nations say is reach.
_SCORED = """WITH a AS (SELECT o_orderkey AS id, o_orderstatus AS source, 's' || n_regionkey AS sport, 'c' || c_nationkey AS comp, ['signing', 'match_result', 'news', 'injury', 'match_summary'][1 + CAST(substr(o_orderpriority, 1, 1) AS INT) - 1] AS ev,
    CASE WHEN o_totalprice > 250000 THEN 'very_high' WHEN o_totalprice < 60000 THEN 'low' ELSE 'medium' END AS imp FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
ent AS (SELECT DISTINCT l_orderkey AS id, 't' || l_suppkey AS t, 'c' || s_nationkey AS nk FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
keys AS (SELECT id, 'sport' AS scope, sport AS target, 'explicit' AS mk FROM a UNION SELECT id, 'competition', comp, 'explicit' FROM a UNION SELECT id, 'team', t, 'explicit' FROM ent UNION SELECT id, 'competition', nk, 'membership' FROM ent JOIN a USING (id) WHERE nk <> comp),
sup AS (SELECT s_suppkey AS sk, s_acctbal, n_regionkey AS r FROM supplier JOIN nation ON s_nationkey = n_nationkey),
"""
_AFF = _SCORED + """aff AS (SELECT r_regionkey AS u, 'sport' AS scope, 's' || r_regionkey AS target, 0 AS level, r_regionkey AS pos FROM region UNION ALL SELECT n_regionkey, 'competition', 'c' || n_nationkey, n_nationkey % 4 - 1, 10 + n_nationkey FROM nation
  UNION ALL SELECT r, 'team', 't' || sk, sk % 5 - 2, 100 + sk FROM sup),
del AS (SELECT r_regionkey AS u, NULL AS sr, 'match_result' AS ev, r_regionkey % 3 - 1 AS delta, 1 AS au, 0 AS pos FROM region UNION ALL SELECT n_regionkey, 'c' || n_nationkey, 'signing', 1, 2, n_nationkey FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT r_regionkey, 's' || r_regionkey, 'regular_season_result', -1, 3, 5 FROM region),
ov AS (SELECT r AS u, CASE WHEN s_acctbal < 0 THEN 'never_show' ELSE 'always_push' END AS kind, 't' || sk AS target, CASE WHEN sk % 2 = 0 THEN 'injury' END AS ev FROM sup WHERE s_acctbal < 0 OR s_acctbal > 8000),
met AS (SELECT u, id, aff.scope, aff.target, level, pos, mk, CASE aff.scope WHEN 'team' THEN 3 WHEN 'competition' THEN 2 ELSE 1 END AS nar FROM keys JOIN aff ON keys.scope = aff.scope AND keys.target = aff.target),
g AS (SELECT u, id, max({'p': level + 1, 'b': -nar, 'e': -pos, 's': scope, 't': target, 'm': mk}) FILTER (level > -2) AS base, max(nar) FILTER (level = -2) AS shut, max(nar) FILTER (level > -2) AS op,
  coalesce(bool_or(level >= 0 AND scope = 'team'), false) AS backed, coalesce(bool_or(level >= 1 AND scope = 'team'), false) AS boosted FROM met GROUP BY 1, 2),
ru AS (SELECT u, keys.id, bool_or(kind = 'never_show') AS nev, bool_or(kind = 'always_push') AS psh FROM keys JOIN ov ON keys.scope = 'team' AND keys.target = ov.target JOIN a ON a.id = keys.id WHERE ov.ev IS NULL OR ov.ev = a.ev GROUP BY 1, 2),
b AS (SELECT u, id, base, shut, op, backed, boosted, nev, psh FROM g FULL JOIN ru USING (u, id)), f AS (SELECT b.*, a.* EXCLUDE (id) FROM b JOIN a USING (id)),
nm AS (SELECT u, id, base.t AS t, ev AS al, 0 AS ord FROM f WHERE base IS NOT NULL UNION ALL SELECT u, id, base.t, al, o FROM f JOIN (VALUES ('match_result', 'regular_season_result', 1), ('signing', 'major_signing', 1), ('match_summary', 'match_result', 1), ('match_summary', 'regular_season_result', 2)) v(e, al, o) ON ev = e WHERE base IS NOT NULL),
dl AS (SELECT nm.u, id, first(delta ORDER BY (sr IS NULL)::INT, ord, -au, pos) AS delta FROM nm JOIN del ON del.u = nm.u AND del.ev = nm.al AND (sr IS NULL OR sr = t) GROUP BY 1, 2),
z AS (SELECT f.*, coalesce(dl.delta, 0) AS d, CASE WHEN f.u = 1 AND f.source = 'P' THEN 'muted_source' WHEN f.u = 2 AND (f.sport = 's3' OR f.comp = 'c7') THEN 'muted_topic' WHEN nev THEN 'never_show_override'
  WHEN shut IS NOT NULL AND coalesce(op, 0) <= shut THEN 'excluded_scope' WHEN base IS NULL THEN 'no_matching_scope' END AS why FROM f LEFT JOIN dl ON f.u = dl.u AND f.id = dl.id),
s1 AS (SELECT *, base.p + CASE WHEN boosted AND base.s IN ('competition', 'sport') THEN 1 ELSE 0 END + d AS bf FROM z),
s2 AS (SELECT *, CASE WHEN why IS NULL THEN bf + CASE WHEN imp = 'very_high' AND bf >= 1 THEN 1 WHEN imp = 'low' THEN -1 ELSE 0 END END AS sc FROM s1),
s3 AS (SELECT *, CASE WHEN sc <= 0 THEN 'hidden' WHEN sc = 1 THEN 'low_feed' WHEN sc = 2 OR (base.m = 'membership' AND NOT backed) THEN 'feed' ELSE 'high_feed' END AS pl FROM s2),
s4 AS (SELECT *, CASE WHEN why IS NOT NULL THEN 'hidden' WHEN pl <> 'hidden' AND psh THEN 'push' ELSE pl END AS dec FROM s3)
SELECT u AS user_id, id AS article_id, base.t AS base, CAST(sc AS INT) AS score, dec AS decision, coalesce(why, CASE WHEN dec = 'push' THEN 'always_push' ELSE 'affinity_score' END) AS reason FROM s4"""
_ORDER_EVENTS = ("signing", "match_result", "news", "injury", "match_summary")


def _named(prefix: str, c):
    return F.concat(F.lit(prefix), F.col(c).cast("string")) if isinstance(c, str) else F.concat(F.lit(prefix), c.cast("string"))


def _order_articles(spark, sf_dir):
    nation, supplier = read(spark, sf_dir, "nation"), read(spark, sf_dir, "supplier")
    ent = read(spark, sf_dir, "lineitem").join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    ent = ent.groupBy(F.col("l_orderkey").alias("article_id")).agg(F.collect_set(_named("t", "l_suppkey")).alias("teams"), F.collect_set(_named("c", "s_nationkey")).alias("reach"))
    price = F.col("o_totalprice")
    a = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    a = a.select(
        F.col("o_orderkey").alias("article_id"), F.col("o_orderstatus").alias("source"), _named("s", "n_regionkey").alias("sport"), _named("c", "c_nationkey").alias("competition"),
        pick(_ORDER_EVENTS, F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("event_type"), F.when(price > 250000, "very_high").when(price < 60000, "low").otherwise("medium").alias("importance"),
    )
    none = F.array().cast("array<string>")
    return a.join(ent, "article_id", "left").withColumn("teams", F.coalesce("teams", none)).withColumn("reach", F.coalesce("reach", none))


@query("affinity_scores", _AFF)
def affinity_scores(spark, sf_dir):
    region, nation = read(spark, sf_dir, "region"), read(spark, sf_dir, "nation")
    sup = read(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("sk"), "s_acctbal", F.col("n_regionkey").alias("user_id"))
    r, n, nk = F.col("r_regionkey"), F.col("n_regionkey").alias("user_id"), F.col("n_nationkey")
    team, none = _named("t", "sk").alias("target"), F.lit(None).cast("string")
    aff = region.select(r.alias("user_id"), F.lit("sport").alias("scope"), _named("s", r).alias("target"), F.lit(0).alias("level"), r.cast("long").alias("pos"))
    aff = aff.union(nation.select(n, F.lit("competition"), _named("c", nk), nk % 4 - 1, 10 + nk)).union(sup.select("user_id", F.lit("team"), team, F.col("sk") % 5 - 2, 100 + F.col("sk")))
    deltas = region.select(r.alias("user_id"), none.alias("scope_ref"), F.lit("match_result").alias("event_type"), (r % 3 - 1).alias("delta"), F.lit(1).alias("authority"), F.lit(0).alias("pos"))
    deltas = deltas.union(nation.filter(nk % 2 == 0).select(n, _named("c", nk), F.lit("signing"), F.lit(1), F.lit(2), nk)).union(region.select(r, _named("s", r), F.lit("regular_season_result"), F.lit(-1), F.lit(3), F.lit(5)))
    rules = sup.filter("s_acctbal < 0 OR s_acctbal > 8000").select("user_id", F.when(F.col("s_acctbal") < 0, "never_show").otherwise("always_push").alias("kind"), F.lit("team").alias("scope"), team, F.when(F.col("sk") % 2 == 0, "injury").alias("event_type"))
    muted = spark.createDataFrame([(1, "source", "P"), (2, "topic", "s3"), (2, "topic", "c7")], "user_id int, kind string, value string")
    arts = _order_articles(spark, sf_dir).withColumn("entities", F.transform("teams", lambda t: F.struct(F.lit("team").alias("scope"), t.alias("target"))))
    return W.score(arts, aff, deltas, rules, muted)


@query(
    "never_show_rules",
    _SCORED.rstrip().rstrip(",") + """, e AS (SELECT id, min(t) AS t FROM ent WHERE CAST(substr(t, 2, 20) AS INT) % 3 = 0 GROUP BY 1), p AS (SELECT id, min(t) AS t FROM ent WHERE CAST(substr(t, 2, 20) AS INT) % 3 = 1 GROUP BY 1)
SELECT a.id AS article_id, CASE WHEN e.t IS NOT NULL THEN 'team' WHEN p.t IS NOT NULL THEN 'player' WHEN imp <> 'low' THEN 'competition' WHEN sport <> 's1' THEN 'sport' END AS scope,
  CASE WHEN e.t IS NOT NULL THEN e.t WHEN p.t IS NOT NULL THEN p.t WHEN imp <> 'low' THEN comp WHEN sport <> 's1' THEN sport END AS target, CASE WHEN e.t IS NOT NULL OR p.t IS NOT NULL THEN NULL WHEN imp <> 'low' OR sport <> 's1' THEN ev END AS event_type
FROM a LEFT JOIN e ON e.id = a.id LEFT JOIN p ON p.id = a.id""",
)
def never_show_rules(spark, sf_dir):
    own = lambda k: F.array_sort(F.filter("teams", lambda t: F.substring(t, 2, 20).cast("int") % 3 == k))
    a = _order_articles(spark, sf_dir)
    return W.never_show_rule(a.select("article_id", own(0).alias("teams"), own(1).alias("people"), F.when(F.col("importance") != "low", F.col("competition")).alias("competition"), F.when(F.col("sport") == "s1", "unknown").otherwise(F.col("sport")).alias("sport"), "event_type"))


@query(
    "learned_levels",
    """WITH n AS (SELECT user_id, event_type AS target, round_even(sum(value) / 100 - 3, 3) AS net FROM events GROUP BY 1, 2)
SELECT n.user_id, target, greatest(-1, least(2, coalesce(l.level, 0) + sign(net)::INT))::INT AS level FROM n LEFT JOIN (SELECT DISTINCT user_id, 'click' AS target, user_id % 5 - 2 AS level FROM events) l USING (user_id, target) WHERE abs(net) >= 0.5""",
)
def learned_levels(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    nets = e.groupBy("user_id", F.col("event_type").alias("target")).agg(F.bround(exact_sum(F.col("value")) / 100 - 3, 3).alias("net")).withColumn("active", F.abs("net") >= 0.5)
    levels = e.select("user_id", F.lit("click").alias("target"), (F.col("user_id") % 5 - 2).cast("int").alias("level")).distinct()
    return W.learned_levels(nets, levels)


@query(
    "click_features",
    "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'entity:e' || user_id WHEN event_id % 3 = 1 THEN 'entity:t' || user_id % 7 ELSE 'event:c' || user_id % 7 || '|' || event_type END AS feature FROM events",
)
def click_features(spark, sf_dir):
    k, u = F.col("event_id") % 3, F.col("user_id")
    clicks = read(spark, sf_dir, "events").select("event_id", "event_type", F.when(k == 0, _named("e", u)).alias("boost"), F.when(k == 1, _named("t", u % 7)).otherwise(_named("c", u % 7)).alias("base"), F.when(k == 1, "team").otherwise("competition").alias("base_scope"))
    return W.attributed(clicks).select("event_id", "feature")


_MODES = ("all", "followed_entities_only", "titles_only", "high_importance_only", "muted")


@query(
    "topic_decisions",
    _SCORED + f"""cm AS (SELECT id, comp, min(tier) AS tier FROM (SELECT id, comp, 1 AS tier FROM a WHERE imp <> 'low' UNION ALL SELECT id, comp, 3 FROM a WHERE ev IN ('match_result', 'match_summary') UNION ALL SELECT id, nk, 4 FROM ent JOIN a USING (id) WHERE ev IN ('signing', 'injury')) GROUP BY 1, 2),
tp AS (SELECT n_regionkey AS u, 'k' || n_nationkey AS topic, 'competition' AS scope, 'c' || n_nationkey AS target, {list(_MODES)}[1 + n_nationkey % 5] AS mode, 60 + n_nationkey % 4 * 10 AS pr, n_nationkey AS pos FROM nation
  UNION ALL SELECT r_regionkey, 'r' || r_regionkey, 'sport', 's' || r_regionkey, 'all', 75, 100 + r_regionkey FROM region UNION ALL SELECT r, 't' || sk, 'entity', 't' || sk, 'all', 80, 200 + sk FROM sup WHERE sk % 4 = 0),
er AS (SELECT topic, 'signing' AS ev, 'feed' AS d FROM tp WHERE pos % 2 = 0 UNION ALL SELECT topic, 'match_result', CASE WHEN pos % 3 = 0 THEN 'hidden' ELSE 'low_feed' END FROM tp
  UNION ALL SELECT topic, 'match_summary', CASE WHEN pos % 3 = 0 THEN 'hidden' ELSE 'low_feed' END FROM tp), ca AS (SELECT topic, 'high_feed' AS d FROM tp WHERE pos % 5 = 1), fw AS (SELECT tp.topic, 't' || sk AS e FROM tp JOIN sup ON r = u WHERE sk % 3 > 0), nr AS (SELECT 'r' || r AS topic, 'injury' AS ev, 't' || sk AS e, CASE WHEN sk % 2 = 0 THEN 3 ELSE 1 END AS rk FROM sup),
ky AS (SELECT id, 'sport' AS scope, sport AS target, 1 AS tier FROM a UNION ALL SELECT id, 'entity', t, 1 FROM ent UNION ALL SELECT id, 'competition', comp, tier FROM cm),
ne AS (SELECT id, count(*) AS n FROM ent GROUP BY 1), m AS (SELECT ky.id, u, tp.topic, tp.scope, mode, pr, pos, tier, imp, a.ev, er.d AS evd, EXISTS (SELECT 1 FROM ent JOIN fw ON fw.e = ent.t WHERE ent.id = ky.id AND fw.topic = tp.topic) AS we, ca.d AS cad FROM ky JOIN tp ON ky.scope = tp.scope AND ky.target = tp.target JOIN a ON a.id = ky.id LEFT JOIN er ON er.topic = tp.topic AND er.ev = a.ev LEFT JOIN ca ON ca.topic = tp.topic),
be AS (SELECT m.topic, m.id, max(rk) AS rk FROM m JOIN ent ON ent.id = m.id JOIN nr ON nr.topic = m.topic AND nr.ev = m.ev AND nr.e = ent.t GROUP BY 1, 2),
q AS (SELECT m.*, CASE be.rk WHEN 3 THEN 'high_feed' WHEN 1 THEN 'low_feed' END AS end_, CASE WHEN be.rk = 1 AND imp = 'very_high' THEN 'feed' WHEN be.rk = 3 THEN 'high_feed' WHEN be.rk = 1 THEN 'low_feed' END AS enb,
  CASE WHEN imp = 'very_high' AND pr >= 80 THEN 'high_feed' WHEN imp = 'medium' AND pr >= 70 THEN 'feed' WHEN imp = 'medium' THEN 'low_feed' WHEN imp = 'low' AND pr >= 70 THEN 'low_feed' ELSE 'hidden' END AS fb,
  CASE WHEN evd = 'hidden' THEN 'hidden' WHEN evd = 'low_feed' AND imp = 'very_high' THEN 'feed' WHEN evd = 'feed' AND (imp = 'very_high' OR m.scope = 'entity') THEN 'high_feed' ELSE evd END AS evb FROM m LEFT JOIN be ON be.topic = m.topic AND be.id = m.id),
dd AS (SELECT *, CASE mode WHEN 'muted' THEN 'hidden' WHEN 'titles_only' THEN coalesce(evd, 'hidden') WHEN 'high_importance_only' THEN CASE WHEN imp = 'low' THEN 'hidden' ELSE coalesce(nullif(evd, 'hidden'), fb) END WHEN 'followed_entities_only' THEN CASE WHEN we THEN coalesce(enb, nullif(evd, 'hidden'), cad, 'feed') ELSE 'hidden' END ELSE coalesce(enb, evb, fb) END AS dec,
  CASE WHEN mode = 'muted' THEN 'topic_muted' WHEN end_ IS NOT NULL AND mode NOT IN ('titles_only', 'high_importance_only') THEN 'entity_event' WHEN CASE WHEN mode IN ('high_importance_only', 'followed_entities_only') THEN nullif(evd, 'hidden') ELSE evd END IS NOT NULL THEN 'event' ELSE 'fallback' END AS rule FROM q),
cp AS (SELECT *, CASE WHEN tier = 4 AND NOT we AND {RANK.format('dec')} > 2 THEN 'feed' ELSE dec END AS decision FROM dd)
SELECT u AS user_id, id AS article_id, topic AS topic_id, decision, rule FROM cp QUALIFY row_number() OVER (PARTITION BY u, id ORDER BY {RANK.format('decision')} DESC, pr DESC, pos, topic) = 1""",
)
def topic_decisions(spark, sf_dir):
    region, nation = read(spark, sf_dir, "region"), read(spark, sf_dir, "nation")
    sup = read(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("sk"), F.col("n_regionkey").alias("r"))
    arts = saved(_order_articles(spark, sf_dir).withColumn("entities", F.col("teams")).withColumn("competitions", F.when(F.col("importance") != "low", F.array("competition")).otherwise(F.array().cast("array<string>"))))
    comps = T.competition_matches(arts, arts.select("article_id", F.explode("reach").alias("competition")), arts.select("article_id", "competition"))
    nk, rk, sk = F.col("n_nationkey"), F.col("r_regionkey"), F.col("sk")
    topics = nation.select(F.col("n_regionkey").alias("user_id"), _named("k", nk).alias("topic_id"), F.lit("competition").alias("scope"), _named("c", nk).alias("target"), pick(_MODES, nk).alias("mode"), (60 + nk % 4 * 10).alias("priority"), nk.cast("long").alias("pos"))
    topics = topics.union(region.select(rk, _named("r", rk), F.lit("sport"), _named("s", rk), F.lit("all"), F.lit(75), 100 + rk)).union(sup.filter(sk % 4 == 0).select("r", _named("t", sk), F.lit("entity"), _named("t", sk), F.lit("all"), F.lit(80), 200 + sk))
    none = F.lit(None).cast("string")
    rules = topics.filter("pos % 2 = 0").select("topic_id", none.alias("entity"), F.lit("signing").alias("event_type"), F.lit("feed").alias("decision"))
    rules = rules.union(topics.select("topic_id", none, F.lit("match_result"), F.when(F.col("pos") % 3 == 0, "hidden").otherwise("low_feed"))).union(sup.select(_named("r", "r"), _named("t", sk), F.lit("injury"), F.when(sk % 2 == 0, DECISIONS[3]).otherwise(DECISIONS[1])))
    rules = rules.union(topics.filter("pos % 5 = 1").select("topic_id", none, F.lit(T.CATCH_ALL), F.lit("high_feed")))
    follows = sup.filter(sk % 3 > 0).select(F.col("r").alias("user_id"), _named("t", sk).alias("entity"))
    return T.topic_decisions(arts, topics, comps, rules, follows, {"match_summary": ("match_recap", "match_result")})
