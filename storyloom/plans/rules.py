"""Queries of the rule ladders."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from ..operators import rules as R
from ..sources.tables import articles, pick, read
from .registry import ART, PAIRS, _paired, query

END = datetime(2024, 1, 30, tzinfo=timezone.utc)
LEAGUES = ("NBA", "EuroLeague", "LaLiga", "none")
_FACTS = f"""{ART}, fx AS (SELECT *, CASE doc_id % 4 WHEN 0 THEN 'NBA' WHEN 1 THEN 'EuroLeague' WHEN 2 THEN 'LaLiga' END AS league, doc_id % 3 AS n_entities, doc_id % 11 = 0 AS ambiguous, doc_id % 5 = 0 AS keyword,
  ['football', 'basketball', 'tennis', 'unknown'][1 + doc_id // 2 % 4] AS hint, ['confirmed', 'probable', 'weak'][1 + doc_id % 3] AS certainty, source IN ('src1', 'src2') AS sure FROM art),
cf AS (SELECT *, round_even(least(0.95::DOUBLE, 0.40::DOUBLE + CASE WHEN sport <> 'unknown' THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN sure THEN 0.05::DOUBLE ELSE 0 END + CASE WHEN league IS NOT NULL THEN 0.15::DOUBLE ELSE 0 END
  + CASE WHEN n_entities > 0 THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN event_type <> 'news' THEN 0.10::DOUBLE ELSE 0 END), 2) AS confidence FROM fx),
gt AS (SELECT *, CASE WHEN ambiguous THEN 'call:ambiguous_club' WHEN sport = 'unknown' THEN 'call:sport_unknown' WHEN confidence < 0.55 THEN 'call:low_confidence' WHEN league IS NOT NULL AND confidence >= 0.65 AND keyword THEN 'skip:league_keyword'
  WHEN hint = sport AND confidence >= 0.65 AND (league IS NOT NULL OR n_entities > 0 OR event_type <> 'news') THEN 'skip:hint' WHEN hint = sport AND confidence >= 0.65 THEN 'call:hint_only' WHEN league IS NOT NULL AND confidence >= 0.80 THEN 'skip:league'
  WHEN n_entities > 0 AND event_type <> 'news' AND confidence >= 0.75 THEN 'skip:entities' ELSE 'call:default' END AS v FROM cf)"""


def _facts(spark, sf_dir):
    i = F.col("doc_id")
    df = articles(spark, sf_dir).select(
        "*",
        F.nullif(pick(LEAGUES, i), F.lit("none")).alias("league"),
        (i % 3).alias("n_entities"),
        (i % 11 == 0).alias("ambiguous"),
        (i % 5 == 0).alias("keyword"),
        pick(("football", "basketball", "tennis", "unknown"), F.floor(i / 2)).alias("hint"),
        pick(("confirmed", "probable", "weak"), i).alias("certainty"),
        F.col("source").isin("src1", "src2").alias("sure"),
    )
    return df.withColumn("confidence", R.confidence(F.col("sport"), F.col("sure"), F.col("league"), F.col("n_entities"), F.col("event_type")))


@query("llm_gate", f"WITH {_FACTS} SELECT article_id, confidence, split_part(v, ':', 1) = 'call' AS call, split_part(v, ':', 2) AS why FROM gt")
def llm_gate(spark, sf_dir):
    return R.gate(_facts(spark, sf_dir)).select("article_id", "confidence", "call", "why")


@query(
    "gating_benchmark",
    f"""WITH {_FACTS}, b AS (SELECT source, split_part(v, ':', 1) = 'call' AS call, sport = 'unknown' AS bu, sport = 'unknown' AND hint = 'unknown' AS gu FROM gt),
g AS (SELECT source, count(*) AS n_base, count(*) FILTER (call) AS n_gated, round_even(count(*) FILTER (NOT call) / count(*), 4) AS skip_rate, count(*) FILTER (gu) - count(*) FILTER (bu) AS unknown_change FROM b GROUP BY source)
SELECT *, skip_rate >= 0.40 AND unknown_change <= 0 AS passed FROM g""",
)
def gating_benchmark(spark, sf_dir):
    df = R.gate(_facts(spark, sf_dir)).withColumn("base_unknown", F.col("sport") == "unknown").withColumn("gated_unknown", (F.col("sport") == "unknown") & (F.col("hint") == "unknown"))
    return R.gating_benchmark(df)


@query(
    "importance_ladder",
    f"""WITH {_FACTS} SELECT article_id, CASE WHEN event_type IN ('grand_slam_winner', 'finals_result', 'title_win') AND certainty = 'confirmed' THEN 'very_high' WHEN event_type IN ('grand_slam_winner', 'finals_result', 'title_win') THEN 'high'
  WHEN event_type IN ('signing', 'negotiation', 'injury', 'major_trade', 'major_transfer') AND (n_entities > 1 OR league IN ('NBA', 'EuroLeague')) THEN 'high' WHEN event_type IN ('signing', 'negotiation', 'injury', 'major_trade', 'major_transfer') THEN 'medium'
  WHEN event_type IN ('schedule', 'early_round_result') THEN 'low' WHEN event_type = 'news' AND NOT n_entities > 1 THEN 'low' ELSE 'medium' END AS importance FROM fx""",
)
def importance_ladder(spark, sf_dir):
    return _facts(spark, sf_dir).select("article_id", R.importance(F.col("event_type"), F.col("certainty"), F.col("n_entities") > 1, F.col("league")).alias("importance"))


@query(
    "hard_constraints",
    f"WITH {_FACTS} SELECT article_id, CASE WHEN source IN ('src3') THEN 'source_disabled' WHEN source IN ('src4', 'src3') THEN 'source_muted' WHEN sport IN ('tennis', 'LaLiga') OR league IN ('tennis', 'LaLiga') THEN 'topic_muted' END AS hidden_by FROM fx",
)
def hard_constraints(spark, sf_dir):
    f = _facts(spark, sf_dir)
    return f.select("article_id", R.constraint(F.col("source"), F.col("sport"), F.col("league"), ("src3",), ("src4", "src3"), ("tennis", "LaLiga")).alias("hidden_by"))


@query(
    "source_health",
    """WITH s AS (SELECT DISTINCT user_id AS source_id FROM events UNION SELECT 1000000), r AS (SELECT user_id AS source_id, ts, event_type <> 'error' AS ok FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT s.source_id, CASE WHEN s.source_id % 9 = 0 THEN 'disabled' WHEN r.ts IS NULL THEN 'never_run' WHEN NOT ok THEN 'error' WHEN (epoch_us(TIMESTAMP '2024-01-30') - epoch_us(ts)) / 60000000.0 > 2 * 240 THEN 'stale' ELSE 'healthy' END AS health FROM s LEFT JOIN r USING (source_id)""",
)
def source_health(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    sources = e.select(F.col("user_id").alias("source_id")).distinct().union(spark.range(1_000_000, 1_000_001)).select("source_id", (F.col("source_id") % 9 != 0).alias("enabled"), F.lit(240).alias("interval_minutes"))
    runs = e.select(F.col("user_id").alias("source_id"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("run_id"), (F.col("event_type") != "error").alias("ok"))
    return R.source_health(sources, runs, END)


@query(
    "event_delta_lookup",
    """WITH q AS (SELECT doc_id AS request_id, 'sport' || (doc_id % 3) AS scope, ['major_trade', 'match_result', 'match_summary', 'signing', 'news'][1 + doc_id % 5] AS event_type FROM documents),
d(scope, event_type, delta) AS (VALUES ('sport0', 'star_trade', 1), ('sport0', 'match_result', -1), ('sport1', 'regular_season_result', 2), (NULL, 'match_result', 1), (NULL, 'signing', -2), ('sport2', 'signing', 2)),
al(event_type, alias, pos) AS (VALUES ('major_trade', 'star_trade', 1), ('match_result', 'regular_season_result', 1), ('match_summary', 'match_result', 1), ('match_summary', 'regular_season_result', 2)),
n AS (SELECT * FROM al UNION SELECT event_type, event_type, 0 FROM q),
m AS (SELECT request_id, (d.scope IS NULL)::INT AS wide, pos, delta FROM q JOIN n USING (event_type) JOIN d ON d.event_type = n.alias AND (d.scope = q.scope OR d.scope IS NULL))
SELECT request_id, b.delta AS delta FROM q LEFT JOIN (SELECT request_id, min({'wide': wide, 'pos': pos, 'delta': delta}) AS b FROM m GROUP BY request_id) USING (request_id)""",
)
def event_delta_lookup(spark, sf_dir):
    i = F.col("doc_id")
    asked = read(spark, sf_dir, "documents").select(i.alias("request_id"), F.concat(F.lit("sport"), (i % 3).cast("string")).alias("scope"), pick(("major_trade", "match_result", "match_summary", "signing", "news"), i).alias("event_type"))
    deltas = spark.createDataFrame([("sport0", "star_trade", 1), ("sport0", "match_result", -1), ("sport1", "regular_season_result", 2), (None, "match_result", 1), (None, "signing", -2), ("sport2", "signing", 2)], "scope string, event_type string, delta int")
    aliases = spark.createDataFrame([("major_trade", "star_trade", 1), ("match_result", "regular_season_result", 1), ("match_summary", "match_result", 1), ("match_summary", "regular_season_result", 2)], "event_type string, alias string, pos int")
    return R.event_delta(asked, deltas, aliases)


@query(
    "run_cycle_link",
    "SELECT e.event_id, c.event_id AS cycle_id FROM events e ASOF LEFT JOIN (SELECT user_id, ts, event_id FROM events WHERE event_type = 'signup') c ON e.user_id = c.user_id AND e.ts >= c.ts",
)
def run_cycle_link(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    cycles = e.filter("event_type = 'signup'").select("user_id", "ts", F.col("event_id").alias("cycle_id"))
    return R.as_of(e, cycles, "user_id", "ts", "cycle_id").select("event_id", "cycle_id")


@query(
    "dispatch_plan",
    """WITH o AS (SELECT event_id, ['pending', 'retryable', 'sent', 'unknown'][1 + event_id % 4] AS status, event_id % 7 AS attempts, ts FROM events),
b AS (SELECT * FROM o WHERE status IN ('pending', 'retryable') ORDER BY ts, event_id LIMIT 10)
SELECT event_id, CASE WHEN attempts >= 5 THEN 'give_up' WHEN status = 'retryable' AND (epoch_us(TIMESTAMP '2024-01-01 00:40:00') - epoch_us(ts)) / 60000000.0 < 5 * pow(2.0, attempts - 1) THEN 'wait' ELSE 'send' END AS todo FROM b""",
)
def dispatch_plan(spark, sf_dir):
    i = F.col("event_id")
    out = read(spark, sf_dir, "events").select("event_id", pick(("pending", "retryable", "sent", "unknown"), i).alias("status"), (i % 7).alias("attempts"), F.col("ts").cast("timestamp").alias("created_at"))
    return R.dispatch(out, datetime(2024, 1, 1, 0, 40, tzinfo=timezone.utc)).select("event_id", "todo")


@query(
    "fact_disagreements",
    f"""WITH {PAIRS}, f AS (SELECT article_id, sport, event_type, CASE doc_id % 4 WHEN 0 THEN 'NBA' WHEN 1 THEN 'EuroLeague' WHEN 2 THEN 'LaLiga' END AS league FROM art),
k AS (SELECT a_id, b_id, round(j, 4) AS similarity, concat_ws(',', CASE WHEN a.event_type <> b.event_type THEN 'event' END, CASE WHEN a.league IS DISTINCT FROM b.league THEN 'league' END,
  CASE WHEN a.sport <> 'unknown' AND b.sport <> 'unknown' AND a.sport <> b.sport THEN 'sport' END, CASE WHEN (a.sport = 'unknown' OR b.sport = 'unknown') AND a.sport <> b.sport THEN 'sport_unknown' END) AS kinds
  FROM pr JOIN f a ON a.article_id = a_id JOIN f b ON b.article_id = b_id WHERE s1 <> s2 AND j >= 0.30)
SELECT * FROM k WHERE kinds <> ''""",
)
def fact_disagreements(spark, sf_dir):
    return R.disagreements(_paired(spark, sf_dir, 0.30, ("source",)), _facts(spark, sf_dir).select("article_id", "sport", "event_type", "league"))


@query(
    "preset_levels",
    """WITH d AS (SELECT user_id, event_type, CASE user_id % 4 WHEN 0 THEN -1 WHEN 1 THEN 1 ELSE CAST(event_id % 3 - 1 AS INT) END AS delta FROM events), g(grp, event_type) AS (VALUES ('buy', 'purchase'), ('buy', 'signup'), ('look', 'view'), ('look', 'click')),
s AS (SELECT grp, count(*) AS k FROM g GROUP BY grp), e AS (SELECT user_id, grp, count(DISTINCT event_type) AS n, min(delta) AS lo, max(delta) AS hi FROM d JOIN g USING (event_type) GROUP BY 1, 2)
SELECT user_id, grp AS "group", CASE WHEN n = k AND hi = -1 AND lo = -1 THEN 'less' WHEN n = k AND lo = 1 AND hi = 1 THEN 'more' ELSE 'mixed' END AS preset FROM e JOIN s USING (grp)""",
)
def preset_levels(spark, sf_dir):
    u = F.col("user_id")
    deltas = read(spark, sf_dir, "events").select("user_id", "event_type", F.when(u % 4 == 0, F.lit(-1)).when(u % 4 == 1, F.lit(1)).otherwise((F.col("event_id") % 3 - 1).cast("int")).alias("delta"))
    groups = spark.createDataFrame([("buy", "purchase"), ("buy", "signup"), ("look", "view"), ("look", "click")], "group string, event_type string")
    return R.presets(deltas, groups)


@query("managed_interests", "SELECT c_custkey AS id, c_mktsegment AS kind FROM customer WHERE c_mktsegment <> 'BUILDING' UNION ALL SELECT s_suppkey + 1000000, 'BUILDING' FROM supplier")
def managed_interests(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("kind"))
    new = read(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1_000_000).alias("id"), F.lit("BUILDING").alias("kind"))
    return R.replace_managed(rows, new, F.col("kind") == "BUILDING")
