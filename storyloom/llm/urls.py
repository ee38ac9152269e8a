"""URL filters: hand-written host and path rules first, mined association rules for the rest.

FP-growth over the tokens of labelled URLs gives token sets that occur with the block label; sets with enough support
and confidence, more blocked URLs than chance explains among so many sets, and no smaller subset rule that is as
confident, become rules.  A rule is indexed by its rarest token, so
a URL is held only against rules one of whose tokens it has.
"""

from __future__ import annotations

from math import log

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, fits_broadcast, table, written

BLOCK = "label=block"
#: action, host, path: the fixed rules of the query.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for a null or a text without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ? or # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(url: Column) -> Column:
    """Distinct tokens of a URL: host labels with their level from the right, path segments that are not numbers, the
    extension, query keys and whether there is a fragment."""
    labels = F.reverse(F.array_remove(F.split(host_of(url), r"\."), ""))
    hosts = F.transform(labels, lambda x, i: F.concat(F.lit("h"), i.cast("string"), F.lit("="), x))
    bare = F.regexp_replace(path_of(url), r"\.[A-Za-z]{1,5}$", "")
    segments = F.filter(F.split(bare, "/"), lambda x: (x != "") & ~x.rlike("^[0-9]+$"))
    paths = F.transform(segments, lambda x: F.concat(F.lit("p="), F.translate(x, UPPER, LOWER)))
    ext = F.regexp_extract(path_of(url), r"\.([A-Za-z]{1,5})$", 1)
    keys = F.transform(F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#?]+)="), F.lit(1)), lambda x: F.concat(F.lit("q="), x))
    rest = F.array_compact(F.array(F.when(ext != "", F.concat(F.lit("e="), ext)), F.when(url.contains("#"), F.lit("f"))))
    return F.array_distinct(F.concat(hosts, paths, keys, rest))


def fixed_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, action) of the longest fixed rule that fits, or nulls."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, action = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(act)).otherwise(action)
    return rule, action


def mine(labelled: DataFrame, min_share: float = 0.001, min_count: int = 8, min_confidence: float = 0.5, chance: float = 0.05) -> DataFrame:
    """Rules (rule: sorted tokens, n: labelled URLs that have them all, n_block, confidence, anchor: the rarest token).

    ``labelled`` has url and block (boolean); null labels are left out.  A set needs at least ``min_count`` blocked URLs
    and that share of all labelled ones, and more of them than the base rate p gives: by Chernoff's bound n URLs have a
    confidence c by chance in exp(-n KL(c, p)) of cases at most, and times the number of sets that is to be at most
    ``chance``.  A rule goes if one of its proper subsets is a rule of the same or a higher
    confidence.  No labelled rows give no rules."""
    baskets = written(labelled.filter("block IS NOT NULL").select(tokens(F.col("url")).alias("own"), "block"))
    total = baskets.count()
    schema = "rule array<string>, n long, n_block long, confidence double, anchor string"
    least = max(min_count, int(total * min_share))
    blocked = baskets.filter("block").count()
    if blocked < least:
        return labelled.sparkSession.createDataFrame([], schema)
    items = F.when(F.col("block"), F.concat("own", F.array(F.lit(BLOCK)))).otherwise(F.col("own"))
    model = FPGrowth(itemsCol="items", minSupport=least / total, minConfidence=0.0).fit(baskets.select(items.alias("items")))
    sets = model.freqItemsets
    with_label = sets.filter(F.array_contains("items", BLOCK)).select(F.array_sort(F.array_remove("items", BLOCK)).alias("rule"), F.col("freq").alias("n_block")).filter("size(rule) > 0 AND n_block >= 1")
    alone = sets.filter(~F.array_contains("items", BLOCK)).select(F.array_sort("items").alias("rule"), F.col("freq").alias("n"))
    tried = written(with_label.filter(F.col("n_block") >= least))
    found = tried.join(alone, "rule").withColumn("confidence", F.col("n_block") / F.col("n")).filter(F.col("confidence") >= min_confidence)
    base = blocked / total
    surprise = F.col("n_block") * F.log(F.col("confidence") / base) + F.when(F.col("n") > F.col("n_block"), (F.col("n") - F.col("n_block")) * F.log((1 - F.col("confidence")) / (1 - base))).otherwise(0.0)
    found = found.filter((F.col("confidence") > base) & (surprise >= log(max(1, tried.count()) / chance)))
    found = written(found.select("rule", "n", "n_block", "confidence"))
    # Pruning: subsets of a rule meet it on one of its tokens.
    each = found.withColumn("token", F.explode("rule"))
    worse = (
        each.alias("a")
        .join(each.alias("b"), F.expr("a.token = b.token AND size(b.rule) < size(a.rule) AND b.confidence >= a.confidence AND size(array_except(b.rule, a.rule)) = 0"))
        .select(F.col("a.rule").alias("rule"))
        .distinct()
    )
    kept = found.join(worse, "rule", "left_anti")
    rarity = alone.filter("size(rule) = 1").select(F.col("rule")[0].alias("token"), F.col("n").alias("n_token"))
    anchor = kept.select("rule", F.explode("rule").alias("token")).join(rarity, "token").groupBy("rule").agg(F.min(F.struct("n_token", "token")).alias("m"))
    return written(kept.join(anchor.select("rule", F.col("m.token").alias("anchor")), "rule").select("rule", "n", "n_block", "confidence", "anchor"))


def judge(pages: DataFrame, labelled: DataFrame, rules=RULES, **mining) -> DataFrame:
    """page_id, host, path, rule, verdict and mined (the tokens of the most confident mined rule) of (page_id, url).

    A null URL has an empty host and path and fits nothing; it is allowed, as is any URL that no rule fits."""
    pages = pages.select("page_id", "url")
    mined = mine(labelled, **mining)
    own = pages.select("url").filter("url IS NOT NULL").distinct().withColumn("own", tokens(F.col("url")))
    index = mined.select("anchor", F.col("rule").alias("tokens"), "confidence")
    if fits_broadcast(index, 50_000):
        index = F.broadcast(index)
    hits = (
        own.withColumn("anchor", F.explode("own"))
        .join(index, "anchor")
        .filter(F.size(F.array_except("tokens", "own")) == 0)
        .groupBy("url")
        .agg(F.max(F.struct("confidence", "tokens")).alias("best"))
        .select("url", F.array_join("best.tokens", " ").alias("mined"))
    )
    rule, action = fixed_rule(F.col("host"), F.col("path"), rules)
    return (
        pages.join(hits, "url", "left")
        .withColumn("host", host_of(F.col("url")))
        .withColumn("path", path_of(F.col("url")))
        .select(
            "page_id",
            "host",
            "path",
            rule.alias("rule"),
            F.coalesce(action, F.when(F.col("mined").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
            "mined",
        )
    )


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """url and block of pages whose URL ends in the number of a labelled document: low quality or toxic ones are blocked."""
    number = F.try_to_number(F.regexp_extract(path_of(F.col("url")), r"/([0-9]{1,18})(?:\.[A-Za-z]+)?/?$", 1), F.lit("9" * 18)).cast("long")
    truth = labels.select("doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("block")).filter("block IS NOT NULL")
    return pages.select("url", number.alias("doc_id")).join(truth, "doc_id").select("url", "block")


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge every page of ``pages``, learning from those whose document is labelled."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, labelled_pages(pages, table(spark, sf_dir, "labels")))


# Token sets by enumeration of all subsets of a URL's tokens, which are few.
OP5_SQL = r"""
WITH p AS (
  SELECT page_id, url,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), u AS (SELECT DISTINCT url, host, path FROM p WHERE url IS NOT NULL),
h AS (
  SELECT url, 'h' || (len(l) - i) || '=' || l[i] AS tok
  FROM (SELECT url, list_filter(string_split(host, '.'), lambda x: x <> '') AS l FROM u), range(1, 64) r(i) WHERE i <= len(l)
), tok AS (
  SELECT url, tok FROM h
  UNION SELECT url, 'p=' || translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
    FROM (SELECT url, unnest(string_split(regexp_replace(path, '\.[A-Za-z]{1,5}$', ''), '/')) AS s FROM u) WHERE s <> '' AND NOT regexp_full_match(s, '[0-9]+')
  UNION SELECT url, 'q=' || k FROM (SELECT url, unnest(regexp_extract_all(url, '[?&]([^=&#?]+)=', 1)) AS k FROM u)
  UNION SELECT url, 'e=' || regexp_extract(path, '\.([A-Za-z]{1,5})$', 1) FROM u WHERE regexp_matches(path, '\.[A-Za-z]{1,5}$')
  UNION SELECT url, 'f' FROM u WHERE contains(url, '#')
), own AS (SELECT url, list(tok ORDER BY tok) AS toks FROM tok GROUP BY url),
lab AS (
  SELECT p.page_id, own.toks, (l.quality = 0 OR l.toxic = 1) AS block
  FROM p JOIN own USING (url) JOIN labels l ON l.doc_id = TRY_CAST(regexp_extract(path, '/([0-9]{1,18})(\.[A-Za-z]+)?/?$', 1) AS BIGINT)
  WHERE (l.quality = 0 OR l.toxic = 1) IS NOT NULL
), lim AS (SELECT greatest(8, CAST(floor(count(*) * 0.001) AS BIGINT)) AS least, count(*) FILTER (block) / count(*) AS base FROM lab),
subs AS (
  SELECT block, list_filter(toks, lambda x, i: (m >> (i - 1)) & 1 = 1) AS rule
  FROM lab, LATERAL (SELECT unnest(range(1, CAST(1 AS BIGINT) << len(toks))) AS m)
), cnt AS (SELECT rule, count(*) AS n, count(*) FILTER (block) AS nb FROM subs GROUP BY rule),
tried AS (SELECT count(*) AS m FROM cnt, lim WHERE nb >= least),
good AS (
  SELECT rule, nb / n AS conf FROM cnt, lim, tried WHERE nb >= least AND nb / n >= 0.5 AND nb / n > base
    AND nb * ln(nb / n / base) + CASE WHEN n > nb THEN (n - nb) * ln((1 - nb / n) / (1 - base)) ELSE 0 END >= ln(m / 0.05)
),
kept AS (
  SELECT rule, conf FROM good a WHERE NOT EXISTS (
    SELECT 1 FROM good b WHERE len(b.rule) < len(a.rule) AND b.conf >= a.conf AND list_has_all(a.rule, b.rule))
), hits AS (
  SELECT url, max({'c': conf, 't': rule}) AS best FROM own, kept WHERE list_has_all(toks, rule) GROUP BY url
), fixed(act, rh, rp) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
fit AS (
  SELECT host, path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(act, length(rh || rp)) AS act
  FROM (SELECT DISTINCT host, path FROM p), fixed
  WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY host, path
)
SELECT p.page_id, p.host, p.path, fit.rule, coalesce(fit.act, CASE WHEN hits.best IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
  array_to_string(hits.best.t, ' ') AS mined
FROM p LEFT JOIN fit ON p.host = fit.host AND p.path = fit.path LEFT JOIN hits ON p.url = hits.url
"""
