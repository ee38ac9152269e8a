"""Quality rules: base counts and robust multivariate outliers per language and source, in DataFrame functions only.

Every text gives a vector of transformed statistics.  For each (language, source) group a minimum-covariance-determinant
estimate of their centre and scatter is found by concentration steps from two deterministic starts; texts far from the
centre by Mahalanobis distance are rejected.  Vectors are whole numbers (thousandths), so that sums over a group are
exact in whatever order they are added, and equal vectors are counted before any step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, UPPER, join_checked, table, words, written

#: Statistics of the vector, in the order of the columns z0..: word length, symbols, repeated lines, repeated words, capitals.
P = 5
UNIT = 1000
#: Least standard deviation of each statistic, in units: a statistic that hardly varies must not turn into a trap.
FLOOR = (60, 120, 180, 180, 120)
#: Chi-square quantile with 5 degrees of freedom at 1 - 1e-6, the share of the subset, its consistency factor, steps, and
#: the rows a group needs for an estimate of its own; a smaller group takes its language's, then the whole corpus's.
CUTOFF, SHARE, CONSISTENCY, STEPS, LEAST = 36.0, 0.75, 1.45, 3, 100


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of (doc_id, text, lang, source); a null text has none of any."""
    d = docs.select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text"))
    d = d.select("*", words(F.col("text")).alias("w"), F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{SPACE}]")).alias("lines"))
    length = F.length("text")
    d = d.select(
        "doc_id",
        "lang",
        "source",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (length - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        (length - F.length(F.translate("text", UPPER, ""))).cast("long").alias("n_upper"),
        F.sort_array(_windows(F.col("w"))).alias("windows"),
    )
    return d.withColumn("n_repeat_words", _in_repeated(F.col("windows"))).drop("windows")


def _windows(w: Column) -> Column:
    """(hash, place) of every three-word window of the array ``w``."""
    n = F.size(w)
    key = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    some = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(key(i).alias("k"), i.alias("i")))
    return F.when(n >= 3, some).otherwise(F.array().cast("array<struct<k:bigint,i:int>>"))


def _in_repeated(windows: Column) -> Column:
    """How many words lie in a window that occurs twice or more; ``windows`` is sorted, so equal ones are neighbours.

    The places of repeated windows are sorted again, and each adds as many of its three words as are not covered yet."""
    key = lambda j: F.get(windows, j)["k"]
    again = F.filter(windows, lambda x, j: x["k"].eqNullSafe(key(j - 1)) | x["k"].eqNullSafe(key(j + 1)))
    places = F.sort_array(F.transform(again, lambda x: x["i"]))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(places, start, lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n")))["n"]


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def vector() -> list[Column]:
    """The transformed statistics of a row of counts, in whole thousandths."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    lines = F.greatest(F.col("n_lines"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    parts = [
        F.sqrt(F.col("word_chars") / n),
        F.sqrt(F.col("n_symbols") / n),
        F.sqrt(F.col("n_dup_lines") / lines),
        F.sqrt(F.col("n_repeat_words") / n),
        F.sqrt(F.col("n_upper") / chars),
    ]
    return [F.floor(p * UNIT + 0.5).cast("long").alias(f"z{i}") for i, p in enumerate(parts)]


Z = [f"z{i}" for i in range(P)]
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]


def _moments(rows: DataFrame, by: list[str], n: str = "n") -> DataFrame:
    """Exact counts, sums and sums of products of the vectors, each counted ``n`` times."""
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    return rows.groupBy(*by).agg(
        F.sum(n).alias("m"),
        *[F.sum(wide(n) * wide(z)).alias(f"s{i}") for i, z in enumerate(Z)],
        *[F.sum(wide(n) * wide(Z[i]) * wide(Z[j])).alias(f"q{i}{j}") for i, j in PAIRS],
    )


def _estimate(m: DataFrame, keys: list[str], grow: float) -> DataFrame:
    """Centres c.. and the Cholesky factor l.. of the scatter, with a floor under each variance, and its determinant."""
    d = lambda c: F.col(c).cast("double")
    out = m.select(*keys, "m", *[(d(f"s{i}") / d("m")).alias(f"c{i}") for i in range(P)], *[f"q{i}{j}" for i, j in PAIRS])
    cov = {(i, j): (d(f"q{i}{j}") / d("m") - F.col(f"c{i}") * F.col(f"c{j}")) * grow + (float(FLOOR[i] ** 2) if i == j else 0.0) for i, j in PAIRS}
    out = out.select(*keys, "m", *[f"c{i}" for i in range(P)], *[cov[i, j].alias(f"v{i}{j}") for i, j in PAIRS])
    for j in range(P):
        own = F.col(f"v{j}{j}")
        for k in range(j):
            own = own - F.col(f"l{j}{k}") * F.col(f"l{j}{k}")
        # Rounding must not leave a negative square below the floor.
        out = out.withColumn(f"l{j}{j}", F.sqrt(F.greatest(own, F.lit(1.0))))
        for i in range(j + 1, P):
            rest = F.col(f"v{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out = out.withColumn(f"l{i}{j}", rest / F.col(f"l{j}{j}"))
    det = F.lit(1.0)
    for j in range(P):
        det = det * F.col(f"l{j}{j}")
    return out.select(*keys, "m", det.alias("det"), *[f"c{i}" for i in range(P)], *[f"l{i}{j}" for i, j in PAIRS])


def _with_distance(rows: DataFrame, name: str = "d") -> DataFrame:
    """Squared Mahalanobis distance by forward substitution."""
    for i in range(P):
        y = F.col(f"z{i}") - F.col(f"c{i}")
        for k in range(i):
            y = y - F.col(f"l{i}{k}") * F.col(f"y{k}")
        rows = rows.withColumn(f"y{i}", y / F.col(f"l{i}{i}"))
    total = F.lit(0.0)
    for i in range(P):
        total = total + F.col(f"y{i}") * F.col(f"y{i}")
    return rows.withColumn(name, total).drop(*[f"y{i}" for i in range(P)])


def _concentrate(cells: DataFrame, model: DataFrame, keys: list[str]) -> DataFrame:
    """The cells of the nearest ``SHARE`` of each group: distances are binned, bins counted, and the first bins that
    hold the share are kept whole."""
    far = _with_distance(join_checked(cells, model.drop("m", "det"), keys, "inner"))
    far = far.select(*cells.columns, F.least(F.lit(4000), F.floor(F.log2(F.col("d") + 1.0) * 64)).cast("int").alias("bin"))
    bins = far.groupBy(*keys, "bin").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = bins.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(whole)).filter(F.col("upto") >= F.col("all") * SHARE)
    cut = written(held.groupBy(*keys).agg(F.min("bin").alias("last")))
    return join_checked(far, cut, keys, "inner").filter(F.col("bin") <= F.col("last")).drop("bin", "last")


GROUP = ["level", "g_lang", "g_source"]


def scatter(counts: DataFrame) -> DataFrame:
    """One estimate for each group at three levels: language and source, language, corpus (of at least LEAST rows).

    ``counts`` has lang, source and z0..: the rows to learn from."""
    cells = written(counts.groupBy("lang", "source", *Z).agg(F.count(F.lit(1)).alias("n")))
    levels = [
        cells.select(F.lit(k).alias("level"), F.when(F.lit(k < 2), F.coalesce("lang", F.lit(""))).otherwise("").alias("g_lang"), F.when(F.lit(k < 1), F.coalesce("source", F.lit(""))).otherwise("").alias("g_source"), *Z, "n")
        for k in range(3)
    ]
    rows = levels[0].unionByName(levels[1]).unionByName(levels[2]).groupBy(*GROUP, *Z).agg(F.sum("n").alias("n"))
    sizes = rows.groupBy(*GROUP).agg(F.sum("n").alias("m")).filter(F.col("m") >= LEAST)
    rows = written(join_checked(rows, written(sizes.drop("m")), GROUP, "inner"))
    # First start: coordinate-wise medians, each with its spread, as a diagonal scatter.
    middle = rows.select(*GROUP, "n", F.posexplode(F.array(*Z)).alias("dim", "z")).groupBy(*GROUP, "dim", "z").agg(F.sum("n").alias("n"))
    by = Window.partitionBy(*GROUP, "dim")
    ranked = middle.withColumn("upto", F.sum("n").over(by.orderBy("z").rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("all", F.sum("n").over(by))
    quart = lambda q: F.min(F.when(F.col("upto") >= F.col("all") * q, F.col("z")))
    spread = ranked.groupBy(*GROUP, "dim").agg(quart(0.5).alias("mid"), quart(0.25).alias("low"), quart(0.75).alias("high"))
    first = spread.groupBy(*GROUP).agg(
        *[F.max(F.when(F.col("dim") == i, F.col("mid").cast("double"))).alias(f"c{i}") for i in range(P)],
        *[F.max(F.when(F.col("dim") == i, F.greatest((F.col("high") - F.col("low")) / 1.349, F.lit(float(FLOOR[i]))))).alias(f"l{i}{i}") for i in range(P)],
    )
    first = first.select(*GROUP, F.lit(0).alias("start"), *[f"c{i}" for i in range(P)], *[(F.col(f"l{i}{j}") if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i, j in PAIRS])
    # Second start: the classical estimate of all rows.
    second = _estimate(_moments(rows, GROUP), GROUP, 1.0).withColumn("start", F.lit(1)).select(first.columns)
    model, keys = written(first.unionByName(second).withColumn("m", F.lit(0)).withColumn("det", F.lit(0.0))), [*GROUP, "start"]
    both = rows.withColumn("start", F.explode(F.array(F.lit(0), F.lit(1))))
    for _ in range(STEPS):
        model = written(_estimate(_moments(_concentrate(both, model, keys), keys), keys, CONSISTENCY))
    least = model.groupBy(*GROUP).agg(F.min(F.struct("det", "start")).alias("b")).select(*GROUP, F.col("b.start").alias("start"))
    return written(model.join(least, keys, "left_semi").drop("start", "det", "m"))


def apply_rules(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and distance of every row of (doc_id, text, lang, source).

    Null texts count as empty and fail the base; null languages and sources form groups of their own.  A text of a group
    (and language) too small for an estimate is held against the whole corpus's, and kept if there is none."""
    z = vector()
    counts = counted(docs)
    rows = written(counts.select("*", base_failed(F.col("n_words"), F.col("n_repeat_words")).alias("base_failed"), *z))
    model = scatter(rows.filter(~F.col("base_failed")))
    named = model.select(*GROUP, F.struct(*[f"c{i}" for i in range(P)], *[f"l{i}{j}" for i, j in PAIRS]).alias("e"))
    for k, (lang, source) in enumerate(((F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit(""))), (F.coalesce("lang", F.lit("")), F.lit("")), (F.lit(""), F.lit("")))):
        part = written(named.filter(F.col("level") == k).select("g_lang", "g_source", F.col("e").alias(f"e{k}")))
        rows = join_checked(rows.withColumn("g_lang", lang).withColumn("g_source", source), part, ["g_lang", "g_source"])
    rows = rows.withColumn("e", F.coalesce("e0", "e1", "e2")).select("*", "e.*").drop("e", "e0", "e1", "e2")
    rows = _with_distance(rows, "distance")
    return rows.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        F.coalesce(~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= CUTOFF), F.lit(False)).alias("kept"),
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge every whole text of ``documents``."""
    return apply_rules(table(spark, sf_dir, "documents"))


def _sql() -> str:
    """The same in SQL: one common table per start, step and estimate."""
    zs, cs = ", ".join(Z), ", ".join(f"c{i}" for i in range(P))
    ls = ", ".join(f"l{i}{j}" for i, j in PAIRS)
    group = ", ".join(GROUP)
    sums = ", ".join(["sum(n) AS m", *[f"CAST(sum(CAST(n AS HUGEINT) * z{i}) AS DOUBLE) AS s{i}" for i in range(P)], *[f"CAST(sum(CAST(n AS HUGEINT) * z{i} * z{j}) AS DOUBLE) AS q{i}{j}" for i, j in PAIRS]])

    def estimate(name: str, rows: str, keys: str, grow: float) -> str:
        centres = ", ".join(f"s{i} / CAST(m AS DOUBLE) AS c{i}" for i in range(P))
        cov = ", ".join(f"(q{i}{j} / CAST(m AS DOUBLE) - c{i} * c{j}) * {grow}::DOUBLE + {float(FLOOR[i] ** 2) if i == j else 0.0}::DOUBLE AS v{i}{j}" for i, j in PAIRS)
        chol = []
        for j in range(P):
            own = f"v{j}{j}" + "".join(f" - l{j}{k} * l{j}{k}" for k in range(j))
            chol.append(f"sqrt(greatest({own}, 1.0::DOUBLE)) AS l{j}{j}")
            for i in range(j + 1, P):
                rest = f"v{i}{j}" + "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
                chol.append(f"({rest}) / l{j}{j} AS l{i}{j}")
        det = "1.0::DOUBLE" + "".join(f" * l{j}{j}" for j in range(P))
        return (
            f"{name}_m AS (SELECT {keys}, {sums} FROM {rows} GROUP BY {keys}), {name}_v AS (SELECT {keys}, m, {centres}, {cov} FROM {name}_m), "
            f"{name}_l AS (SELECT {keys}, {cs}, {', '.join(chol)} FROM {name}_v), {name} AS (SELECT {keys}, {cs}, {ls}, {det} AS det FROM {name}_l)"
        )

    ys = []
    for i in range(P):
        y = f"z{i} - c{i}" + "".join(f" - l{i}{k} * y{k}" for k in range(i))
        ys.append(f"({y}) / l{i}{i} AS y{i}")
    distance = ", ".join(ys) + ", 0.0::DOUBLE" + "".join(f" + y{i} * y{i}" for i in range(P)) + " AS d"
    parts = [("word_chars", "n_words"), ("n_symbols", "n_words"), ("n_dup_lines", "n_lines"), ("n_repeat_words", "n_words"), ("n_upper", "word_chars")]
    vec = ", ".join(f"CAST(floor(sqrt({a} / CAST(greatest({b}, 1) AS DOUBLE)) * {UNIT} + 0.5::DOUBLE) AS BIGINT) AS z{i}" for i, (a, b) in enumerate(parts))
    levels = " UNION ALL ".join(f"SELECT {k} AS level, {'coalesce(lang, {0})'.format(chr(39) * 2) if k < 2 else chr(39) * 2} AS g_lang, {'coalesce(source, {0})'.format(chr(39) * 2) if k < 1 else chr(39) * 2} AS g_source, {zs}, n FROM cells" for k in range(3))
    dims = " UNION ALL ".join(f"SELECT {group}, {i} AS dim, z{i} AS z, n FROM rows_" for i in range(P))
    first = ", ".join([*[f"CAST(max(mid) FILTER (dim = {i}) AS DOUBLE) AS c{i}" for i in range(P)], *[f"max(greatest((high - low) / 1.349::DOUBLE, {float(FLOOR[i])}::DOUBLE)) FILTER (dim = {i}) AS l{i}{j}" if i == j else f"0.0::DOUBLE AS l{i}{j}" for i, j in PAIRS]])
    steps, model = [], "start0"
    for k in range(STEPS):
        steps.append(
            f"far{k} AS (SELECT *, CAST(least(4000, floor(log2(d + 1.0::DOUBLE) * 64)) AS INT) AS bin FROM (SELECT {group}, start, {zs}, n, {distance} FROM both_ JOIN {model} USING ({group}, start))), "
            f"cut{k} AS (SELECT {group}, start, min(bin) AS last FROM (SELECT *, sum(n) OVER (PARTITION BY {group}, start ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY {group}, start) AS every FROM far{k}) WHERE upto >= every * {SHARE}::DOUBLE GROUP BY {group}, start), "
            f"near{k} AS (SELECT far{k}.* FROM far{k} JOIN cut{k} USING ({group}, start) WHERE bin <= last), " + estimate(f"step{k}", f"near{k}", f"{group}, start", CONSISTENCY)
        )
        model = f"step{k}"
    return f"""WITH t AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ln FROM t),
win AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
twice AS (SELECT rid, k FROM win GROUP BY rid, k HAVING count(*) > 1),
cov AS (SELECT rid, count(DISTINCT i + o) AS n FROM win JOIN twice USING (rid, k), (VALUES (0), (1), (2)) v(o) GROUP BY rid),
cnt AS (SELECT rid, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
  CAST(len(ln) - len(list_distinct(ln)) AS BIGINT) AS n_dup_lines, len(ln) AS n_lines, length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS n_upper, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN cov USING (rid)),
z AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {vec} FROM cnt),
cells AS (SELECT lang, source, {zs}, count(*) AS n FROM z WHERE NOT base_failed GROUP BY lang, source, {zs}),
lev AS (SELECT level, g_lang, g_source, {zs}, sum(n) AS n FROM ({levels}) GROUP BY level, g_lang, g_source, {zs}),
big AS (SELECT {group} FROM lev GROUP BY {group} HAVING sum(n) >= {LEAST}), rows_ AS (SELECT lev.* FROM lev JOIN big USING ({group})),
dim AS (SELECT {group}, dim, z, sum(n) AS n FROM ({dims}) GROUP BY {group}, dim, z),
ran AS (SELECT *, sum(n) OVER (PARTITION BY {group}, dim ORDER BY z) AS upto, sum(n) OVER (PARTITION BY {group}, dim) AS every FROM dim),
quart AS (SELECT {group}, dim, min(z) FILTER (upto >= every * 0.5::DOUBLE) AS mid, min(z) FILTER (upto >= every * 0.25::DOUBLE) AS low, min(z) FILTER (upto >= every * 0.75::DOUBLE) AS high FROM ran GROUP BY {group}, dim),
one AS (SELECT {group}, 0 AS start, {first} FROM quart GROUP BY {group}), {estimate('two', 'rows_', group, 1.0)},
start0 AS (SELECT {group}, start, {cs}, {ls} FROM one UNION ALL SELECT {group}, 1, {cs}, {ls} FROM two),
both_ AS (SELECT rows_.*, s.start FROM rows_, (VALUES (0), (1)) s(start)),
{', '.join(steps)},
best AS (SELECT * FROM {model} QUALIFY row_number() OVER (PARTITION BY {group} ORDER BY det, start) = 1),
pick AS (SELECT z.*, g.level, row_number() OVER (PARTITION BY rid ORDER BY g.level) AS k, {', '.join(f'g.c{i} AS c{i}' for i in range(P))}, {', '.join(f'g.l{i}{j} AS l{i}{j}' for i, j in PAIRS)}
  FROM z LEFT JOIN best g ON (g.level = 0 AND g.g_lang = coalesce(z.lang, '') AND g.g_source = coalesce(z.source, '')) OR (g.level = 1 AND g.g_lang = coalesce(z.lang, '')) OR g.level = 2 QUALIFY k = 1),
far AS (SELECT *, {distance} FROM pick)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(d, 0) <= {CUTOFF}::DOUBLE AS kept FROM far"""


OP2_SQL = _sql()
