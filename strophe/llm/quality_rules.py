"""Quality rules: fixed base rules, then robust multivariate outliers by minimum covariance determinant.

Every text gives counts, and six transformed statistics in fixed point (1/256). For each language and
source the minimum-covariance-determinant estimate is searched: three deterministic starts (rows nearest to the
medians by Euclidean, largest and summed robust deviation) are each improved by concentration steps on the nearest three
quarters of the rows, and the start whose covariance has the least determinant wins. Documents whose squared Mahalanobis
distance exceeds the chi-square quantile of ``level`` are rejected. A variance is raised only where it is degenerate (LEAST_SD).
Only DataFrame functions: one pass over texts, then passes over a small table of counts.

Sums are sums of integers, so the verdict depends neither on partitions nor on the order of rows.
Groups of under ``least`` rows use the estimate of their language, or else of all rows; under ``least`` rows in all, only the
base rules hold. A null text counts as having no words (base_failed); null language or source is a group of its own.
Repeated rows count as often as they occur. Rows at the same distance are in the estimate together; of starts with equal determinants
the first wins. Null doc_ids and repeated ones are rows like any other.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, Scratch, drop_inputs, fresh, let, row_key, small, table

SYMBOLS = "#*$%&|<>"
NAMES = ("len", "size", "symbol", "upper", "line", "repeat")
D = range(len(NAMES))
#: A standard deviation below this is degenerate. Length, size and capitals: the resolution of the fixed point. The others are 0 in most
#: documents, so that most subsets have no variance; their unit is a share of half a per cent of symbols, or 2.3 % of repeated lines or words.
LEAST_SD = (0.02, 0.02, math.log1p(0.5), 0.02, math.log1p(2.3), math.log1p(2.3))
#: The factor that makes the covariance of the three quarters nearest to the centre consistent for normal rows.
CONSISTENT = 1.36
LEVEL = 1e-6  # share of normal rows beyond the cut
STARTS = 3
STEPS = 4
LEAST = 60


def chi_square_cut(level: float, freedom: int = len(NAMES)) -> float:
    """The distance that a chi-square variable of an even number of degrees of freedom exceeds with this probability."""
    beyond = lambda x: math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(freedom // 2))
    low, high = 0.0, 1e4
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if beyond(middle) > level else (low, middle)
    return low


def _fixed(x: str) -> str:
    return f"CAST(floor(256.0 * {x} + 0.5) AS BIGINT)"


#: The statistics, in SQL that Spark and DuckDB read alike.
VECTOR = {
    "len": _fixed("ln(1.0 + n_words)"),
    "size": _fixed("ln(1.0 + CAST(word_chars AS DOUBLE) / greatest(n_words, 1))"),
    "symbol": _fixed("ln(1.0 + 100.0 * n_symbols / greatest(word_chars, 1))"),
    "upper": _fixed("ln(1.0 + 100.0 * n_upper / greatest(word_chars, 1))"),
    "line": _fixed("ln(1.0 + 100.0 * n_dup_lines / greatest(n_lines, 1))"),
    "repeat": _fixed("ln(1.0 + 100.0 * n_repeat_words / greatest(n_words, 1))"),
}
PAIRS = [(i, j) for i in D for j in D if j <= i]


def factor(n: str = "n") -> list[tuple[str, str]]:
    """Means, Cholesky factor and log determinant of the covariance, from sums s_i and s_ij; each line may use those before."""
    out = [(f"m{i}", f"CAST(s{i} AS DOUBLE) / {n}") for i in D]
    for i, j in PAIRS:
        cov = f"{CONSISTENT} * (CAST(s{i}_{j} AS DOUBLE) / {n} - m{i} * m{j})"
        if i == j:
            cov = f"greatest({cov}, {(256 * LEAST_SD[i]) ** 2!r})"
        rest = " - ".join([f"({cov})"] + [f"l{i}_{k} * l{j}_{k}" for k in range(j)])
        out.append((f"l{i}_{j}", f"sqrt(greatest({rest}, 1.0))" if i == j else f"({rest}) / l{j}_{j}"))
    return [*out, ("logdet", " + ".join(f"2 * ln(l{i}_{i})" for i in D))]


def distance() -> list[tuple[str, str]]:
    """The squared Mahalanobis distance d2 by forward substitution."""
    out = [(f"z{i}", "(" + " - ".join([f"(x{i} - m{i})"] + [f"l{i}_{k} * z{k}" for k in range(i)]) + f") / l{i}_{i}") for i in D]
    return [*out, ("d2", " + ".join(f"z{i} * z{i}" for i in D))]


_dev = [f"abs(x{i} - c{i}) / greatest(1.4826 * a{i}, {256 * LEAST_SD[i]!r})" for i in D]
#: Squared distance from the medians, in each start's own norm.
START = f"CASE start WHEN 0 THEN {' + '.join(f'pow({v}, 2)' for v in _dev)} WHEN 1 THEN pow(greatest({', '.join(_dev)}), 2) ELSE pow({' + '.join(_dev)}, 2) END"
#: Rows of one shell of distance are in or out together: steps of 1/256 of the logarithm.
SHELL = "CAST(floor(256.0 * ln(1.0 + d2)) AS BIGINT)"


def counts(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang, source, the columns to carry along and the counts of each whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.array_remove(F.split(text, SPACE), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def repeats(w):
        """Words in windows of three that occur twice: equal hashes stand together once sorted with their places."""
        grams = F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)))

        def covered(p):
            return F.aggregate(F.transform(p, lambda x, i: F.when(i + 1 < F.size(p), F.least(F.lit(3), F.get(p, i + 1) - x)).otherwise(3)), F.lit(0), lambda a, b: a + b)

        def places(s):
            at = lambda i: F.get(s, i)["h"]
            kept = F.filter(F.transform(s, lambda x, i: F.when((at(i - 1) == x["h"]) | (at(i + 1) == x["h"]), x["i"])), lambda x: x.isNotNull())
            return let(F.sort_array(kept), covered)

        def among(g):
            ordered = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
            return F.when(F.size(F.array_distinct(g)) < F.size(g), let(ordered, places)).otherwise(0)

        return F.when(F.size(w) >= 3, let(grams, among)).otherwise(0)

    w = F.col("_words")
    own = ("doc_id", "lang", "source", *carry)
    out = drop_inputs(docs, *own, "text").withColumn("_words", words)
    return out.select(
        *own,
        let(w, lambda v: F.struct(F.size(v).cast("long").alias("n_words"), repeats(v).cast("long").alias("n_repeat_words"))).alias("_w"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(text, r"\P{Lu}+", "")).cast("long").alias("n_upper"),
        let(lines, lambda v: F.struct(F.size(v).cast("long").alias("n"), (F.size(v) - F.size(F.array_distinct(v))).cast("long").alias("dup"))).alias("_l"),
    ).select(*own, "_w.n_words", "word_chars", "n_symbols", F.col("_l.dup").alias("n_dup_lines"), "_w.n_repeat_words", F.col("_l.n").alias("n_lines"), "n_upper")


BASE = "(n_words < 50 OR 100 * n_repeat_words > 50 * n_words)"


def _named(df: DataFrame, exprs: list[tuple[str, str]], keep: list[str]) -> DataFrame:
    """Adds each expression in turn (a lateral alias of the ones before), then keeps some columns."""
    return df.selectExpr("*", *[f"{e} AS {n}" for n, e in exprs]).select(*keep)


OUT = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def quality_rules(docs: DataFrame, level: float = LEVEL, least: int = LEAST, steps: int = STEPS, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, columns to carry along, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance (null if base_failed or no estimate)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    out = (OUT[0], *carry, *OUT[1:])
    x = [f"x{i}" for i in D]
    stats = scratch.keep(counts(docs, carry).selectExpr("*", f"{BASE} AS base_failed", *[f"{VECTOR[k]} AS x{i}" for i, k in enumerate(NAMES)]))

    per = stats.filter("NOT base_failed").groupBy("lang", "source").agg(F.count("*").alias("n"))
    per = scratch.keep(per.selectExpr("lang", "source", "n", "sum(n) OVER (PARTITION BY lang) AS n_lang"))
    total = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    if total < least:
        return stats.selectExpr(*out, "NOT base_failed AS kept", "CAST(NULL AS DOUBLE) AS distance")

    # A group takes part in its own estimate only; small ones are pooled with all rows of the language, or all rows.
    pooling = per.selectExpr("lang", "source", f"CASE WHEN n >= {least} THEN 0 WHEN n_lang >= {least} THEN 1 ELSE 2 END AS pool")
    of = F.col("d.lang").eqNullSafe(F.col("g.lang")) & F.col("d.source").eqNullSafe(F.col("g.source"))
    rows = stats.alias("d").join(small(pooling, 20_000).alias("g"), of, "left").select("d.*", F.coalesce("pool", F.lit(2)).alias("pool"))
    needed = sorted(r[0] for r in pooling.select("pool").distinct().collect())
    none = F.lit(None).cast("string")
    ids = {0: (F.col("lang"), F.col("source")), 1: (F.col("lang"), none), 2: (none, none)}
    name = lambda k: F.to_json(F.struct(F.lit(k).alias("k"), ids[k][0].alias("l"), ids[k][1].alias("s")))

    # x and the names of the estimates that a row takes part in; a row takes part in pooled ones too where any group needs them
    base = rows.filter("NOT base_failed").select(F.explode(F.array(*[name(k) for k in needed])).alias("g"), *x)
    centre = scratch.keep(base.groupBy("g").agg(*[F.expr(f"percentile(x{i}, 0.5)").alias(f"c{i}") for i in D]))
    joined = base.join(small(centre, 20_000), "g")
    spread = joined.groupBy("g").agg(*[F.max(f"c{i}").alias(f"c{i}") for i in D], *[F.expr(f"percentile(abs(x{i} - c{i}), 0.5)").alias(f"a{i}") for i in D])
    params, dist = scratch.keep(spread.select("*", F.explode(F.sequence(F.lit(0), F.lit(STARTS - 1))).alias("start"))), [("d2", START)]
    for _ in range(steps):
        near = _named(base.join(small(params, 60_000), "g"), dist, ["g", "start", *x, "d2"])
        shells = near.groupBy("g", "start", F.expr(SHELL).alias("shell")).agg(
            F.count("*").alias("n"), *[F.sum(f"x{i}").alias(f"s{i}") for i in D], *[F.sum(F.expr(f"x{i} * x{j}")).alias(f"s{i}_{j}") for i, j in PAIRS])
        seen = shells.selectExpr("*", "sum(n) OVER (PARTITION BY g, start ORDER BY shell) AS upto", "sum(n) OVER (PARTITION BY g, start) AS total")
        inner = seen.filter("upto - n < (3 * total + 3) div 4")
        sums = inner.groupBy("g", "start").agg(F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in D], *[F.sum(f"s{i}_{j}").alias(f"s{i}_{j}") for i, j in PAIRS])
        f = factor()
        params, dist = scratch.keep(_named(sums, f, ["g", "start", *[n for n, _ in f]])), distance()
    best = params.groupBy("g").agg(F.min_by(F.struct(*[n for n, _ in f]), F.struct("logdet", "start")).alias("p")).select("g", "p.*")

    own = rows.withColumn("g", F.when(F.col("pool") == 0, name(0)).when(F.col("pool") == 1, name(1)).otherwise(name(2)))
    judged = _named(own.join(small(scratch.keep(best), 20_000), "g", "left"), dist, [*out, "d2"])
    return judged.selectExpr(*out, f"NOT base_failed AND coalesce(d2 <= {chi_square_cut(level)!r}, TRUE) AS kept", "CASE WHEN NOT base_failed THEN round(sqrt(d2), 2) END AS distance")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).drop("distance")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass. Each is judged by itself, so null and repeated doc_ids keep what passes and lose what doesn't."""
    key = fresh(docs, "_key")
    keyed = docs.withColumn(key, row_key("doc_id", "lang", "source", "text"))
    bad = quality_rules(keyed, carry=(key,)).filter("NOT kept").select(key).distinct()
    return keyed.join(bad, key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def nested(exprs: list[tuple[str, str]], query: str) -> str:
    """query with each expression added by a SELECT of its own: DuckDB would write out a lateral alias wherever it is used."""
    for n, e in exprs:
        query = f"SELECT *, {e} AS {n} FROM ({query})"
    return query


def oracle(documents: str = "documents") -> str:
    """The same in DuckDB, by formulas of its own: averages instead of integer sums, ranks instead of shell counts, and an
    LDL factor (no roots) instead of Cholesky's; transforms, floors and the chi-square quantile of 6 degrees at 1e-6 are written out."""
    least = [5.12, 5.12, 103.799067, 5.12, 305.644152, 305.644152]  # 256 times 0.02, ln 1.5 and ln 3.3
    six, low = range(6), [(i, j) for i in range(6) for j in range(i + 1)]
    deviations = [f"abs(x{i} - c{i}) / greatest(1.4826 * a{i}, {least[i]})" for i in six]
    first = f"list_aggregate([{', '.join(f'({v}) * ({v})' for v in deviations)}], 'sum')", f"power(list_max([{', '.join(deviations)}]), 2)", f"power(list_sum([{', '.join(deviations)}]), 2)"
    moments = ", ".join([f"avg(x{i}) AS m{i}" for i in six] + [f"avg(x{i} * x{j}) AS q{i}{j}" for i, j in low])
    factors = []  # covariance = L D L', a line for each entry
    for i, j in low:
        c = f"1.36 * (q{i}{j} - m{i} * m{j})"
        c = f"greatest({c}, {least[i] ** 2})" if i == j else c
        rest = c + "".join(f" - u{i}{k} * u{j}{k} * v{k}" for k in range(j))
        factors.append((f"v{i}", rest) if i == j else (f"u{i}{j}", f"({rest}) / v{j}"))
    solved = [(f"y{i}", f"x{i} - m{i}" + "".join(f" - u{i}{k} * y{k}" for k in range(i))) for i in six]
    d2 = [*solved, ("d2", " + ".join(f"y{i} * y{i} / v{i}" for i in six))]
    names = [n for n, _ in factors] + [f"m{i}" for i in six]
    xs = ", ".join(f"x{i}" for i in six)
    label = "coalesce('v' || lang, 'n')", "coalesce('v' || source, 'n')"
    ctes = [
        f"""w AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, lang, source, coalesce(text, '') AS text,
  list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda v: v <> '') AS ws,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda v: regexp_matches(v, '[^ \t-\r]')) AS ls FROM {documents})""",
        """g AS MATERIALIZED (SELECT k, i, count(*) OVER (PARTITION BY k, ws[i], ws[i + 1], ws[i + 2]) AS n FROM (SELECT k, ws, unnest(range(1, len(ws) - 1)) AS i FROM w))""",
        "r AS MATERIALIZED (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS p FROM g WHERE n > 1) GROUP BY k)",
        """b AS (SELECT w.k, doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(list_sum(list_transform(ws, lambda v: length(v))) AS BIGINT) AS chars,
  CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
  len(ls) AS n_lines, len(regexp_extract_all(text, '\\p{Lu}')) AS n_upper FROM w LEFT JOIN r ON w.k = r.k)""",
        """t AS MATERIALIZED (SELECT *, n_words < 50 OR n_repeat_words * 2 > n_words AS base_failed, coalesce(chars, 0) AS word_chars,
  [ln(1 + n_words::DOUBLE), ln(1 + coalesce(chars, 0)::DOUBLE / greatest(n_words, 1)), ln(1 + 100.0::DOUBLE * n_symbols / greatest(chars, 1)), ln(1 + 100.0::DOUBLE * n_upper / greatest(chars, 1)),
   ln(1 + 100.0::DOUBLE * n_dup_lines / greatest(n_lines, 1)), ln(1 + 100.0::DOUBLE * n_repeat_words / greatest(n_words, 1))] AS v FROM b)""",
        f"s AS MATERIALIZED (SELECT * EXCLUDE (v), {', '.join(f'floor(256 * v[{i + 1}] + 0.5) AS x{i}' for i in six)}, count(*) FILTER (NOT base_failed) OVER (PARTITION BY lang, source) AS n_own, count(*) FILTER (NOT base_failed) OVER (PARTITION BY lang) AS n_lang, count(*) FILTER (NOT base_failed) OVER () AS n_all FROM t)",
        f"own AS MATERIALIZED (SELECT *, CASE WHEN n_own >= {LEAST} THEN '0' || {label[0]} || chr(1) || {label[1]} WHEN n_own > 0 AND n_lang >= {LEAST} THEN '1' || {label[0]} ELSE '2' END AS g FROM s)",
        f"part AS MATERIALIZED (SELECT {xs}, unnest(['0' || {label[0]} || chr(1) || {label[1]}, '1' || {label[0]}, '2']) AS g FROM s WHERE NOT base_failed)",
        f"mid AS MATERIALIZED (SELECT g, {', '.join(f'median(x{i}) AS c{i}' for i in six)} FROM part GROUP BY g)",
        f"wide AS MATERIALIZED (SELECT g, {', '.join(f'any_value(c{i}) AS c{i}, median(abs(x{i} - c{i})) AS a{i}' for i in six)} FROM part JOIN mid USING (g) GROUP BY g)",
        f"e0 AS MATERIALIZED (SELECT g, start, {xs}, CASE start WHEN 0 THEN {first[0]} WHEN 1 THEN {first[1]} ELSE {first[2]} END AS d2 FROM part JOIN wide USING (g), (VALUES (0), (1), (2)) starts(start))",
    ]
    for k in range(STEPS):
        ctes += [
            f"h{k} AS MATERIALIZED (SELECT *, rank() OVER (PARTITION BY g, start ORDER BY floor(256 * ln(1 + d2))) AS place, count(*) OVER (PARTITION BY g, start) AS of FROM e{k})",
            f"p{k} AS MATERIALIZED (SELECT g, start, {', '.join(names)} FROM ({nested(factors, f'SELECT g, start, {moments} FROM h{k} WHERE place <= ceil(0.75 * of) GROUP BY g, start')}))",
        ]
        if k + 1 < STEPS:
            ctes.append(f"e{k + 1} AS MATERIALIZED (SELECT g, start, {xs}, d2 FROM ({nested(d2, f'SELECT * FROM part JOIN p{k} USING (g)')}))")
    determinant = " + ".join(f"ln(v{i})" for i in six)
    return (
        "WITH " + ",\n".join(ctes) + f""",
chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY {determinant}, start) AS choice FROM p{STEPS - 1}) WHERE choice = 1),
judged AS ({nested(d2, 'SELECT * FROM own LEFT JOIN chosen USING (g)')})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND (n_all < {LEAST} OR coalesce(d2 <= 38.2583, TRUE)) AS kept FROM judged"""
    )
