"""Secret scans by multipart credential linking.

Strong findings stand by themselves: assigned secrets, access identifiers and long hex strings. Weak parts (an account name, a short password, an
address) are reported only where complementary parts co-occur: an identifier or an address beside a secret, a secret beside an identifier or an
address. Beside means in one scope (the stretch between blank lines) and at most ``REACH`` code points apart.

Texts are scanned once, whole; only intervals go on. Weak parts, widened by the reach, and the parts that may complement them are joined as intervals:
both are dealt into cells of ``REACH`` code points, and of each cell, scope and role the first start and last end of its parts are all that a weak part
needs: it is wider than a cell on either side, so within a cell a part is in reach if those bounds are. So a cell has one row for each role however many parts
stand in it, and neither a crowded scope nor a long one is ever paired out.

A null or empty text has no spans. Rows that repeat, also with a null doc_id, each give a row. Very long texts are scanned whole. Spans of one kind never
overlap (the leftmost counts); weak spans that overlap a strong one, or an earlier weak one, are left out. Ties in start go by the order of ``KINDS``. Columns beyond
doc_id and text play no part.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, drop_inputs, table

REACH = 256
#: Kinds by their order in results: strong ones, then weak ones.
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
IDENTIFIER, SECRET, ENDPOINT = range(3)
#: The role of each kind.
ROLE = (SECRET, IDENTIFIER, SECRET, IDENTIFIER, SECRET, ENDPOINT)
STRONG = 3

#: Pattern and least length of a group, by kind; the first three are fixed values.
PATTERNS = (
    (re.compile(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII), 1, 6),
    (re.compile(r"AKIA[A-Z0-9]{16,}"), 0, 20),  # a run that is long enough is found whole, as without the bound
    (re.compile(r"[0-9a-f]{24,}"), 0, 24),
    (re.compile(r"\b(?i:access_?key_?id|client_?id|account|user_?name|user|login|uid)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9@+/_.-]+)", re.ASCII), 1, 2),
    (re.compile(r"\b(?i:passphrase|pass|pwd|pin|private_?key|access_?key|auth_?key|credentials?|bearer)[\"']?\x20*[:=]\x20*[\"']?([^\s\"',;]+)", re.ASCII), 1, 4),
    (re.compile(r"\b(?:[a-z][a-z0-9+.-]{1,30}://[^\s\"'<>]+|(?i:host|host_?name|endpoint|server)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9.-]+(?::[0-9]+)?)", re.ASCII), 0, 5),
)
#: A text without any of these, in lower case, has no finding of the kind, so its pattern isn't tried.
HINTS = (
    ("password", "passwd", "secret", "token", "api_key", "apikey"), ("akia",), ("",),
    ("access", "client", "account", "user", "login", "uid"), ("pass", "pwd", "pin", "key", "credential", "bearer"), ("://", "host", "endpoint", "server"),
)
BLANK = re.compile(r"\n[\x20\t\r]*\n")


def matches(text: str, lower: str, kind: int):
    """Start and end of each finding of a kind: leftmost and not overlapping, those with a long enough group."""
    pattern, group, least = PATTERNS[kind]
    if not any(h in lower for h in HINTS[kind]):
        return []
    return [m.span() for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]


def spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int]]]:
    """Strong findings as (start, kind, end), and weak ones with their scope, both sorted; a weak one overlaps no strong and no earlier weak one."""
    lower = text.lower()
    strong = sorted((s, k, e) for k in range(STRONG) for s, e in matches(text, lower, k))
    weak = sorted((s, k, e) for k in range(STRONG, len(KINDS)) for s, e in matches(text, lower, k))
    blanks = [m.start() for m in BLANK.finditer(text)] if weak else []
    out, at, scope, end, reached = [], 0, 0, -1, -1
    for s, k, e in weak:
        while at < len(strong) and strong[at][0] < e:  # the furthest end of a strong one that starts before this one ends
            reached, at = max(reached, strong[at][2]), at + 1
        while scope < len(blanks) and blanks[scope] < s:
            scope += 1
        if s >= end and reached <= s:
            out.append((s, k, e, scope))
            end = e
    scope, parts = 0, []
    for s, k, e in strong if out else []:
        while scope < len(blanks) and blanks[scope] < s:
            scope += 1
        parts.append((s, k, e, scope))
    return strong, sorted(parts + out)


SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
PART = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("scope", pa.int32())])


def _scan(batches):
    for batch in batches:
        for i in range(0, batch.num_rows, 64):
            some = batch.slice(i, 64)
            found = [spans(x.as_py() or "") for x in some.column(1)]
            strong = [[dict(zip(("start", "kind", "end"), s, strict=True)) for s in f[0]] for f in found]
            parts = [[dict(zip(("start", "kind", "end", "scope"), p, strict=True)) for p in f[1]] for f in found]
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(strong, pa.list_(SPAN)), pa.array(parts, pa.list_(PART))], ["doc_id", "strong", "parts"])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, strong findings, and the parts to be linked (weak findings, and strong ones of texts that have weak ones)."""
    of = "start int, kind int, end int"
    return drop_inputs(docs, "doc_id", "text").selectExpr("CAST(doc_id AS bigint) AS doc_id", "text").mapInArrow(_scan, f"doc_id long, strong array<struct<{of.replace(' int', ': int')}>>, parts array<struct<{of.replace(' int', ': int')}, scope: int>>")


def linked(parts: DataFrame, reach: int = REACH) -> DataFrame:
    """_row, start, kind, end of the weak parts that have a complementary part in reach, and near: which roles. parts: _row, scope, start, kind, end."""
    role = F.element_at(F.array(*map(F.lit, ROLE)), F.col("kind") + 1)
    cells = lambda a, b: F.explode(F.sequence(F.floor(a / reach), F.floor((b - 1) / reach))).alias("cell")
    held = parts.select("_row", "scope", cells(F.col("start"), F.col("end")), role.alias("role"), "start", "end")
    held = held.groupBy("_row", "scope", "cell").agg(*[f(F.when(F.col("role") == r, F.col(c))).alias(f"{c}{r}") for r in range(3) for c, f in (("start", F.min), ("end", F.max))])
    wide = parts.filter(F.col("kind") >= STRONG).select("_row", "scope", "start", "kind", "end", role.alias("role"), cells(F.col("start") - reach, F.col("end") + reach))
    near = [F.coalesce((F.col(f"start{r}") < F.col("w.end") + reach) & (F.col(f"end{r}") > F.col("w.start") - reach), F.lit(False)) for r in range(3)]
    both = wide.alias("w").join(held.alias("h"), ["_row", "scope", "cell"]).select("_row", "w.start", "kind", "w.end", "role", F.array(*near).alias("near"))
    seen = both.groupBy("_row", "start", "kind", "end", "role").agg(*[F.max(F.get("near", r)).alias(f"near{r}") for r in range(3)])
    beside = F.when(F.col("role") == SECRET, F.col(f"near{IDENTIFIER}") | F.col(f"near{ENDPOINT}")).otherwise(F.col(f"near{SECRET}"))
    return seen.filter(beside).select("_row", "start", "kind", "end", F.array(*[F.col(f"near{r}") for r in range(3)]).alias("near"))


def find_secrets(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """doc_id, strong: findings that stand by themselves, and spans: those and the linked weak ones, each as (start, kind, end), sorted; kind is an index of ``KINDS``."""
    found = Scratch(docs.sparkSession, "secrets").keep(scan(docs).withColumn("_row", F.monotonically_increasing_id()))
    weak = linked(found.filter(F.size("parts") > 0).select("_row", F.inline("parts")), reach).groupBy("_row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("weak"))
    out = found.join(weak, "_row", "left")
    every = F.when(F.col("weak").isNull(), F.col("strong")).otherwise(F.array_sort(F.concat("strong", "weak")))
    return out.select("doc_id", "strong", every.alias("spans"))


def written(spans: Column) -> Column:
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    n = lambda k: F.size(F.filter("strong", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", *[n(k) for k in range(STRONG)], F.sha2(written(F.col("strong")).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find_secrets(table(spark, sf_dir, "documents")))


def oracle() -> str:
    """Findings by marks put around them, positions by the lengths between the marks, links by a join of all parts of a scope."""
    either = lambda words: re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", words)  # noqa: E731  (ASCII letters only; (?i) would take others too)
    assign = "(?:" + either("password|passwd|secret|token|api_?key") + r""")["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    login = r"\b(?:" + either("access_?key_?id|client_?id|account|user_?name|user|login|uid") + r""")["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9@+/_.-]+)"""
    word = r"\b(?:" + either("passphrase|pass|pwd|pin|private_?key|access_?key|auth_?key|credentials?|bearer") + r""")["'']?\x20*[:=]\x20*["'']?([^\s"'',;]+)"""
    where = r"""\b(?:[a-z][a-z0-9+.-]{1,30}://[^\s"''<>]+|(?:""" + either("host|host_?name|endpoint|server") + r""")["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9.-]+(?::[0-9]+)?)()"""
    kinds = [(0, "assign", assign, "length(g) >= 6"), (1, "access", "AKIA[A-Z0-9]+()", "length(m) >= 20"), (2, "hex", "[0-9a-f]+()", "length(m) >= 24"),
             (3, "identifier", login, "length(g) >= 2"), (4, "secret", word, "length(g) >= 4"), (5, "endpoint", where, "length(m) >= 5")]
    # chr(57344) before a match, chr(57345) between it and its group, chr(57346) behind; texts hold none of them.
    marked = " UNION ALL ".join(f"SELECT k, {i} AS kind, '{n}' AS name, string_split(regexp_replace(text, '({p})', chr(57344) || '\\1' || chr(57345) || '\\2' || chr(57346), 'g'), chr(57344)) AS x FROM d" for i, n, p, _ in kinds)
    fits = " OR ".join(f"(kind = {i} AND {c})" for i, _, _, c in kinds)
    return rf"""WITH d AS (SELECT doc_id, row_number() OVER () AS k, coalesce(text, '') AS text FROM documents),
x AS ({marked}),
y AS (SELECT k, kind, name, u.j AS j, string_split(u.p, chr(57346)) AS p FROM (SELECT k, kind, name, unnest(list_transform(x, lambda v, i: {{'j': i, 'p': v}})) AS u FROM x WHERE len(x) > 1)),
z AS (SELECT k, kind, name, j, string_split(p[1], chr(57345))[1] AS m, string_split(p[1], chr(57345))[2] AS g, coalesce(p[2], '') AS rest FROM y),
q AS (SELECT *, sum(CASE WHEN j = 1 THEN length(m) ELSE length(m) + length(rest) END) OVER (PARTITION BY k, kind ORDER BY j) - CASE WHEN j = 1 THEN 0 ELSE length(m) + length(rest) END AS a FROM z),
found AS (SELECT k, kind, name, CAST(a AS BIGINT) AS a, CAST(a + length(m) AS BIGINT) AS b FROM q WHERE j > 1 AND ({fits})),
weak0 AS (SELECT * FROM found f WHERE kind >= 3 AND NOT EXISTS (SELECT 1 FROM found s WHERE s.k = f.k AND s.kind < 3 AND s.a < f.b AND s.b > f.a)),
weak AS (SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY a, kind) AS n FROM weak0) w WHERE NOT EXISTS (SELECT 1 FROM weak0 v WHERE v.k = w.k AND (v.a < w.a OR (v.a = w.a AND v.kind < w.kind)) AND v.b > w.a)),
part AS (SELECT p.*, length(regexp_replace(substring(d.text, 1, CAST(p.a AS INT)), '\n[ \t\r]*\n', chr(57344), 'g')) - length(replace(regexp_replace(substring(d.text, 1, CAST(p.a AS INT)), '\n[ \t\r]*\n', chr(57344), 'g'), chr(57344), '')) AS scope,
  [1, 0, 1, 0, 1, 2][kind + 1] AS role FROM (SELECT * FROM weak UNION ALL SELECT * FROM found WHERE kind < 3 AND k IN (SELECT k FROM weak)) p JOIN d USING (k)),
linked AS (SELECT DISTINCT w.k, w.kind, w.name, w.a, w.b FROM part w JOIN part o ON o.k = w.k AND o.scope = w.scope AND o.a < w.b + {REACH} AND o.b > w.a - {REACH} AND ((w.role = 1) <> (o.role = 1)) WHERE w.kind >= 3),
s AS (SELECT k, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, string_agg(name || ':' || a || ':' || b, ',' ORDER BY a, kind) FILTER (kind < 3) AS base,
  string_agg(name || ':' || a || ':' || b, ',' ORDER BY a, kind) AS every FROM (SELECT * FROM found WHERE kind < 3 UNION ALL SELECT * FROM linked) GROUP BY k)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans FROM d LEFT JOIN s USING (k)"""
