"""URL filters: a blocked Bloom filter of listed canonical URLs passes possible hits to an exact hash join.

A listed key is a host followed by a path prefix. The filter holds the keys and their hosts: of a url, each parent domain that has as many labels as some listed host, and that it lets through, is
tried with each listed path length up to that of the url's path; keys that the filter lets through are joined exactly with the list, and the longest wins.
Rules take a url's host as it stands; the list takes its canonical form, without user part, port and closing dot. A url of any length costs a few passes over its
text, as many as the listed hosts and paths have lengths, not as it has labels.
The filter is a binary constant of at most ``max_bits`` bits, so it never grows beyond that: a longer list only
lets more false positives through, which the join removes. An empty list allows all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_inputs, let, small, table

#: Fixed rules of the registered query: verdict, host and path.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
#: Fixed list of the registered query: hosts known for spam, as canonical URLs of their roots.
LISTED = ["ads-track.example.org/", "casino-win.example.org/", "cheap-pills.example.com/", "free-bets.example.com/", "spam-farm.example.org/"]
BLOCK = 512  # bits; eight words of 64 with one bit each


def host_of(url: Column) -> Column:
    """Between the first :// and the next / ? or #, A-Z lower-cased."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_host(host: Column) -> Column:
    """Without user part, port and closing dot."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r"\.?(?::[0-9]*)?$", "")


def _places(key: Column) -> Column:
    """The eight bits of a key within its block."""
    h = F.xxhash64(key, F.lit(7))
    return F.array(*[F.lit(64 * i) + F.pmod(F.shiftrightunsigned(h, 7 * i), F.lit(64)) for i in range(8)])


def build_bloom(listed: DataFrame, max_bits: int) -> tuple[bytes, int]:
    n = listed.count()
    blocks = max(1, min(max_bits // BLOCK, -(-n * 16 // BLOCK)))
    own = listed.select(F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block"), F.explode(_places(F.col("key"))).alias("place"))
    bits = own.select((F.col("block") * BLOCK + F.col("place")).alias("bit")).groupBy(F.expr("bit div 8").alias("at")).agg(F.expr("bit_or(shiftleft(1, CAST(bit % 8 AS INT)))").alias("v"))
    out = bytearray(blocks * BLOCK // 8)
    for at, v in bits.collect():  # at most max_bits / 8 rows
        out[at] = v
    return bytes(out), blocks


def maybe(key: Column, bloom: bytes, blocks: int) -> Column:
    size = BLOCK // 8
    part = F.hex(F.substring(F.lit(bloom), F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int") * size + 1, F.lit(size)))

    def test(block):
        at = lambda b: F.conv(F.substring(block, (F.floor(b / 8) * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")
        return F.forall(_places(key), lambda b: F.expr("1") == F.getbit(at(b), (b % 8).cast("int")))

    return let(part, test)


def judge_urls(pages: DataFrame, listed: DataFrame, max_bits: int = 1 << 23) -> DataFrame:
    """page_id, host, path, rule, listed (the longest listed key that is no rule) and verdict of every row.

    listed: key, verdict, is_rule. Of equal keys, a block wins. Null or odd urls have empty host and path, fit no key and
    are allowed; repeated rows stay.
    """
    keys = listed.filter("instr(key, '/') > 0").groupBy("key", "is_rule").agg(F.max("verdict").alias("verdict"))
    bloom, blocks = build_bloom(keys.select("key").union(keys.select(F.expr("substring(key, 1, instr(key, '/') - 1)"))).distinct(), max_bits)
    lengths = [r[0] for r in keys.select((F.length("key") - F.instr("key", "/") + 1).alias("n")).distinct().orderBy("n").collect()]  # at most the length of the longest key
    urls = drop_inputs(pages, "page_id", "url").select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    urls = urls.withColumn("plain", canonical_host(F.col("host")))
    own = F.expr("substring(key, 1, instr(key, '/') - 1)")
    labels = [r[0] for r in keys.select(F.size(F.split(own, r"\.")).alias("n")).distinct().orderBy("n").collect()]  # at most the labels of the longest listed host
    domains = F.array_distinct(F.array(*[F.substring_index(F.col(h), ".", -n) for n in labels for h in ("host", "plain")]) if labels else F.array().cast("array<string>"))
    root = F.when(F.col("path") == "", "/").otherwise(F.col("path"))  # the canonical form of a host's own url
    reach = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.greatest(F.length("path"), F.lit(1)))
    paths = let(reach, lambda ns: F.array_distinct(F.concat(F.transform(ns, lambda n: F.substring(root, F.lit(1), n)), F.transform(ns, lambda n: F.substring("path", F.lit(1), n)))))
    tried = F.flatten(F.transform(F.filter(domains, lambda d: maybe(d, bloom, blocks)), lambda d: F.transform(paths, lambda p: F.concat(d, p))))
    possible = urls.filter("host <> ''").select("page_id", "url", "host", "plain", "path", F.explode(F.filter(F.array_distinct(tried), lambda k: maybe(k, bloom, blocks))).alias("key"))
    within = lambda h: (F.col(h) == own) | F.col(h).endswith(F.concat(F.lit("."), own))
    exact = possible.join(small(keys, 200_000), "key").filter(F.when(F.col("is_rule"), within("host")).otherwise(within("plain"))).filter(~F.col("is_rule") | F.col("path").startswith(F.expr("substring(key, instr(key, '/'))")))
    best = lambda rule: F.max(F.when(F.col("is_rule") == rule, F.struct(F.length("key").alias("n"), "verdict", "key")))
    hits = exact.groupBy("page_id", "url").agg(best(True).alias("r"), best(False).alias("l"))
    out = urls.alias("u").join(hits.alias("h"), F.col("u.page_id").eqNullSafe(F.col("h.page_id")) & F.col("u.url").eqNullSafe(F.col("h.url")), "left")
    return out.select("u.page_id", "host", "path", F.col("r.key").alias("rule"), F.col("l.key").alias("listed"), F.coalesce("r.verdict", "l.verdict", F.lit("allow")).alias("verdict"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(h + p, v, True) for v, h, p in RULES] + [(k, "block", False) for k in LISTED]
    listed = spark.createDataFrame(rows, "key string, verdict string, is_rule boolean")
    return judge_urls(table(spark, sf_dir, "pages"), listed).drop("listed")


def oracle() -> str:
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    bad = ", ".join(f"('{k[:-1]}')" for k in LISTED)
    return rf"""WITH u AS (SELECT page_id, row_number() OVER () AS k,
  coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
rules(verdict, h, p) AS (VALUES {rules}), bad(h) AS (VALUES {bad}),
best AS (SELECT k, max({{'n': length(r.h || r.p), 'verdict': r.verdict, 'rule': r.h || r.p}}) AS b FROM u JOIN rules r
  ON (host = r.h OR host LIKE '%.' || r.h) AND starts_with(path, r.p) GROUP BY k),
spam AS (SELECT DISTINCT k FROM u JOIN bad ON host = bad.h OR host LIKE '%.' || bad.h)
SELECT page_id, host, path, b.rule AS rule, CASE WHEN b.rule IS NOT NULL THEN b.verdict WHEN spam.k IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM u LEFT JOIN best USING (k) LEFT JOIN spam USING (k)"""
