"""Merkle manifest of a dataset: a leaf for each row, a binary tree for each language, a tree over their roots, and for each row the proof of its place.

Levels are windows: the nodes of a group are partitioned by group and the number of their ancestor, and an ordered full-frame collect_list gives each
node its run, which makes both the ancestor's hash and the siblings on the way there. Of the nodes of a run the first stands for the ancestor (so
parents are deduplicated without a shuffle), and the next window runs over those. A window spans ``LEVELS`` levels at once (a run of at most
``2 ** LEVELS`` hashes, whatever the data), so a table of n rows takes log2(n) / LEVELS windows, each over a sixteenth of the rows before. Then paths go
down again: a node's path is its own siblings and its ancestor's path, by a join on the keys by which the window has already dealt the nodes. Texts are
read once, for the leaves; only hashes (as 32 bytes) move from there on. Places of leaves in their language come from counts by range (``numbered``),
so a language may hold all rows.

Null fields are ``-`` in the preimage, and an empty text is ``0:``. Nulls in doc_id and lang sort first. Rows of one doc_id ascend by their leaves; rows
that agree in all five columns have equal leaves, and each has a place and a proof of its own. A null doc_id has no checksum, so it is never tampered
with. Very long texts are hashed whole; extra columns are left out. An empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strophe.operators.ranks import numbered

from .common import Scratch, drop_inputs, let, small, table

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
LEVELS = 4
STEP = "array<struct<h:binary,left:boolean>>"  # h is null where a node is alone in its run; left: the sibling stands on the left


def hash_of(*hashes: Column) -> Column:
    """The 32 bytes of the sha256 of some digests, as lowercase hex text one after the other."""
    return F.unhex(F.sha2(F.lower(F.concat(*[F.hex(h) for h in hashes])).cast("binary"), 256))


def text_of(h: Column) -> Column:
    return F.lower(F.hex(h))


def leaf_of(*fields: Column) -> Column:
    part = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.unhex(F.sha2(F.concat(*[part(c.cast("string")) for c in fields]).cast("binary"), 256))


def leaves(docs: DataFrame, every: int = 7) -> DataFrame:
    """g (the language's key, which sorts as the languages do), doc_id, leaf, and altered: the leaf with n_chars + 1 where ``every`` divides crc32(doc_id)."""
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    chosen = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0) & F.col("n_chars").isNotNull()
    columns = [F.col(c) for c in FIELDS]
    return drop_inputs(docs, *FIELDS).select(
        F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("-")).alias("g"), "doc_id", leaf_of(*columns).alias("leaf"),
        F.when(chosen, leaf_of(*[more if n == "n_chars" else c for n, c in zip(FIELDS, columns, strict=True)])).alias("altered"),
    )


def climb(levels: int) -> Column:
    """top (the hash of the run's ancestor) and path (a step for each level that the group has) of a node: number i of the n in its group, hashes _run of its run."""
    place, n = F.col("i").bitwiseAND(F.lit((1 << levels) - 1)).cast("int"), F.col("n")

    def level(k: int, nodes: Column, steps: list[Column]) -> Column:
        if k == levels:
            path = F.filter(F.array(*steps), lambda s: s["on"])
            return F.struct(F.get(nodes, F.lit(0)).alias("top"), F.transform(path, lambda s: F.struct(s["h"].alias("h"), s["left"].alias("left"))).alias("path"))
        on = n > (1 << k)
        at = F.shiftright(place, k)
        step = F.struct(on.alias("on"), F.get(nodes, at.bitwiseXOR(F.lit(1))).alias("h"), (at % 2 == 1).alias("left"))
        pairs = F.transform(F.sequence(F.lit(0), F.shiftright(F.size(nodes) - 1, 1)), lambda j: F.when(2 * j + 1 < F.size(nodes), hash_of(F.get(nodes, 2 * j), F.get(nodes, 2 * j + 1))).otherwise(hash_of(F.get(nodes, 2 * j))))
        return let(F.when(on, pairs).otherwise(nodes), lambda above: level(k + 1, above, [*steps, step]))

    return let(F.col("_run"), lambda nodes: level(0, nodes, []))


def climbed(nodes: DataFrame, levels: int, way: Column) -> DataFrame:
    """nodes (g, i, n, h and others) with up, the number of the ancestor, its hash top, and path, the steps to it. way: ``climb(levels)``, which takes long to build."""
    own = nodes.withColumn("up", F.shiftright("i", levels))
    run = F.collect_list("h").over(W.partitionBy("g", "up").orderBy("i").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return own.withColumn("_run", run).withColumn("_c", way).select(*own.columns, "_c.top", "_c.path")


def ancestors(nodes: DataFrame, levels: int, way: Column) -> DataFrame:
    """g, i, n and h of the nodes' ancestors: the first node of each run stands for it."""
    first = F.col("i").bitwiseAND(F.lit((1 << levels) - 1)) == 0
    return climbed(nodes, levels, way).filter(first).select("g", F.col("up").alias("i"), F.shiftright(F.col("n") + F.lit((1 << levels) - 1), levels).alias("n"), F.col("top").alias("h"))


def trees(scratch: Scratch, nodes: DataFrame, levels: int, way: Column) -> list[DataFrame]:
    """The nodes of all storeys: the given ones (g, i, n, h), their ancestors, and so on up to one node for each group (at least one storey above)."""
    storeys, most = [nodes], nodes.agg(F.max("n")).first()[0]
    while most is not None and (most > 1 or len(storeys) == 1):
        storeys.append(scratch.keep(ancestors(storeys[-1], levels, way)))
        most = -(-most >> levels)
    return storeys


def descend(nodes: DataFrame, above: DataFrame, levels: int, way: Column) -> DataFrame:
    """nodes with path, the steps to the root, and top's columns; above: g, up, rest (the ancestor's path) and other columns of it."""
    return climbed(nodes, levels, way).drop("top").join(above, ["g", "up"]).withColumn("path", F.concat("path", "rest")).drop("rest")


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and the steps of its path give."""
    return F.aggregate(path, start, lambda h, s: F.when(s["h"].isNull(), hash_of(h)).when(s["left"], hash_of(s["h"], h)).otherwise(hash_of(h, s["h"])))


def manifest(docs: DataFrame, every: int = 7, levels: int = LEVELS) -> DataFrame:
    """doc_id, lang_root (subroot), root and the proof of every row, and whether the proof still holds after the rows that ``every`` chooses are altered.

    doc_id, leaf, subroot, root, proof_sha256, folded_root (of the altered leaf, if it is), verified, tampered, n_siblings.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "merkle")
    rows = scratch.keep(numbered(scratch.keep(leaves(docs, every)), ["g"], ["doc_id", "leaf"], "i", "n"))
    nodes = rows.select("g", "i", "n", F.col("leaf").alias("h"))
    way = climb(levels)
    storeys = trees(scratch, nodes, levels, way)
    if len(storeys) == 1:
        return spark.createDataFrame([], "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, tampered boolean, n_siblings int")
    groups = scratch.keep(numbered(storeys[-1].select("g", F.col("h").alias("subroot")), [], ["g"], "i", "n"))
    upper = trees(scratch, groups.select(F.lit("").alias("g"), "i", "n", F.col("subroot").alias("h")), levels, way)
    root = upper[-1].first()["h"]  # one row
    path = spark.createDataFrame([("", 0)], "g string, up long").withColumn("rest", F.array().cast(STEP))
    for storey in upper[-2:0:-1]:
        path = descend(storey, path, levels, way).select("g", F.col("i").alias("up"), F.col("path").alias("rest"))
    of_groups = descend(groups.select(F.lit("").alias("g"), "i", "n", F.col("subroot").alias("h"), F.col("g").alias("group")), path, levels, way)
    path = scratch.keep(of_groups.select(F.col("group").alias("g"), F.lit(0).cast("long").alias("up"), F.col("path").alias("rest"), F.col("h").alias("subroot")))
    for storey in storeys[-2:0:-1]:
        path = scratch.keep(descend(storey, path, levels, way).select("g", F.col("i").alias("up"), F.col("path").alias("rest"), "subroot"))
    out = descend(rows.withColumnRenamed("leaf", "h"), path, levels, way)
    siblings = F.transform(F.filter("path", lambda s: s["h"].isNotNull()), lambda s: text_of(s["h"]))
    out = out.withColumn("_folded", folded(F.coalesce("altered", "h"), F.col("path")))
    return out.select(
        "doc_id", text_of(F.col("h")).alias("leaf"), text_of(F.col("subroot")).alias("subroot"), text_of(F.lit(root)).alias("root"), F.sha2(F.array_join(siblings, "").cast("binary"), 256).alias("proof_sha256"),
        text_of(F.col("_folded")).alias("folded_root"), (F.col("_folded") == F.lit(root)).alias("verified"), F.col("altered").isNotNull().alias("tampered"), F.size(siblings).alias("n_siblings"),
    )


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


def oracle() -> str:
    part = lambda c: f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda n: "sha256(" + " || ".join([part("doc_id"), part("source"), part("lang"), n, part("text")]) + ")"
    # The checksum by its bits: for each byte, eight shifts by the reversed polynomial.
    byte = "list_reduce(list_concat([xor(c, b)], [CAST(0 AS BIGINT) FOR _ IN range(8)]), lambda x, _: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)"
    crc = f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))), lambda c, b: {byte}), 4294967295)"
    level = lambda name: f"""SELECT lvl + 1, g, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM {name} WHERE n > 1 GROUP BY lvl, g, n, i // 2"""
    steps = lambda own, tree: f"""SELECT o.k, list(CASE WHEN t.h IS NULL THEN '' WHEN (o.i >> l.lvl) % 2 = 1 THEN 'L' || t.h ELSE 'R' || t.h END ORDER BY l.lvl) AS path
  FROM {own} o JOIN (SELECT DISTINCT g, lvl, n FROM {tree}) l ON l.g = o.g AND l.n > 1 LEFT JOIN {tree} t ON t.g = o.g AND t.lvl = l.lvl AND t.i = xor(o.i >> l.lvl, 1) GROUP BY o.k"""  # noqa: E731
    fold = "CASE WHEN s = '' THEN sha256(a) WHEN s[1] = 'L' THEN sha256(s[2:] || a) ELSE sha256(a || s[2:]) END"
    return f"""WITH RECURSIVE d AS (SELECT *, coalesce('=' || lang, '-') AS g, {leaf(part("n_chars"))} AS leaf, {leaf(part("(CAST(n_chars AS HUGEINT) + 1)"))} AS more FROM documents),
e AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, row_number() OVER () AS k, count(*) OVER (PARTITION BY g) AS n, coalesce({crc} % 7 = 0 AND n_chars IS NOT NULL, false) AS bad FROM d),
lo(lvl, g, i, n, h) AS (SELECT 0, g, i, n, leaf FROM e UNION ALL {level("lo")}),
r AS (SELECT '' AS g, g AS k, h, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM lo WHERE n = 1),
hi(lvl, g, i, n, h) AS (SELECT 0, g, i, n, h FROM r UNION ALL {level("hi")}),
a AS ({steps("e", "lo")}), b AS ({steps("r", "hi")}),
p AS (SELECT doc_id, leaf, r.h AS subroot, list_concat(coalesce(a.path, CAST([] AS VARCHAR[])), coalesce(b.path, CAST([] AS VARCHAR[]))) AS path, CASE WHEN bad THEN more ELSE leaf END AS start, bad
  FROM e JOIN r ON r.k = e.g LEFT JOIN a ON a.k = e.k LEFT JOIN b ON b.k = e.g),
f AS (SELECT *, (SELECT h FROM hi WHERE n = 1) AS root, list_reduce(list_prepend(start, path), lambda a, s: {fold}) AS folded_root FROM p)
SELECT doc_id, leaf, subroot, root, sha256(list_aggregate(list_concat([''], list_transform(path, lambda s: s[2:])), 'string_agg', '')) AS proof_sha256, folded_root, folded_root = root AS verified, bad AS tampered,
CAST(len(list_filter(path, lambda s: s <> '')) AS INT) AS n_siblings FROM f"""
