"""Rhyme pairs of stanzas, balanced negatives, keep-first and keep-last deduplication."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strophe.functions.core import let

from .ranks import rank_by_md5
from .scratch import small as few

#: Fixed value: letters that a regular expression would escape never rhyme.
SPECIAL = r"[^A-Za-z0-9_!\"%',/:;<=>@`]"


def rhyme_pairs(df: DataFrame, verses: Column, scheme: Column) -> DataFrame:
    """v1, v2 (sorted), j, k and label of each pair of a stanza's verses; pairs of equal texts and label merge, the last visit (j > k) stays.

    verses and scheme must be of equal length, or the query fails.
    """
    checked = df.withColumn("_v", verses).withColumn("_s", F.split(scheme, "")).filter(F.expr("assert_true(size(_v) = size(_s), 'verses and scheme differ in length') IS NULL"))
    pairs = F.expr("flatten(transform(sequence(1, size(_v)), j -> transform(filter(sequence(1, size(_v)), k -> k < j), k -> struct(j - 1 AS j, k - 1 AS k))))")
    out = checked.withColumn("_p", F.explode(pairs)).select("*", "_p.*")
    a, b = F.expr("_v[j]"), F.expr("_v[k]")
    equal = F.expr("_s[j] = _s[k]") & ~F.expr("_s[k]").rlike(SPECIAL)
    return out.withColumns({"v1": F.least(a, b), "v2": F.greatest(a, b), "label": F.when(equal, "rhyme").otherwise("dissonance")}).drop("_v", "_s", "_p")


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row of each key: the last in order, by partial aggregation."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def with_repeats(df: DataFrame, ids: list[str], verses: Column, most: int = 64) -> DataFrame:
    """Adds _repeated: the verses that a text holds twice or more; null where these are more than ``most``, or where other rows have the same ids."""
    shared = df.groupBy(*ids).agg(F.count("*").alias("_n")).filter("_n > 1").select(*[F.col(c).alias(f"_id_{c}") for c in ids], F.lit(True).alias("_shared"))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_id_{c}")) for c in ids])
    twice = let(F.array_sort("_l"), lambda s: F.array_distinct(F.filter(s, lambda x, i: x == F.get(s, i - 1))))
    found = F.when(F.size(F.array_distinct("_l")) == F.size("_l"), F.array().cast("array<string>")).otherwise(twice)
    out = df.join(few(shared, 100_000), same, "left").withColumn("_l", verses).withColumn("_repeated", F.when(F.col("_shared").isNull(), found))
    return out.withColumn("_repeated", F.when(F.size("_repeated") <= most, F.col("_repeated"))).drop("_l", "_shared", *[f"_id_{c}" for c in ids])


def last_pairs(df: DataFrame, verses: Column, scheme: Column, ids: list[str], stanza: str = "stanza") -> DataFrame:
    """``keep_last`` of the ``rhyme_pairs`` of stanzas by ids: of pairs that are equal in texts and label the last one in order of stanza, j and k. df comes from ``with_repeats``.

    A pair of verses that both stand once among those of their ids has no equal, so it stays where it is. Only pairs with a repeated verse move, and those of ids that rows share.
    """
    at = F.transform(verses, lambda v: F.coalesce(F.array_contains("_repeated", v), F.lit(True)))
    flagged = df.select(*ids, stanza, verses.alias("_verses"), scheme.alias("_scheme"), at.alias("_at"))
    of = lambda x: rhyme_pairs(x, F.col("_verses"), F.col("_scheme"))
    again = F.get("_at", F.col("j")) | F.get("_at", F.col("k"))
    columns = [*ids, "v1", "v2", "label", stanza, "j", "k"]
    alone = of(flagged.filter(F.exists("_at", lambda x: ~x))).filter(~again).select(*columns)
    moved = of(flagged.filter(F.exists("_at", lambda x: x))).filter(again).select(*columns)
    return alone.unionByName(keep_last(moved, [*ids, "v1", "v2", "label"], [stanza, "j", "k"]))


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def balanced_within(df: DataFrame, scope: list[str], v1: str = "v1", v2: str = "v2") -> DataFrame:
    """The same for scopes that each fit into a task (the pairs of a file, say): one shuffle by scope, or none if the rows are dealt by it."""
    order = W.partitionBy(*scope, "label").orderBy(F.md5(F.concat_ws("|", v1, v2).cast("binary")), v1, v2)
    n = F.count_if(F.col("label") == "rhyme").over(W.partitionBy(*scope))
    ranked = df.select(*scope, v1, v2, "label").distinct().withColumns({"_n": n, "_r": F.row_number().over(order)})
    return ranked.filter("label = 'rhyme' OR label = 'dissonance' AND _r <= _n").drop("_n", "_r")


def balanced(df: DataFrame, scope: list[str], v1: str = "v1", v2: str = "v2") -> DataFrame:
    """All different rhymes (scope, label and texts), and of each scope as many dissonances as it has rhymes, in the order of a hash of the pair.

    Different pairs are counted by digests first, in 4,096 slices of the hash. So the texts of the few dissonances that can be chosen move, not those of all.
    """
    df = df.select(*scope, v1, v2, "label")
    hashed = df.withColumn("_h", F.md5(F.concat_ws("|", v1, v2).cast("binary")))
    each = hashed.select(*scope, "label", F.unhex("_h").alias("_h"), F.xxhash64(v1, v2).alias("_x"), F.substring("_h", 1, 3).alias("_b")).distinct()
    cells = each.groupBy(*scope, "label", "_b").agg(F.count("*").alias("_c"))
    rhymes = F.coalesce(F.sum(F.when(F.col("label") == "rhyme", F.col("_c"))).over(W.partitionBy(*scope)), F.lit(0))
    before = F.sum("_c").over(W.partitionBy(*scope, "label").orderBy("_b").rowsBetween(W.unboundedPreceding, -1))
    counted = cells.select(*scope, "label", "_b", rhymes.alias("_n"), F.coalesce(before, F.lit(0)).alias("_before")).filter("label = 'dissonance' AND _before < _n")
    last = few(counted.groupBy(*scope).agg(F.max("_b").alias("_last"), F.first("_n").alias("_n")), 100_000)  # _n is one value for a scope
    near = hashed.filter("label = 'dissonance'").join(last, scope).filter(F.substring("_h", 1, 3) <= F.col("_last")).drop("_h", "_last").distinct()
    other = rank_by_md5(near, scope, F.concat_ws("|", v1, v2), [v1, v2], "_r").filter("_r <= _n").drop("_r", "_n")
    return df.filter("label = 'rhyme'").distinct().unionByName(other)
