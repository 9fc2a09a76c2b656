"""Corpus statistics: one grouped count where the naive way scans once for each value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strophe.functions.enums import LEVELS, METERS, RHYME_SCHEMES


def domain(spark, names: list[str]) -> DataFrame:
    return spark.createDataFrame([(n, i) for i, n in enumerate(names)], "value string, idx int")


def counts_with_zeros(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    """value, n for each name of the domain, the most frequent first, ties in domain order."""
    n = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return F.broadcast(domain(df.sparkSession, names)).join(n, "value", "left").select("value", F.coalesce("n", F.lit(0)).alias("n"), "idx").orderBy(F.desc("n"), "idx").drop("idx")


def label_stats(df: DataFrame, language: str, label: str) -> DataFrame:
    """Counts by label, of each language and of all (language null)."""
    both = df.rollup(label, language).agg(F.count("*").alias("n"), F.grouping(label).alias("g"))
    return both.filter("g = 0").drop("g")


def quatrain_stats(df: DataFrame) -> DataFrame:
    """kind, value, x: length, counts by scheme and meter (zeros too) and shares by level, of annotated quatrains."""
    sets = [("rhyme", RHYME_SCHEMES), ("meter", METERS), ("alliteration", LEVELS)]
    n = df.groupBy(*[c for c, _ in sets]).agg(F.count("*").alias("n"))
    long = n.select(F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("value")) for c, _ in sets], F.struct(F.lit("length").alias("kind"), F.lit("all").alias("value")))).alias("k"), "n").groupBy("k.kind", "k.value").agg(F.sum("n").alias("n"))
    names = df.sparkSession.createDataFrame([(c, v) for c, vs in [*sets, ("length", ["all"])] for v in vs], "kind string, value string")
    out = F.broadcast(names).join(long, ["kind", "value"], "left").select("kind", "value", F.coalesce("n", F.lit(0)).cast("double").alias("n"))
    total = F.max(F.when(F.col("kind") == "length", F.col("n"))).over(W.partitionBy())  # as many rows as names
    return out.withColumn("t", total).select("kind", "value", F.when(F.col("kind") == "alliteration", F.when(F.col("t") > 0, F.col("n") / F.when(F.col("t") > 0, F.col("t")))).otherwise(F.col("n")).alias("x"))


def corpus_stats(df: DataFrame, kinds: dict[str, list[str] | None], language: str = "language") -> DataFrame:
    """language ('all' too), kind, label, n: counts of several label columns by one scan. kinds: the columns, and of each the names that count 0 if absent."""
    labels = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("label")) for k in kinds])
    long = df.select(F.array(F.lit("all"), F.col(language)).alias("ls"), labels.alias("xs"))
    n = long.select(F.explode("ls").alias("language"), "xs").select("language", F.explode("xs").alias("x")).filter("x.label IS NOT NULL").groupBy("language", "x.kind", "x.label").agg(F.count("*").alias("n"))
    names = [F.struct(F.lit(k).alias("kind"), F.lit(v).alias("label")) for k, vs in kinds.items() for v in vs or []]
    every = n.select("language").distinct().select("language", F.inline(F.array(*names))) if names else n.select("language", "kind", "label")
    return every.join(n, ["language", "kind", "label"], "full").select("language", "kind", "label", F.coalesce("n", F.lit(0)).alias("n"))
