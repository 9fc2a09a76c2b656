"""Reshaping of verse: lines, quatrain windows, adjacent pairs, verse pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strophe.functions.enums import PAIRS


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def quatrain_windows(df: DataFrame, verses: Column, n: int = 4, beside: dict[str, Column] | None = None) -> DataFrame:
    """Each window of n lines (start from 0); windows with a garbled line go: one of ten characters or fewer, ending in a hyphen, or broken.

    beside: arrays with a value for each line (its scores, say), made once for a text and cut as the lines are.
    """
    starts = F.when(F.size("_l") >= n, F.sequence(F.lit(0), F.size("_l") - n)).otherwise(F.array().cast("array<int>"))
    beside = beside or {}
    out = df.withColumns({"_l": verses, **beside}).withColumn("start", F.explode(starts)).withColumn("quatrain", F.slice("_l", F.col("start") + 1, F.lit(n))).drop("_l")
    out = out.withColumns({c: F.slice(c, F.col("start") + 1, F.lit(n)) for c in beside}) if beside else out
    garbled = lambda v: (F.length(v) <= 10) | v.endswith("-") | F.contains(v, F.lit("\n"))
    return out.filter(~F.exists("quatrain", garbled))


def adjacent(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Rows and the next value of their group; the last of a group goes."""
    return df.withColumn("next", F.lead(value).over(W.partitionBy(key).orderBy(order))).filter("next IS NOT NULL")


def adjacent_pairs(verses: Column) -> Column:
    n = F.size(verses)
    return F.when(n > 1, F.arrays_zip(F.slice(verses, F.lit(1), n - 1).alias("a"), F.slice(verses, F.lit(2), n - 1).alias("b"))).otherwise(F.array().cast("array<struct<a:string,b:string>>"))


def verse_pairs(quatrain: Column) -> Column:
    """The six pairs of a quatrain: i, j, a, b."""
    return F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.get(quatrain, i).alias("a"), F.get(quatrain, j).alias("b")) for i, j in PAIRS])


def is_quatrain(text: Column) -> Column:
    return F.size(F.split(text, "\n")) == 4
