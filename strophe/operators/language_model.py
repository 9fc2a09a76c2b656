"""Perplexity of texts under a byte model with context, counted from the corpus: interpolated n-grams (Witten and Bell), built and applied by joins on contexts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, small

BASE = 257  # bytes, and one more that stands before the first byte
START = 256


def parts(texts: pd.Series, most: int) -> Iterator[pd.Series]:
    """A batch of texts in pieces of about ``most`` characters, one text at least."""
    size = texts.str.len().fillna(0).to_numpy(dtype=float)
    piece = (np.cumsum(size) - size) // most
    for at in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(piece)) + 1):
        if len(at):
            yield texts.iloc[at]


def grams(order: int, most: int = 1_000_000) -> Callable[[str], Column]:
    """Of a text column, the different n-grams of each text's UTF-8 bytes (gram: a byte behind order - 1 others, digits of a number to the base 257) and how often each occurs (n).

    most: so many characters at a time are counted, so that a batch of 10,000 texts does not hold all its counts at once.
    """

    def one(x):
        if not x:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        b = np.concatenate([np.full(order - 1, START, np.int64), np.frombuffer(x.encode(), np.uint8).astype(np.int64)])
        code = np.zeros(len(b) - order + 1, np.int64)
        for k in range(order):
            code = code * BASE + b[k : k + len(code)]
        return np.unique(code, return_counts=True)

    @F.pandas_udf("struct<gram:array<bigint>,n:array<bigint>>")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            for part in parts(texts, most):
                both = [one(x) for x in part]
                yield pd.DataFrame({"gram": [g for g, _ in both], "n": [n for _, n in both]})

    def of(text: str) -> Column:
        found = counted(text)
        return F.arrays_zip(found["gram"].alias("gram"), found["n"].alias("n"))

    return of


def probabilities(counts: DataFrame, order: int) -> DataFrame:
    """context, byte and p of each counted pair (context, byte, n): its share, mixed with what the next shorter context gives.

    A context that is followed by k kinds of bytes in n places gives the weight k / (n + k) to the shorter one; without context each byte has one place for nothing.
    """
    if order == 1:
        total = F.broadcast(counts.agg(F.sum("n").alias("total")))
        return counts.join(total).select("context", "byte", ((F.col("n") + 1) / (F.col("total") + 256)).alias("p"))
    shorter = F.col("context") % BASE ** (order - 2)
    below = probabilities(counts.groupBy(shorter.alias("context"), "byte").agg(F.sum("n").alias("n")), order - 1).withColumnsRenamed({"context": "_short", "p": "_p"})
    contexts = counts.groupBy("context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    mixed = (F.col("n") + F.col("kinds") * F.col("_p")) / (F.col("total") + F.col("kinds"))
    return counts.join(contexts, "context").withColumn("_short", shorter).join(below, ["_short", "byte"]).select("context", "byte", mixed.alias("p"))


def perplexities(df: DataFrame, text: str = "text", order: int = 3, most: int = 2_000_000) -> DataFrame:
    """df's other columns with ppl: exp of the mean negative log-probability of a text's bytes; texts without bytes have none, and go.

    Texts move as counts of their different n-grams, not byte by byte. The model has at most 257 ** order rows, whatever the corpus; up to ``most`` it is sent to every task.
    """
    scratch = Scratch(df.sparkSession, "grams")
    kept = scratch.keep(df.withColumn("_grams", grams(order)(F.col(text))).drop(text).filter(F.size("_grams") > 0).withColumn("_row", F.monotonically_increasing_id()))
    each = kept.select("_row", F.inline("_grams"))
    counts = each.groupBy("gram").agg(F.sum("n").alias("n")).select(F.floor(F.col("gram") / BASE).alias("context"), (F.col("gram") % BASE).alias("byte"), "n")
    model = scratch.keep(probabilities(scratch.keep(counts), order).select((F.col("context") * BASE + F.col("byte")).alias("gram"), F.log("p").alias("logp")))
    own = each.join(small(model, most), "gram").groupBy("_row").agg(F.exp(-F.sum(F.col("n") * F.col("logp")) / F.sum("n")).alias("ppl"))
    return kept.drop("_grams").join(own, "_row").drop("_row")
