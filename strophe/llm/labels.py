"""The labelled rows that classifiers learn from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most labelled rows that a model is fitted on.
BOUND = 40_000


def fold(doc_id="doc_id"):
    """crc32 of doc_id as text, modulo 3; 1 is held out."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3


def held_out(doc_id="doc_id"):
    return F.coalesce(fold(doc_id) == 1, F.lit(False))


def sample(labels: DataFrame, name: str, bound: int = BOUND) -> DataFrame:
    """doc_id and y of at most about ``bound`` rows that are not held out, chosen by hash of doc_id; its size is bounded, so it may be broadcast."""
    rows = labels.select("doc_id", F.col(name).cast("int").alias("y")).filter((fold() != 1) & F.col("y").isNotNull()).distinct()
    return F.broadcast(_some(rows, bound, "doc_id"))


def _some(rows: DataFrame, bound: int, *by: str) -> DataFrame:
    n = rows.count()
    share = min(1.0, bound / max(n, 1))
    return rows.filter(F.pmod(F.xxhash64(*by, F.lit(11)), F.lit(1_000_000)) < int(share * 1_000_000))


def labelled(docs: DataFrame, labels: DataFrame, name: str, keep, value: str = "text", bound: int = BOUND) -> DataFrame:
    """doc_id, a value and y of at most about ``bound`` different rows, however often a doc_id or a text repeats: bounded by labels before the join and by rows after it.

    keep: writes a table, of which only a bounded part is then used.
    """
    rows = keep(docs.join(sample(labels, name, bound), "doc_id").select("doc_id", value, "y").distinct())
    return _some(rows, bound, "doc_id", value)
