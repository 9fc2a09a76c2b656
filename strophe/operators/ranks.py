"""Ranks and running sums without a window over a whole key: a key, or the whole table, may hold any share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import Scratch, small


def rank_by_md5(df: DataFrame, keys: list[str], value: Column, ties: list[str], name: str = "rank", total: str | None = None) -> DataFrame:
    """Adds the rank (from 1) of each row within keys by the md5 of a value, and the number of the key's rows.

    Rows are ranked within 4,096 slices of the hash; the slices' counts, a small table, give what stands before each.
    """
    df = df.withColumn("_h", F.md5(value.cast("string").cast("binary"))).withColumn("_b", F.substring("_h", 1, 3))
    before = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    counts = df.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    slices = counts.select(*keys, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(W.partitionBy(*keys)).alias("_total"))
    on = [F.col(f"d.{k}").eqNullSafe(F.col(f"s.{k}")) for k in [*keys, "_b"]]
    cond = on[0]
    for c in on[1:]:
        cond &= c
    ranked = df.alias("d").join(slices.alias("s"), cond).select("d.*", "_before", "_total")
    rank = F.col("_before") + F.row_number().over(W.partitionBy(*keys, "_b").orderBy("_h", *ties))
    out = ranked.withColumn(name, rank)
    return (out.withColumn(total, F.col("_total")) if total else out).drop("_h", "_b", "_before", "_total")


def _matches(left: str, right: str, names: list[str]) -> Column:
    cond = F.lit(True)
    for k in names:
        cond &= F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return cond


def _in_ranges(df: DataFrame, sort: list[str]) -> DataFrame:
    """df dealt into ranges of some columns and sorted, with _at: number of the range (upper bits) and place in it (lower 33 bits).

    A number of the row as read stands behind the columns, so that rows that agree in all of them can be cut into several ranges too.
    """
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    return tied.repartitionByRange(*sort, "_tie").sortWithinPartitions(*sort, "_tie").withColumn("_at", F.monotonically_increasing_id()).drop("_tie")


def _before(cells: DataFrame, keys: list[str], most: int) -> DataFrame:
    """keys, _p and what the key's earlier ranges hold (_sum); cells has a row for each key and range, so as many as ranges and keys together."""
    if keys:
        w = W.partitionBy(*keys).orderBy("_p")
        return small(cells.withColumn("_sum", F.coalesce(F.sum("_n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))), most)
    spark, total, rows = cells.sparkSession, 0, []
    for r in cells.orderBy("_p").collect():  # one row for each range, as many as shuffle partitions
        rows.append((*r, total))
        total += r["_n"]
    return F.broadcast(spark.createDataFrame(rows, f"{', '.join(f'{n} {t}' for n, t in cells.dtypes)}, _sum long"))


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "place", total: str | None = None, most: int = 200_000) -> DataFrame:
    """Adds the place (from 0) of each row within its keys in the order of other columns (nulls first), and with ``total`` the number of the key's rows.

    The rows are written once, in ranges of keys and order; counts by range give what stands before each, and a row's place in its range is known from
    the write. So neither a window nor a sort ever holds a whole key. keys may be empty (places in the whole table). Rows that agree in keys and order get
    places in any order among themselves. most: rows of counts that are sent to every task.
    """
    kept = Scratch(df.sparkSession, "places").keep(_in_ranges(df, [*keys, *order]))
    with_range = kept.withColumn("_p", F.shiftright("_at", 33))
    cells = with_range.groupBy(*keys, "_p").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    out = with_range.alias("d").join(_before(cells, keys, most).alias("c"), _matches("d", "c", [*keys, "_p"]))
    out = out.select("d.*", (F.col("_sum") + F.col("_at") - F.col("_first")).alias(name)).drop("_at", "_p")
    if not total:
        return out
    totals = small(cells.groupBy(*keys).agg(F.sum("_n").alias(total)), most) if keys else F.broadcast(cells.agg(F.sum("_n").alias(total)))
    return out.alias("d").join(totals.alias("t"), _matches("d", "t", keys)).select("d.*", f"t.{total}")


def running_sum(df: DataFrame, order: list[str], value: str, name: str = "before") -> DataFrame:
    """Adds the sum of a column (long, no nulls) over all rows that stand before a row; 0 for the first.

    As in ``numbered``: sums by range give what stands before each, and a window runs over one range at a time.
    """
    kept = Scratch(df.sparkSession, "sums").keep(_in_ranges(df, order)).withColumn("_p", F.shiftright("_at", 33))
    cells = kept.groupBy("_p").agg(F.sum(value).cast("long").alias("_n"))
    own = F.coalesce(F.sum(value).over(W.partitionBy("_p").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return kept.withColumn("_own", own).join(_before(cells, [], 0).drop("_n"), "_p").withColumn(name, F.col("_sum") + F.col("_own")).drop("_p", "_at", "_own", "_sum")
