"""Splits, samples and caps that depend on hashes, never on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import numbered, rank_by_md5, running_sum


def bucket(key: Column, n: int = 1000) -> Column:
    """0 to n - 1 from the md5 of a key, the same in any engine."""
    return (F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % n).cast("int")


def random_split(df: DataFrame, key: str, test: float) -> DataFrame:
    return df.withColumn("split", F.when(bucket(F.col(key)) < int(test * 1000), "test").otherwise("train"))


def stratified_split(df: DataFrame, label: str, key: str, shares=(0.9, 0.05, 0.05), names=("train", "dev", "test")) -> DataFrame:
    """Exact shares within each label, in md5 order of the key."""
    part = (F.col("_rank") - 1) / F.col("_of")
    first, second = shares[0], shares[0] + shares[1]
    ranked = rank_by_md5(df, [label], F.col(key), [key], "_rank", "_of")
    return ranked.withColumn("split", F.when(part < first, names[0]).when(part < second, names[1]).otherwise(names[2])).drop("_rank", "_of")


def running_cap(df: DataFrame, order: list[str], size: str, cap: int, name: str = "kept") -> DataFrame:
    """Rows in an order until their sizes (a long column, no nulls) reach a cap, with the part of each that still fits: all but the last kept row fit whole.

    The cap is exact, whatever its size: sums by range give where it falls, so nothing is sorted into one task, as a limit would. Rows of no size go.
    """
    return running_sum(df, order, size, "_before").filter((F.col("_before") < cap) & (F.col(size) > 0)).withColumn(name, F.least(F.col(size), F.lit(cap) - F.col("_before"))).drop("_before")


def deal(df: DataFrame, key: list[str], world: int, batch: int = 1, evaluation: int = 0, salt: str = "") -> DataFrame:
    """Rows in a random order that is the same on any cluster, dealt to training shards: split, shard, step and slot.

    The order is by md5 of the key (which must be unique) and a salt, another for each epoch. Its first ``evaluation`` rows are for evaluation (all three -1). Of the rest, row after
    row goes to the shards in turn, so that shards differ by one row at most; a step takes ``batch`` rows of each shard.
    """
    mixed = F.md5(F.concat_ws("|", F.lit(salt), *[F.col(k).cast("string") for k in key]).cast("binary"))
    placed = numbered(df.withColumn("_mixed", mixed), [], ["_mixed", *key], "_place").drop("_mixed")
    place = F.col("_place") - evaluation
    train = lambda c: F.when(place >= 0, c).otherwise(-1)
    own = F.floor(place / world)
    out = placed.withColumn("split", F.when(place >= 0, "train").otherwise("eval")).withColumn("shard", train((place % world).cast("int")))
    return out.withColumn("step", train(F.floor(own / batch)).cast("long")).withColumn("slot", train(own % batch).cast("int")).drop("_place")


def least_samples(steps: int, batch: int = 512, evaluation: int = 0) -> int:
    """Blocks that a training run needs."""
    return steps * batch + evaluation


def local_batch(total: int, world: int, accumulate: int = 1) -> int:
    size, rest = divmod(total, world * accumulate)
    if rest or not size:
        raise ValueError(f"a global batch of {total} can't be dealt to {world} x {accumulate}")
    return size
