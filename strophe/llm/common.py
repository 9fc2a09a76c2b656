"""Tables, shared scratch storage and small helpers used by every operator of this subpackage."""

from __future__ import annotations

import contextlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strophe.operators.scratch import Scratch, small

#: Spark calls these word separators white space: space and \t \n \v \f \r.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Fewer rows in an Arrow batch while a step is written, so that a batch of long texts stays small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, was)


def row_key(*names: str) -> Column:
    """A digest of some columns of a row (16 bytes): equal for rows that agree in all of them, null or not."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.unhex(F.md5(F.concat(*[part(F.col(f"`{n}`").cast("string")) for n in names]).cast("binary")))


def let(value: Column, f) -> Column:
    """f(value) with value computed once: Spark would put a long expression into a lambda and repeat it for each element."""
    return F.transform(F.array(value), f)[0]


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    while name in df.columns:
        name += "_"
    return name


def drop_inputs(df: DataFrame, *names: str) -> DataFrame:
    """df with only these columns, whatever else it carries."""
    return df.select(*[F.col(f"`{n}`") for n in names])
