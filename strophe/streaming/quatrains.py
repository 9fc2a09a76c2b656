"""Quatrain windows over a stream of document files: the same expressions as in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strophe.operators.windows import lines, quatrain_windows


def stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def counts_by_language(docs: DataFrame) -> DataFrame:
    return quatrain_windows(docs, lines(F.col("text"))).groupBy("lang").agg(F.count("*").alias("n"))
