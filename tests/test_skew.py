"""A verse in a third of all rows: scored once, and dealt to no single task."""

from pyspark.sql import functions as F

from strophe.operators import annotate


def test_hot_verses(spark):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = spark.range(60_000, numPartitions=16).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 1000 == 1, None).otherwise(F.concat(F.lit("line "), "id")).alias("verse"))
        out = annotate.score_distinct(rows, ["verse"], F.length)
        assert out.filter("verse IS NULL").agg(F.count("*"), F.count("score")).first()[:] == (40, 0)
        assert out.filter("verse = 'hot'").agg(F.count("*"), F.min("score"), F.max("score")).first()[:] == (20_000, 3, 3)
        assert out.filter("score = length(verse)").count() == 60_000 - 40
        sizes = sorted(r["n"] for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect())
        assert sizes[-1] <= 2 * sizes[len(sizes) // 2]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
