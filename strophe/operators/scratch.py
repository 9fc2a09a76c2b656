"""Written tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset and all run in one process, a new local one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="strophe-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


class Scratch:
    """Written tables that cut lineage: any executor may be lost, the files are in the shared folder.

    ``drop`` removes one as soon as nothing reads it; the rest go when the application ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.n, self.paths = 0, {}
        p, fs = _fs(spark, self.root)
        fs.mkdirs(p)
        fs.deleteOnExit(p)

    def keep(self, df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
        """df as written. by: columns with few values, each of which gets files of its own."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, *dfs: DataFrame) -> None:
        for df in dfs:
            if found := self.paths.pop(id(df), None):
                p, fs = _fs(self.spark, found[0])
                fs.delete(p, True)


def small(df: DataFrame, rows: int) -> DataFrame:
    """Marks df for broadcast if a count shows at most ``rows`` rows; else it stays as it is, and Spark joins by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
