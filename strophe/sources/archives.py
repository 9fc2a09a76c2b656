"""Archives in several parts: joined and opened in tasks, an archive each; nothing passes through the driver."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parts_of(df: DataFrame, pattern: str = r"^(.*)\.(\d+)$") -> DataFrame:
    """archive, part and content of binary files (path, content) whose names end with the number of the part; the pattern's groups are the archive and the part."""
    return df.select(F.regexp_extract("path", pattern, 1).alias("archive"), F.regexp_extract("path", pattern, 2).cast("int").alias("part"), "content").filter("archive <> ''")


def members(parts: DataFrame) -> DataFrame:
    """archive, name and content (binary) of the files in each archive, from its parts (archive, part, content) in order. A whole archive must fit into a task."""

    def run(batches):
        for b in batches:
            for archive, content in zip(b["archive"], b["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        if not name.endswith("/"):
                            yield pd.DataFrame({"archive": [archive], "name": [name], "content": [z.read(name)]})

    whole = parts.groupBy("archive").agg(F.sort_array(F.collect_list(F.struct("part", "content"))).alias("p"))
    joined = whole.select("archive", F.aggregate(F.transform("p", lambda x: x["content"]), F.lit(b""), lambda a, b: F.concat(a, b)).alias("content"))
    return joined.mapInPandas(run, "archive string, name string, content binary")
