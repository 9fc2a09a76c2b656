"""Sinks: JSON Lines by Spark, small statistics as one JSON document."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def nested(df: DataFrame, keys: list[str], value: str, most: int = 100_000) -> dict:
    """A small aggregate as nested dictionaries; more rows than ``most`` are an error."""
    rows = df.select(*keys, value).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("too many rows for one document")
    out: dict = {}
    for row in rows:
        at = out
        for k in keys[:-1]:
            at = at.setdefault("all" if row[k] is None else row[k], {})
        at[row[keys[-1]]] = row[value]
    return out


def dump(value: dict, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=2)
