"""Scores of byte tokens shown on characters: rescaled by row, means by character, as one of six shades."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .core import let


def rescaled(scores: Column) -> Column:
    """To 0 for the least and 1 for the greatest of a row; all 0 if they are equal."""
    span = F.struct(F.array_min(scores).alias("low"), F.array_max(scores).alias("high"))
    return let(span, lambda x: F.transform(scores, lambda s: F.when(x["high"] > x["low"], (s - x["low"]) / (x["high"] - x["low"])).otherwise(0.0)))


def _means(x: str, s) -> np.ndarray:
    data = np.frombuffer(x.encode(), np.uint8)
    if len(s) != len(data):
        raise ValueError(f"{len(s)} scores for {len(data)} bytes")
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    return np.add.reduceat(np.asarray(s, float), lead) / np.diff(np.append(lead, len(s))) if len(lead) else np.zeros(0)


def _steps(x: str, means: np.ndarray) -> np.ndarray:
    step = np.ceil(np.round(means * 10) / 2).astype(np.int32)
    step[[i for i, c in enumerate(x) if c.isspace()]] = 0
    return step


def shade_counts(text: Column, score_of_byte: list[float]) -> Column:
    """Of each text how many of its characters have each of the six shades, where a byte's score is that of its value; scores are rescaled by text as in ``rescaled``."""
    table = np.array(score_of_byte)

    def one(x):
        if x is None:
            return None
        s = table[np.frombuffer(x.encode(), np.uint8)]
        low, high = s.min(initial=np.inf), s.max(initial=-np.inf)
        s = (s - low) / (high - low) if high > low else np.zeros(len(s))
        return np.bincount(_steps(x, _means(x, s)), minlength=6).astype(np.int64)

    @F.pandas_udf("array<bigint>")
    def counted(texts: pd.Series) -> pd.Series:
        return pd.Series([one(x) for x in texts], dtype=object)

    return counted(text)


def shaded(df: DataFrame, text: str = "text", scores: str = "scores") -> DataFrame:
    """df's other columns with means (of each character the mean score of its UTF-8 bytes) and shades: of each character the first of 0, 0.2, 0.4, 0.6, 0.8 and 1
    (0 to 5) that its mean, rounded to tenths (half to even), doesn't exceed; 0 for white space.

    A text's scores are one for each byte, from 0 to 1, or the query fails. Without a text or scores both are null.
    """
    rest = [c for c in df.columns if c not in (text, scores)]

    def run(batches):
        for b in batches:
            given = [None if x is None or s is None else _means(x, s) for x, s in zip(b[text], b[scores], strict=True)]
            steps = [None if m is None else _steps(x, m) for x, m in zip(b[text], given, strict=True)]
            yield pd.DataFrame({**{c: b[c] for c in rest}, "means": given, "shades": steps})

    kinds = dict(df.dtypes)
    return df.select(*rest, text, scores).mapInPandas(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in rest), "means array<double>", "shades array<int>"]))
