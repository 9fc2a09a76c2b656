"""Search over learning rates: one logistic model for each, all trained by the same passes over the data, the best chosen by macro F1."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Of each row (rows by features) under each model (models by features and a bias): rows by models."""
    return 1 / (1 + np.exp(-np.clip(x @ w[:, :-1].T + w[:, -1], -60, 60)))


def gradients(df: DataFrame, w: np.ndarray, features: str, label: str) -> np.ndarray:
    """Sum over all rows of each model's gradient, and the number of rows behind it; a partition gives one small matrix, whatever its size."""
    models, width = w.shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros((models, width)), 0
        for b in batches:
            if len(b):
                x, y = np.stack(b[features].to_numpy()), b[label].to_numpy(float)
                gap = probability(x, w) - y[:, None]
                total += np.column_stack([gap.T @ x, gap.sum(0)])
                n += len(b)
        yield pd.DataFrame({"at": range(models * width + 1), "value": [*total.ravel(), float(n)]})

    sums = df.select(features, label).mapInPandas(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(models * width + 1)
    for r in sums:  # as many as weights
        out[r["at"]] = r["value"]
    return np.append(out[:-1].reshape(models, width) / max(1.0, out[-1]), np.full((models, 1), out[-1]), 1)


def fit(df: DataFrame, rates: list[float], steps: int, features: str = "features", label: str = "label") -> np.ndarray:
    """Weights (models by features and a bias) after some steps of gradient descent with each rate, from zero; a pass over the data for each step, not for each model."""
    first = df.select(F.size(features).alias("n")).first()
    w = np.zeros((len(rates), (first["n"] if first else 0) + 1))
    for _ in range(steps if first else 0):
        w -= np.array(rates)[:, None] * gradients(df, w, features, label)[:, :-1]
    return w


def predict(df: DataFrame, w: np.ndarray, features: str = "features") -> DataFrame:
    """df with said: of each model 0 or 1."""

    @F.pandas_udf("array<int>")
    def said(x: pd.Series) -> pd.Series:
        return pd.Series(list((probability(np.stack(x.to_numpy()), w) >= 0.5).astype(np.int32)))

    return df.withColumn("said", said(features))


def scores(df: DataFrame, label: str = "label", said: str = "said") -> DataFrame:
    """model and f1, the mean F1 of both classes (0 where undefined), of all models by one aggregation."""
    each = df.select(label, F.posexplode(said).alias("model", "p")).groupBy("model").agg(
        *[F.count_if((F.col(label) == k) & (F.col("p") == k)).alias(f"tp{k}") for k in (0, 1)], *[F.count_if(F.col(label) == k).alias(f"real{k}") for k in (0, 1)], *[F.count_if(F.col("p") == k).alias(f"said{k}") for k in (0, 1)]
    )
    f1 = lambda k: F.when(F.col(f"real{k}") + F.col(f"said{k}") == 0, 0.0).otherwise(2 * F.col(f"tp{k}") / F.greatest(F.lit(1), F.col(f"real{k}") + F.col(f"said{k}")))
    return each.select("model", ((f1(0) + f1(1)) / 2).alias("f1"))


def grid_search(df: DataFrame, rates: list[float], steps: int, features: str = "features", label: str = "label", split: str = "split") -> DataFrame:
    """rate, dev_f1, test_f1, chosen (the best on dev; the first of several) and weights of each rate. split: train, dev or test."""
    w = fit(df.filter(F.col(split) == "train"), rates, steps, features, label)
    judged = predict(df.filter(F.col(split) != "train"), w, features)
    found = {(name, r["model"]): r["f1"] for name in ("dev", "test") for r in scores(judged.filter(F.col(split) == name), label).collect()}  # as many as rates
    dev = [found.get(("dev", i), 0.0) for i in range(len(rates))]
    rows = [(float(x), dev[i], found.get(("test", i), 0.0), i == int(np.argmax(dev)), w[i].tolist()) for i, x in enumerate(rates)]
    return df.sparkSession.createDataFrame(rows, "rate double, dev_f1 double, test_f1 double, chosen boolean, weights array<double>")
