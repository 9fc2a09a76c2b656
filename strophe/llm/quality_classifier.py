"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

One pass over the texts gives each document a vector of statistics (a few dozen bytes); all else works on these. Random
cosines approximate a Gaussian kernel; every partition of the labelled sample sums its part of the normal equations, and the driver adds
a bounded number of them and solves. A fifth of the sample, kept from the fit, calibrates the scores by pooled adjacent violators.

Null and empty texts have zero statistics, and a score like any other. Without labels of both classes every score is 0.5.
Repeated rows get equal scores, and teach once; rows that repeat a doc_id are scored by their own text, and each teaches with the doc_id's label (both, if it has two).
Null doc_ids are scored too (not held out), and teach nothing. Equal raw scores share a calibrated one. Very long texts are measured whole. Columns
beyond doc_id and text play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytes_ import _SPACE, batches_of, mix, powers, words_of
from .common import Scratch, arrow_rows, drop_inputs, table
from .labels import BOUND, held_out, labelled

FEATURES = 256
WIDTH = 3.0  # of the kernel, in standard deviations of the statistics
RIDGE = 1.0
PARTS = 16
N = 18
SYMBOL = np.isin(np.arange(256), list(b"#*$%&<>~^=_{}[]@"))
STOP = np.isin(np.arange(256), list(b".,;:?"))


def statistics(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One row of N statistics for each text of a chunk."""
    docs, size = len(starts), (ends - starts).astype(float)
    which = np.repeat(np.arange(docs), ends - starts)
    count = lambda mask: np.bincount(which[mask], minlength=docs).astype(float)
    second = np.zeros(len(data), bool)
    second[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    upper = count(((data >= 65) & (data <= 90)) | second)
    first, last, doc = words_of(data, starts, ends)
    n = np.bincount(doc, minlength=docs).astype(float)
    width = (last - first).astype(float)
    mean = np.bincount(doc, width, docs) / np.maximum(n, 1)
    spread = np.sqrt(np.maximum(np.bincount(doc, width**2, docs) / np.maximum(n, 1) - mean**2, 0))
    word = mix(powers.spans(data, first, last)) if len(first) else np.zeros(0, np.uint64)

    def distinct(h, d):
        order = np.lexsort((h, d))
        h, d = h[order], d[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        return np.bincount(d[new], minlength=docs)

    pair = (doc[1:] == doc[:-1]) if len(doc) else np.zeros(0, bool)
    two = mix(word[:-1] * np.uint64(31) + word[1:])[pair] if len(doc) else word
    pairs, d2 = np.bincount(doc[1:][pair], minlength=docs) if len(doc) else np.zeros(docs), doc[1:][pair] if len(doc) else doc
    same = np.bincount(d2[(word[1:] == word[:-1])[pair]], minlength=docs) if len(doc) else np.zeros(docs)
    line = np.zeros(256, bool)
    line[10] = True
    a, b, ld = words_of(data, starts, ends, line)
    lines = np.bincount(ld, minlength=docs)
    other = distinct(mix(powers.spans(data, a, b)), ld) if len(a) else np.zeros(docs)
    rate = lambda x, of=size: x / np.maximum(of, 1)
    small = np.log1p
    out = [
        small(n), small(mean), small(spread), small(100 * rate(count(SYMBOL[data]))), small(100 * rate(count(data == 124))), small(100 * rate(count(data == 33))),
        rate(upper), rate(count((data >= 48) & (data <= 57))), rate(count(STOP[data])), rate(count(data >= 128)), rate(count(_SPACE[data])), rate(distinct(word, doc), n),
        rate(distinct(two, d2), pairs), rate(same, pairs), rate(lines - other, lines), small(rate(n, lines)), small(lines), rate(np.bincount(doc[width <= 3], minlength=docs), n),
    ]
    return np.nan_to_num(np.stack(out, 1)).astype(np.float32)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and x (N floats) of each whole text."""

    def run(batches):
        for keys, data, starts, ends in batches_of(batches):
            x = statistics(data, starts, ends)
            yield pa.RecordBatch.from_arrays([keys, pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "x"])

    return drop_inputs(docs, "doc_id", "text").mapInArrow(run, "doc_id long, x binary")


def cosines(x: np.ndarray, centre: np.ndarray, scale: np.ndarray, features: int, width: float) -> np.ndarray:
    rng = np.random.default_rng(20)
    w, b = rng.normal(0, 1 / width, (x.shape[1], features)), rng.uniform(0, 2 * np.pi, features)
    z = np.clip((x - centre) / scale, -6, 6)
    return np.concatenate([np.ones((len(x), 1)), z, np.cos(z @ w + b) * np.sqrt(2 / features)], 1)


def unpack(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, N).astype(float)


def summed(rows: DataFrame, f) -> np.ndarray:
    """The sum over all partitions of f(x, y), made partition by partition; PARTS partitions reach the driver."""

    def run(batches):
        total = None
        for b in batches:
            if b.num_rows:
                part = f(unpack(b.column(0)), np.array(b.column(1).to_pylist(), float))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([str(total.shape)], pa.string())], ["total", "shape"])

    got = rows.select("x", "y").repartition(PARTS).mapInArrow(run, "total binary, shape string").collect()
    return sum(np.frombuffer(r["total"]).reshape([int(v) for v in r["shape"].strip("(),").split(",") if v.strip()]) for r in got)


def pooled(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression by pooling adjacent violators: centres of blocks and their means."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, v in zip(score[order], y[order], strict=True):
        blocks.append([v, 1.0, s])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            a = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], a, strict=True)]
    v, n, s = np.array(blocks).T
    return s / n, (v + 0.02) / (n + 0.04)  # a block of few rows is not quite sure


def fit(rows: DataFrame, features: int = FEATURES, width: float = WIDTH, ridge: float = RIDGE) -> dict | None:
    """rows (doc_id, x, y), a bounded number -> the model."""
    moments = summed(rows, lambda x, y: np.concatenate([[len(x), y.sum()], x.sum(0), (x**2).sum(0)]))
    if np.ndim(moments) == 0 or not 0 < moments[1] < moments[0]:
        return None
    n = moments[0]
    centre = moments[2 : 2 + N] / n
    scale = np.sqrt(np.maximum(moments[2 + N :] / n - centre**2, 1e-6)) + 1e-3
    calibrate = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5)) == 0

    def equations(x, y):
        z = cosines(x, centre, scale, features, width)
        return np.concatenate([z.T @ z, (z.T @ y)[:, None]], 1)

    sums = summed(rows.filter(~calibrate), equations)
    if np.ndim(sums) == 0:
        return None
    weight = np.linalg.solve(sums[:, :-1] + ridge * np.eye(len(sums)), sums[:, -1])
    model = {"centre": centre, "scale": scale, "weight": weight, "features": features, "width": width, "at": None}
    pairs = rows.filter(calibrate).select("x", "y").collect()  # a fifth of a bounded sample
    if pairs:
        x = np.frombuffer(b"".join(bytes(r["x"]) for r in pairs), np.float32).reshape(-1, N).astype(float)
        model["at"], model["value"] = pooled(cosines(x, centre, scale, features, width) @ weight, np.array([r["y"] for r in pairs], float))
    return model


def predict(model: dict | None, x: np.ndarray) -> np.ndarray:
    if model is None:
        return np.full(len(x), 0.5)
    raw = cosines(x, model["centre"], model["scale"], model["features"], model["width"]) @ model["weight"]
    if model["at"] is None:
        return np.clip(raw, 0, 1)
    # the calibrated value, and a trace of the raw one to keep the order within a block
    return np.clip(0.999 * np.interp(raw, model["at"], model["value"]) + 0.001 * np.clip(raw, 0, 1), 0, 1)


def score_quality(docs: DataFrame, labels: DataFrame, bound: int = BOUND) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "classifier")
    with arrow_rows(spark, 1000):
        xs = scratch.keep(measured(docs))
    rows = labelled(xs, labels, "quality", scratch.keep, "x", bound)
    model = fit(rows)

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(predict(model, unpack(b.column(1))))], ["doc_id", "score"])

    out = xs.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
