"""Learning-rate search against plain numpy, and attribution on hand-made rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strophe.functions import attribution
from strophe.operators import search
from strophe.plans import catalogue

from .conftest import SF


def plain_fit(x, y, rate, steps):
    w = np.zeros(x.shape[1] + 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
        w -= rate * np.append((p - y) @ x, (p - y).sum()) / len(y)
    return w


def f1(y, p):
    out = []
    for k in (0, 1):
        tp, both = ((y == k) & (p == k)).sum(), (y == k).sum() + (p == k).sum()
        out.append(2 * tp / both if both else 0.0)
    return sum(out) / 2


def test_search_against_numpy(spark):
    rows = catalogue._featured(spark, SF).collect()
    df = spark.createDataFrame(rows).repartition(3)
    got = search.grid_search(df, catalogue.RATES, 12).orderBy("rate").collect()
    of = lambda name: (np.array([r["features"] for r in rows if r["split"] == name]), np.array([r["label"] for r in rows if r["split"] == name]))
    (x, y), (dx, dy), (tx, ty) = of("train"), of("dev"), of("test")
    want = [plain_fit(x, y, rate, 12) for rate in catalogue.RATES]
    said = lambda x, w: (x @ w[:-1] + w[-1] >= 0).astype(int)
    for r, w in zip(got, want, strict=True):
        assert np.allclose(r["weights"], w, atol=1e-9)
        assert r["dev_f1"] == pytest.approx(f1(dy, said(dx, w))) and r["test_f1"] == pytest.approx(f1(ty, said(tx, w)))
    best = max(range(5), key=lambda i: (f1(dy, said(dx, want[i])), -i))
    assert [r["chosen"] for r in got] == [i == best for i in range(5)]


def test_search_of_nothing(spark):
    empty = spark.createDataFrame([], "features array<double>, label int, split string")
    got = search.grid_search(empty, [0.1, 1.0], 2).orderBy("rate").collect()
    assert [(r["dev_f1"], r["chosen"]) for r in got] == [(0.0, True), (0.0, False)]


def test_attribution(spark):
    rows = [(1, "aé b🎉", [0.0, 1.0, 3.0, 9.0, 4.0, 1.0, 2.0, 3.0, 10.0]), (2, "", []), (3, None, None), (4, "xx", [2.0, 2.0]), (None, "x", None)]
    df = spark.createDataFrame(rows, "id long, text string, s array<double>").withColumn("scores", attribution.rescaled(F.col("s"))).drop("s")
    got = {r["id"]: r for r in attribution.shaded(df).collect()}
    assert got[1]["means"] == pytest.approx([0, 0.2, 0.9, 0.4, 0.4])
    assert [got[i]["shades"] for i in (1, 2, 3, 4, None)] == [[0, 1, 0, 2, 2], [], None, [0, 0], None]
