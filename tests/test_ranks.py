"""Places and running sums of whole tables, against plain sorting."""

import random

from strophe.operators import ranks


def rows_of(n, seed=1):
    rng = random.Random(seed)
    return [(i, rng.choice([None, "a", "a", "a", "b"]), rng.choice([None, 1, 2, 3, i]), rng.randrange(9)) for i in range(n)]


def test_numbered(spark):
    rows = rows_of(500)
    df = spark.createDataFrame(rows, "id long, k string, v long, w long").repartition(5)
    got = {r["id"]: (r["p"], r["n"]) for r in ranks.numbered(df, ["k"], ["v", "id"], "p", "n").collect()}
    rank = lambda x: (x is not None, x if x is not None else 0)
    for k in (None, "a", "b"):
        own = sorted((r for r in rows if r[1] == k), key=lambda r: (rank(r[2]), r[0]))
        assert [got[r[0]] for r in own] == [(i, len(own)) for i in range(len(own))]
    whole = {r["id"]: r["place"] for r in ranks.numbered(df, [], ["id"]).collect()}
    assert whole == {i: i for i in range(500)}


def test_numbered_without_order(spark):
    """Rows that agree in keys and order have different places; a table that holds one row many times is dealt over several ranges."""
    df = spark.createDataFrame([("x", 1)] * 3000, "k string, v long")
    got = ranks.numbered(df, ["k"], ["v"])
    assert sorted(r["place"] for r in got.collect()) == list(range(3000))
    empty = ranks.numbered(df.limit(0), ["k"], ["v"], "p", "n")
    assert empty.collect() == [] and empty.columns == ["k", "v", "p", "n"]


def test_running_sum(spark):
    rows = rows_of(400, 2)
    df = spark.createDataFrame(rows, "id long, k string, v long, w long").repartition(7)
    got = {r["id"]: r["before"] for r in ranks.running_sum(df, ["id"], "w").collect()}
    total = 0
    for i, _, _, w in rows:
        assert got[i] == total
        total += w
    assert ranks.running_sum(df.limit(0), ["id"], "w").collect() == []
    assert "SinglePartition" not in ranks.running_sum(df, ["id"], "w")._jdf.queryExecution().executedPlan().toString()
