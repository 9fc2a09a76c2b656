"""Last rhyme pairs: what has no equal stays where it is."""

from pyspark.sql import functions as F

from strophe.operators import pairs
from strophe.plans import catalogue

from .conftest import SF

PAIR = ["doc_id", "lang", "v1", "v2", "label"]


def rows(df):
    return sorted(map(str, df.collect()))


def test_repeated_verses_and_ids(spark):
    """Against the plain form, on repeated lines, ids that rows share (null ones, too), more repeated lines than are held and empty texts."""
    many = "\n".join([f"line {i % 70} end" for i in range(150)])
    texts = ["a b\nc b\na b\nd e", "\n\n\n", "", None, many, "x\ny\nz", "x\ny\nw\n" * 7, "one a\ntwo a\nthree a", "one a\ntwo a\nthree a\none a"]
    data = [(i, "en", x) for i, x in enumerate(texts)] + [(7, "en", "two a\none a\nfour"), (7, None, "two a\none a"), (7, None, "one a\ntwo a"), (None, "de", "p a\nq a"), (None, "de", "q a\np a\nr"), (None, None, "p a\nq a")]
    docs = spark.createDataFrame(data, "doc_id long, lang string, text string")
    v, s = F.col("verses"), F.col("scheme")
    want = rows(pairs.keep_last(pairs.rhyme_pairs(catalogue._stanzas(docs), v, s).select(*PAIR, "stanza", "j", "k"), PAIR, ["stanza", "j", "k"]))
    for most in (64, 1, 1000):
        held = pairs.with_repeats(docs, ["doc_id", "lang"], F.split("text", "\n"), most)
        assert rows(pairs.last_pairs(catalogue._stanzas(held, "_repeated"), v, s, ["doc_id", "lang"])) == want
    assert len(want) > 300


def test_few_pairs_move(spark, monkeypatch):
    moved, keep_last = [], pairs.keep_last
    monkeypatch.setattr(pairs, "keep_last", lambda df, keys, order: moved.append(df.count()) or keep_last(df, keys, order))
    n = catalogue.rhyme_pairs_mined(spark, SF).count()
    assert len(moved) == 1
    assert moved[0] < 0.25 * n
