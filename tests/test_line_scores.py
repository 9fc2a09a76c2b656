"""Lines are scored once for their text, however many windows, pairs and means read the scores, and nothing is shuffled for it."""

import math

import pytest
from pyspark.sql import functions as F

from strophe.functions import prosody
from strophe.plans import catalogue

from .conftest import SF


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["harmonic_meter_score", "merged_metrics", "generated_report", "quatrain_statistics", "training_sequences", "mode_first_tie"])
def test_meter_once(spark, name):
    assert plan(catalogue.queries()[name](spark, SF)).count("^...I.....I$") == 1


@pytest.mark.parametrize("name", ["rhyme_scheme_from_mask", "alliteration_score", "quatrain_annotation", "training_sequences", "mode_first_tie", "emotion_label_set", "generated_report"])
def test_no_shuffle(spark, name):
    assert "Join" not in plan(catalogue.queries()[name](spark, SF)) and "Aggregate" not in plan(catalogue.queries()[name](spark, SF))


def test_alliterations(spark):
    """The same sums as the expression's, and a plain loop's for very many phones (short and long ways of counting)."""
    rows = [(["ab", "a", "ab"],), ([],), (["x"],), (list("abcabcaab"),), (list("ab" * 200 + "ccddee" * 30),)]
    rows.append((list("a" * 700 + "bcd" * 50 + "a" * 3),))
    df = spark.createDataFrame(rows, "p array<string>")
    got = df.select(prosody.alliterations(F.array("p"))[0].alias("x"), prosody.alliteration(F.col("p")).alias("y")).collect()
    for r, (p,) in zip(got, rows, strict=True):
        n = len(p)
        plain = sum(sum(p[i] == p[i + d] for i in range(n - d)) / d for d in range(1, n)) / sum((n - d) / d for d in range(1, n)) if n > 1 else 0.0
        assert r["x"] == r["y"] and math.isclose(r["x"], plain, abs_tol=1e-12)


def test_balanced(spark):
    """Only dissonances of slices of the hash that can be chosen keep their texts; repeated pairs count once; both ways choose the same."""
    from hashlib import md5

    from strophe.operators import pairs

    rows = [(s, f"a{i}|", f"|b{i % 7}", "rhyme" if i % (5 + s) == 0 else "dissonance") for s in (0, 1, 2) for i in range(400)]
    rows += [(1, "a", "b|c", "dissonance"), (1, "a|b", "c", "dissonance"), (3, "x", "y", "dissonance")]
    df = spark.createDataFrame(rows * 2, "s int, v1 string, v2 string, label string")
    want = []
    for s in range(4):
        own = sorted({r for r in rows if r[0] == s}, key=lambda r: (md5(f"{r[1]}|{r[2]}".encode()).hexdigest(), r[1], r[2]))
        rhymes = [r for r in own if r[3] == "rhyme"]
        want += rhymes + [r for r in own if r[3] == "dissonance"][: len(rhymes)]
    for way in (pairs.balanced, pairs.balanced_within):
        got = way(df, ["s"])
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert "max_by" not in plan(catalogue.queries()["balanced_negatives"](spark, SF))


def test_rows_leave_in_pieces():
    """What is made of a batch does not add up: a batch of 10,000 texts or files is counted and parsed in pieces."""
    import pandas as pd

    from strophe.operators import language_model

    texts = pd.Series(["abc", None, "d" * 50, "", "e" * 9, "f"])
    got = [list(p) for p in language_model.parts(texts, 10)]
    assert [x for p in got for x in p] == list(texts) and len(got) > 2
    assert list(language_model.parts(texts[:0], 10)) == []


def test_files_leave_in_pieces(spark):
    """How large a piece is does not change what is read."""
    from strophe.sources import readers

    df = spark.createDataFrame([(f"/{i}", "x" * (i % 7)) for i in range(50)] + [("/n", None)], "path string, content string").coalesce(1)
    rows = lambda chars: sorted(tuple(r) for r in readers.per_file(df, lambda c: [(x,) for x in c], "x string", chars).collect())
    assert rows(3) == rows(10**6) and len(rows(3)) == sum(i % 7 for i in range(50))


def test_words_alone(spark):
    """Tokens of letters and digits need no look at each; others still get it."""
    from strophe.functions import rules

    tokens = [(["Die", "Äpfel", "2", "é"],), ([],), (["a", "'s", "b"],), (["(", "x", ")", ","],), (["&quot;", "x", "&quot;"],)]
    df = spark.createDataFrame(tokens, "t array<string>")
    assert [r[0] for r in df.select(rules.detokenize(F.col("t"), "en")).collect()] == ["Die Äpfel 2 é", "", "a's b", "(x),", '"x"']


def test_shade_counts(spark):
    """The same as counting the shades of all characters."""
    from strophe.functions import attribution, tokens

    table = [((i * 37) % 101) / 101 for i in range(256)]
    df = spark.createDataFrame([("Grüße, Welt\n 🎵 x",), ("aaa",), ("",), (None,), ("  ",)], "text string")
    scores = attribution.rescaled(F.transform(tokens.byte_ids(F.col("text"), 0), lambda b: F.get(F.array(*map(F.lit, table)), b)))
    want = [None if r["shades"] is None else [r["shades"].count(i) for i in range(6)] for r in attribution.shaded(df.select("text", scores.alias("scores"))).collect()]
    assert [r[0] for r in df.select(attribution.shade_counts(F.col("text"), table)).collect()] == want


def test_phones_are_counted_by_numpy(spark):
    """Scores of sentences come from ``alliterations``, not from folds over folds."""
    p = plan(catalogue.queries()["sentence_phones"](spark, SF))
    assert "ArrowEvalPython" in p and "zip_with" not in p and "zipwith" not in p.lower()


def test_training_sequences_clean_a_line_once(spark, monkeypatch):
    """Lines are cleaned before windows are cut, and the training texts are those of verses cleaned by window."""
    from pyspark.sql import functions as F

    from strophe.functions import tokens

    windows = catalogue.quatrains(spark, SF, "clean")
    same = F.array_join("clean", "\n") == tokens.clean_verses(F.col("quatrain"))
    assert windows.filter(~same).count() == 0 < windows.count()
    monkeypatch.setattr(tokens, "clean_verses", None)
    assert catalogue.training_sequences(spark, SF).count() > 100


def test_parsed_text(spark):
    from pyspark.sql import functions as F

    from strophe.functions import tokens

    texts = ["<s><extra_id_9><extra_id_3><extra_id_0>a\nb</s>c</s>", "<s><extra_id_9><extra_id_3><extra_id_0>", "<s><extra_id_9><extra_id_3>a</s>", "x<s><extra_id_9><extra_id_3><extra_id_0>a", ""]
    got = spark.createDataFrame([(x,) for x in texts], "x string").select("x", tokens.parsed_text(F.col("x")).alias("p")).select("x", "p.quatrain", F.col("p.rhyme").isNotNull().alias("r")).collect()
    assert {r["x"]: (r["quatrain"], r["r"]) for r in got} == {texts[0]: ("a\nb", True), texts[1]: ("", True), texts[2]: ("", False), texts[3]: ("", False), "": ("", False)}


def test_lines_of_as_many_phones_go_together(monkeypatch):
    """The same values to the last bit, and hardly a line by itself."""
    import random

    rng = random.Random(6)
    line = lambda n, of: "\0".join(rng.choice(of) for _ in range(n))
    lines = [line(rng.randrange(1, 40), "abcdé🎉") for _ in range(500)] + [line(n, ["a", "b", ""]) for n in range(1, 9)] + [line(n, ["a", "bc"]) for n in range(1, 9)] + ["", "a", "\0", "\0a", "a\0", "a\0\0", line(256, "abc"), line(257, "abc"), line(700, "abc")]
    want, alone, one = [prosody._alliterating(x) for x in lines], [], prosody._alliterating
    monkeypatch.setattr(prosody, "_alliterating", lambda x: alone.append(x) or one(x))
    assert prosody._alliterating_all(lines) == want == prosody._alliterating_all(lines, 50)
    assert len(alone) < 2 * 60
