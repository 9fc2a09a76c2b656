"""Pronunciations by dictionary, lower case and guess, in word order."""

from pyspark.sql import functions as F

from strophe.operators.phonemes import sentence_alliteration, sentence_phones


def test_sentences(spark):
    d = spark.createDataFrame([("big", "bˈɪɡ"), ("bad", "bˈæd"), ("wolf", ""), ("about", "əbˈaʊt")], "word string, ipa string")
    df = spark.createDataFrame([(1, "Big bad, wolf about"), (2, "..."), (3, "bad bad")], "id int, verse string")
    got = {r["id"]: r["ipa"] for r in sentence_phones(df, ["id"], "verse", d).collect()}
    assert got == {1: ["bˈɪɡ", "bˈæd", "w", "əbˈaʊt"], 2: [], 3: ["bˈæd", "bˈæd"]}
    score = {r["id"]: round(r["score"], 4) for r in sentence_alliteration(df, ["id"], "verse", d).collect()}
    assert score[2] == 0
    assert score[1] > 0


def test_words_move_once_for_a_piece(spark, monkeypatch):
    """Pieces of a few rows, rows with the same and null ids, a word without an entry; what goes to the dictionary are the different words of a piece."""
    from strophe.operators import phonemes

    d = spark.createDataFrame([("big", "bˈɪɡ"), ("bad", None), ("wolf", "")], "word string, ipa string")
    data = [(i, 0, "Big bad wolf big big big") for i in range(40)] + [(50, None, "big"), (51, 0, None), (52, 0, ""), (53, 0, "zoo, big"), (53, 0, "bad"), (54, 0, "big " * 30), (55, 0, "!")]
    df = spark.createDataFrame(data, "id int, part int, verse string")
    want = sorted(map(str, phonemes.of_shared_ids(df, ["id", "part"], "verse", d).collect()))
    seen, looked_up = [], phonemes.looked_up
    monkeypatch.setattr(phonemes, "looked_up", lambda w, *a, **k: seen.append(w.select(F.explode("_piece")).count()) or looked_up(w, *a, **k))
    for piece, long in ((8192, 10_000), (2, 50)):
        monkeypatch.setattr(phonemes, "PIECE", piece)
        monkeypatch.setattr(phonemes, "LONG", long)
        assert sorted(map(str, phonemes.sentence_phones(df, ["id", "part"], "verse", d).collect())) == want
    assert seen[0] < 40
