"""Golden values of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from strophe.functions import enums, prosody, text, tokens
from strophe.operators import annotate, metrics, splits
from .miniatures import FILES
from strophe.sources import readers

FORMS = {
    "-+-+-+-+-+": "iambic.penta", "-+|-+|-+|-+": "iambic.tetra", "+-+-+-+-": "trochaic.tetra", "+--+--+--+": "dactylic.tetra", "-+--+--+-": "amphibrach.tri", "--+--+": "anapaest.di.plus", "++": "spondeus", "": "other",
    "+--+-": "amphibrach.di.relaxed", "-+-+-+-+-+-+": "alexandrine.iambic.hexa", "+-+--+-+": "glykoneus", "++-+-+-+": "iambic.tetra", "+--+-+-+-+": "iambic.penta.invert", "wsws": "iambic.di",
    "-+-+-+-+-+-+-+": "iambic.septa.plus", "+--+--+--+--+--+-": "hexameter", "-+--+-+-+": "iambic.tetra.relaxed", "+--+": "iambic.di.relaxed.chol", "+": "single.up", "-": "single.down",
}
NORMAL = {
    "Jch weiß": "Ich weiß", "’Tis so": "'tis so", "O’er hill": "O'er hill", "THe end": "The end", "THE END": "THE END", "ſo ſüß": "so süß", "[x] <i>y</i>": "x y", "ein ’ n": "ein ' n", "a — b": "a -- b", "a - b": "a-b",
    "''q''": '"q"', "goͤttlich": "göttlich", "&#8222;hm": "”hm", "ꝛot": "rot", "b'abc'": "abc", "'TIs": "'TIs",
}
PHONES = {"": 0, "a": 0, "aa": 1, "ab": 0, "abaa": 0.423077, "aabb": 0.461538, "abab": 0.230769, "abcabc": 0.114943}


def mapped(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", f(F.col("v")).alias("x")).orderBy("i").collect()
    return [r["x"] for r in rows]


def test_versification(spark):
    assert mapped(spark, FORMS, lambda v: prosody.versification(prosody.stresses(v))) == list(FORMS.values())
    assert mapped(spark, [None], lambda v: prosody.versification(prosody.stresses(v))) == [None]
    assert len(prosody.FORMS) == 66


def test_foot_and_metre(spark):
    forms = ["iambic.penta", "hexameter", "anapaest.di.plus"]
    assert mapped(spark, forms, lambda v: prosody.foot_and_metre(v)[0]) == ["iambic", "hexameter", "anapaest"]
    assert mapped(spark, forms, lambda v: prosody.foot_and_metre(v)[1]) == ["penta", "hexameter", "di.plus"]


def test_meter_label(spark):
    names = ["iambic", "trochaic", "dactylic", "anapestic", "spondeus", "hexameter"]
    assert mapped(spark, names, prosody.meter_label) == ["iambus", "trochee", "dactyl", "anapaest", "other", "other"]
    assert mapped(spark, ["spondeus", "single"], lambda v: prosody.meter_label(v, False)) == ["spondee", "single"]
    with pytest.raises(Exception, match="unknown meter"):
        mapped(spark, ["single"], prosody.meter_label)


def test_normalize(spark):
    assert mapped(spark, NORMAL, text.normalize_characters) == list(NORMAL.values())


def test_alliteration(spark):
    got = mapped(spark, PHONES, lambda v: F.round(prosody.alliteration(F.regexp_extract_all(v, F.lit("."), F.lit(0))), 6))
    assert got == list(PHONES.values())
    assert mapped(spark, ["0.01", "0.05", "0.1"], lambda v: prosody.alliteration_level(v.cast("double"))) == ["low", "medium", "high"]


def test_scheme_repetition(spark):
    one = lambda base, n: spark.range(1).select(prosody.repeated_scheme(F.array(*map(F.lit, base)), F.lit(n)).alias("s")).first()["s"]
    assert [one("aabb", 8), one("abab", 10), one("aa", 5)] == ["aabbccdd", "ababcdcdef", "aabbc"]
    assert one("abcd", 28).endswith("yz{|")


def test_masks(spark):
    got = mapped(spark, [str(i) for i in range(64)], prosody.scheme_of_mask)
    assert len(enums.SCHEME_BY_MASK) == 64
    assert sum(x is None for x in got) == 23
    assert set(got) - {None} <= set(enums.RHYME_SCHEMES)
    assert (got[0], got[3], got[10], got[33], got[63]) == ("ABCD", "AAAB", "ABBC", "AABB", "AAAA")


def test_inferred_scheme(spark):
    rows = [(t, m) for t in enums.RHYME_SCHEMES for m in range(64)]
    df = spark.createDataFrame(rows, "t string, m int").select("t", "m", annotate.inferred_scheme(F.col("t"), F.col("m")).alias("found"))
    found = {(r["t"], r["m"]): r["found"] for r in df.collect()}
    assert set(found.values()) <= set(enums.RHYME_SCHEMES)
    for t in enums.RHYME_SCHEMES:
        own = sum(1 << b for b, (i, j) in enumerate(enums.PAIRS) if t[i] == t[j])
        assert found[t, own] == t  # what rhymes as its target has its scheme
        assert found[t, 0] == "ABCD"
        assert found[t, 63] == "AAAA"
    assert found == {(t, m): plain_scheme(t, m) for t, m in rows}


def plain_scheme(target, mask):
    """Pairs that the target rhymes first, then the others from the last: a verse of its own class takes in the class of another if it rhymes with all of it."""
    rhymes = {p for b, p in enumerate(enums.PAIRS) if mask >> b & 1}
    scheme = list("ABCD")
    pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    for i, j in [p for p in pairs if target[p[0]] == target[p[1]]] + [p for p in reversed(pairs) if target[p[0]] != target[p[1]]]:
        members = [k for k in range(4) if scheme[k] == scheme[j]]
        if scheme[i] == "ABCD"[i] and all((min(i, k), max(i, k)) in rhymes for k in members):
            scheme = [scheme[i] if x == scheme[j] else x for x in scheme]
    names = {}
    return "".join(names.setdefault(x, "ABCD"[len(names)]) for x in scheme)


def test_style_tokens(spark):
    assert mapped(spark, ["high", "low", "alexandrine", "trochee", "AAAA", "ABCD"], tokens.style_id) == [0, 2, 3, 9, 10, 24]


def test_bytes(spark):
    assert mapped(spark, ["A", "ä", ""], tokens.byte_ids) == [[69], [199, 168], []]
    df = spark.createDataFrame([([0, 69, 199, 168, 1, 199, 270],)], "ids array<int>")
    assert df.select(tokens.decode_ids()("ids").alias("t")).first()["t"] == "Aä"


def test_shown_specials(spark):
    df = spark.createDataFrame([([0, 69, 199, 168, 1, 199, 270],)], "ids array<int>")
    assert df.select(tokens.decode_ids(shown={**tokens.SPECIALS4, 270: "<|extra_10|>"})("ids").alias("t")).first()["t"] == "<s>Aä</s><|extra_10|>"
    assert mapped(spark, ["ab", " ab", ""], lambda v: tokens.byte_ids(v, 0, True)) == [[32, 97, 98], [32, 97, 98], []]


def test_names(spark):
    assert mapped(spark, ["de", "xx"], lambda v: enums.renamed(v, enums.LANGUAGE_CODES)) == ["deu", "xx"]
    assert mapped(spark, ["large", "xl", "small"], lambda v: enums.renamed(v, enums.SIZE_NAMES)) == ["medium", "large", "small"]
    assert mapped(spark, ["+--+--+--+", ""], lambda v: prosody.versification(prosody.stresses(v), parts=1)) == ["dactylic", "other"]


def test_emotion_texts(spark):
    df = spark.createDataFrame([(["Sadness", "Humor"], ["one = two", "three"])], "e array<string>, v array<string>")
    p = tokens.emotion_prompt(F.col("e"))
    row = df.select(tokens.training_text(p, F.col("v")).alias("x"), tokens.training_pair(p, F.col("v")).alias("y")).select("x", "y.*", tokens.leading_emotions(F.col("x")).alias("back")).first()
    assert row["x"] == "<s><extra_id_3><extra_id_4>one two\nthree</s>"
    assert (row["inputs"], row["labels"], row["back"]) == ("<extra_id_3><extra_id_4>", "one two\nthree</s>", ["Humor", "Sadness"])


def test_blocks(spark):
    assert mapped(spark, ["abcde", "ab", ""], lambda v: tokens.blocks(tokens.byte_ids(v, 0), 2)) == [[[97, 98], [99, 100]], [[97, 98]], []]


def test_cuts(spark):
    assert mapped(spark, ["a|b|c", "a|bc", "|b|c", "", "x"], lambda v: text.cut_after_second(v, "|")) == ["a", "a", "|b", "", ""]
    assert mapped(spark, ["a</s>b</s>c", "</s>ab</s>c", "</s>ab"], lambda v: text.cut_after_second(v, "</s>")) == ["a</s>b", "</s>ab", "</s>a"]


def test_classifier_input(spark):
    one = spark.createDataFrame([("ab = c !", ["Humor"])], "x string, l array<string>")
    got = one.select(tokens.classifier_input(F.col("x"), F.col("l"), most=5).alias("y")).select("y.*").first()
    assert got["input_ids"] == [0, 101, 102, 36, 1]
    assert got["labels"] == [float(e == "Humor") for e in enums.EMOTIONS]


def test_multilabel(spark):
    df = spark.createDataFrame([(["a"], ["a", "b"]), (["b"], ["b"]), ([], ["a"]), (["c"], None)], "l array<string>, p array<string>")
    got = metrics.multilabel_prf(df, "l", "p", ["a", "b", "c"]).first()
    assert tuple(round(v, 6) for v in got) == (round((1 / 2 + 1 / 2 + 0) / 3, 6), round(2 / 3, 6), round((2 / 3 + 2 / 3) / 3, 6), 0.25)


def test_perplexity_counts_rows(spark):
    df = spark.createDataFrame([("aa",), ("aa",), ("ab",), ("",)], "text string")
    import math

    p = {"a": 5 / 6, "b": 1 / 6}
    want = (2 * math.exp(-math.log(p["a"])) + math.exp(-(math.log(p["a"]) + math.log(p["b"])) / 2)) / 3
    assert abs(metrics.byte_perplexity(df).first()[0] - want) < 1e-9


def test_candidates_lose_no_match(spark):
    import difflib
    import random

    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("ab") for _ in range(n))
    g, t = [(i, "s", word(rng.randrange(1, 60))) for i in range(60)], [("s", word(rng.randrange(1, 60))) for _ in range(60)]
    found = metrics.memorization_candidates(spark.createDataFrame(g, "id int, style string, text string"), spark.createDataFrame(t, "style string, text string"), ["style"])
    got = {(r["id"], r["known"]) for r in found.collect()}
    assert got >= {(i, k) for i, _, x in g for _, k in t if difflib.SequenceMatcher(None, k, x).ratio() >= 0.7}
    with pytest.raises(Exception, match="no training text"):
        metrics.memorization_metric(spark.createDataFrame([(1, "z", "x")], "id int, style string, text string"), spark.createDataFrame(t, "style string, text string"), ["style"]).collect()


def test_harmonic_mean(spark):
    row = spark.range(1).select(*[F.round(prosody.harmonic_mean(F.array(*map(F.lit, v))), 6).alias(n) for n, v in {"a": [0.9, 0.5, 0.8, 0.7], "b": [0.9, 0.0], "c": [0.9, 0.8, 0.6, 0.7, 0.5, 0.9]}.items()]).first()
    assert tuple(row) == (0.690884, 0.0, 0.700324)


@pytest.mark.parametrize(("content", "expected"), [("a\n b \n\nc\n\n\nd\n", ["a\nb", "c", ""]), ("a\n\n", ["a"]), ("\n\n", ["", ""]), ("", [])])
def test_documents(spark, content, expected):
    df = spark.createDataFrame([("/f", content)], "path string, content string")
    assert [r["text"] for r in readers.documents(df).orderBy("id").collect()] == expected


def test_documents_of_split_files(spark, tmp_path):
    """Documents that cross the splits of one file come out whole."""
    docs = ["\n".join(f"line {i} {j} " + "x" * (i % 90) for j in range(i % 7)) for i in range(400)]
    (tmp_path / "a.txt").write_text("".join(d + ("\n\n" if d else "\n") for d in docs) + "lost")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        assert readers.lines(spark, str(tmp_path)).select("block").distinct().count() > 5
        got = [r["text"] for r in readers.load(spark, "documents", str(tmp_path)).orderBy("id").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == ["\n".join(x.strip() for x in d.split("\n")) if d else "" for d in docs]


def test_labelled_folders(spark, tmp_path):
    for name, file in (("wild", "wild"), ("epg64", "epg"), ("chicago", "chicago")):
        (tmp_path / name).mkdir()
        (tmp_path / name / f"{name}.txt").write_text(FILES[file], "latin-1" if name == "chicago" else "utf-8")
    folders = {n: str(tmp_path / n) for n in ("wild", "epg64")}
    assert {r["source"] for r in readers.labelled_folders(spark, folders, "meter").collect()} == {"wild", "epg64"}
    pairs = readers.labelled_folders(spark, {**folders, "chicago": str(tmp_path / "chicago")}, "rhyme")
    assert {(r["source"], r["label"]): r["n"] for r in pairs.groupBy("source", "label").agg(F.count("*").alias("n")).collect()} == {("wild", "rhyme"): 1, ("epg64", "rhyme"): 1, ("chicago", "rhyme"): 2, ("chicago", "dissonance"): 2}
    with pytest.raises(ValueError, match="no meter source"):
        readers.labelled({"grc": None}, "meter")


def test_files_and_sinks(spark, tmp_path):
    from strophe.sources import archives, sinks

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text(FILES["chicago"], "latin-1")
    assert readers.load(spark, "chicago", str(tmp_path / "in"), pattern="*.txt").count() == 2
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), (None, "x", 3)], "k string, l string, n int")
    assert sinks.nested(df, ["k", "l"], "n") == {"a": {"x": 1, "y": 2}, "all": {"x": 3}}
    sinks.write_json_lines(df, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 3
    import zipfile

    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("p.json", "{}")
    raw = (tmp_path / "z.zip").read_bytes()
    (tmp_path / "z.z01").write_bytes(raw[:20])
    (tmp_path / "z.z02").write_bytes(raw[20:])
    parts = spark.read.format("binaryFile").load(f"{tmp_path}/z.*").withColumn("path", F.regexp_replace("path", r"\.z(\d+)$", ".$1"))
    assert [(r["name"], bytes(r["content"])) for r in archives.members(archives.parts_of(parts)).collect()] == [("p.json", b"{}")]


def test_stream_equals_batch(spark, tmp_path):
    from strophe.streaming import quatrains

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    s = quatrains.counts_by_language(quatrains.stream(spark, str(tmp_path / "in"), docs.schema, 1))
    q = s.writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, quatrains.counts_by_language(docs).collect()))


def test_batches():
    assert splits.least_samples(1000, 512, 200) == 512_200
    assert splits.local_batch(512, 4, 2) == 64
    with pytest.raises(ValueError, match="512"):
        splits.local_batch(512, 3)


def test_memorization(spark):
    g = spark.createDataFrame([(1, "a", "the same text here"), (2, "a", "something else entirely")], "id int, style string, text string")
    t = spark.createDataFrame([("a", "the same text herf"), ("b", "something else entirely")], "style string, text string")
    assert metrics.memorization_metric(g, t, ["style"]).first()[0] == 0.5
