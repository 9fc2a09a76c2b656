"""Readers over small invented files, one of each format. The twins list the rows that the files must give, written by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from strophe.sources import readers

TEI = '<TEI xmlns="http://www.tei-c.org/ns/1.0"><title>T</title><body>{}</body></TEI>'
LINES = '<l met="-+|-+|-+|-+"{0}>A line that tells of night</l><l met="-+-+-+-+">Another gives it light</l>'
FILES = {
    "documents": "first line\n second \n\nthird\n\n\nlost\n",
    "emotions": "line_text\temotion1anno1\temotion1anno2\temotion2anno1\temotion2anno2\nein kurzer Vers\tSadness\tNONE\tBeauty / Joy\tSadness\n",
    "emotions_plain": "no header here\nit ’ s late , my friend\tSadness---Humor\tVitality\n",
    "epg": TEI.format(f'<lg type="poem"><lg type="stanza" rhyme="aa">{LINES.format("")}</lg></lg>'),
    "fbfv": TEI.format('<lg type="quatrain" rhyme="aa"><l met="-+-+"><seg>One\n   two</seg><seg> three</seg></l><l met="+-+-"><seg>four five free</seg></l></lg>'),
    "grc": TEI.format('<div><lg type="poem"><lg type="stanza" rhyme="aba"><l>Ein <hi>helles</hi> Licht</l><l>ein dunkler Tag</l><l>er sieht mich nicht</l></lg><lg type="stanza" rhyme="aa"><l>so</l><l>nicht gut</l></lg></lg></div>'),
    "chicago": "AUTHOR A\nTITLE T\nRHYME a a b b *\nRHYME-POEM x\nverse one\nverse two\nverse three\nverse four\nverse five\n\nRHYME a b\nlast one\nlast two\n",
    "prosodic": "PoemID\tline_num\tline\tMeter Scheme\np1\t(3, 0)\ta line of verse\tiambic\n",
    "wild": "stanza_id\tline_text\ttotal_lines_in_stanza\trhyme_schema\ts_measure\n1\tein kurzer Vers\t2\taa\tiambic\n1\tein langer Fers\t2\taa\ttrochaic\n2\tallein\t1\ta\tsingle\n",
    "poems": '{"p1": {"poem": {"1": {"1": {"text": "first line of verse"}, "2": {"text": "second line of verse"}}}}}',
    "pronunciations": '{"en_US": [{"hello": "/həˈloʊ/", "empty": ""}, {"hello": "/x/"}]}',
}


def _one(name, f):
    return lambda spark, _: f(spark.createDataFrame([(f"/{name}", FILES[name])], "path string, content string"))


def _pronounced(df):
    words = df.sparkSession.createDataFrame([("Hello",), ("empty",), ("zebra",)], "word string")
    return readers.pronounced(words, readers.pronunciations(df, "en_US"))


def _sentences(df):
    from strophe.operators.phonemes import sentence_alliteration

    verses = df.sparkSession.createDataFrame([(1, "Hello, hello world"), (2, "...")], "id int, verse string")
    return sentence_alliteration(verses, ["id"], "verse", readers.pronunciations(df, "en_US"))


def _labelled(kind, names):
    """The labelled corpus from the files of some sources."""
    file = {"epg64": "epg"}
    return lambda spark, _: readers.labelled({n: spark.createDataFrame([(f"/{n}", FILES[file.get(n, n)])], "path string, content string") for n in names}, kind)


PAIR = ["v1", "v2", "label", "language", "source"]


def queries():
    one = lambda source, kind: (lambda spark, d: _one({"epg64": "epg"}.get(source, source), readers.LABELLED[kind][source])(spark, d))
    return {
        "doc_reader": lambda spark, d: _one("documents", readers.documents)(spark, d).select("path", "id", "text"),
        "emotion_reader": lambda spark, d: _joined(_one("emotions", readers.emotions)(spark, d)),
        "emotion_reader_plain": lambda spark, d: _joined(_one("emotions_plain", readers.emotions)(spark, d)),
        "tei_reader_epg": one("epg64", "rhyme"),
        "tei_reader_epg_meters": one("epg64", "meter"),
        "tei_reader_fbfv": one("fbfv", "rhyme"),
        "tei_reader_grc": one("grc", "rhyme"),
        "tagged_reader_chicago": one("chicago", "rhyme"),
        "tsv_reader_prosodic": one("prosodic", "meter"),
        "tsv_reader_wild_meters": one("wild", "meter"),
        "tsv_reader_wild_pairs": one("wild", "rhyme"),
        "poem_json_reader": lambda spark, d: _one("poems", readers.poems)(spark, d).select("path", "poem", "stanza", F.array_join("texts", "|").alias("texts")),
        "ipa_dictionary": _one("pronunciations", _pronounced),
        "sentence_phones": lambda spark, d: _one("pronunciations", _sentences)(spark, d).select("id", "verse", F.array_join("ipa", "|").alias("ipa"), F.round("score", 6).alias("score")),
        "corpus_union": lambda spark, d: _labelled("meter", readers.METER_SOURCES)(spark, d).select("text", "labels", "original", "language", "source"),
        "corpus_union_pairs": lambda spark, d: _labelled("rhyme", readers.RHYME_SOURCES)(spark, d).select(*PAIR),
    }


def _joined(df):
    return df.select("text", F.array_join("labels", "|").alias("labels"), "language")


def _rows(columns, *rows):
    """SELECT … FROM VALUES with literal rows."""
    value = lambda v: "NULL" if v is None else repr(v) if isinstance(v, int | float) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(value, r)) + ')' for r in rows)}) t({', '.join(columns)})"


METER = ["text", "labels", "original", "language", "source"]
NIGHT, LIGHT = "A line that tells of night", "Another gives it light"
EPG = [(NIGHT, "iambus", "iambus", "en", "epg64"), (LIGHT, "iambus", "iambus", "en", "epg64")]
FBFV = [("One two three", "iambus", "iambus", "en", "fbfv"), ("four five free", "trochee", "trochee", "en", "fbfv")]
PROSODIC = [("a line of verse", "iambus", "iambus", "en", "prosodic")]
WILD = [("ein kurzer Vers", "iambus", "iambus", "de", "wild"), ("ein langer Fers", "trochee", "trochee", "de", "wild")]
#: Dissonances of which as many stay as there are rhymes, those of least md5; rhymes all stay.
GRC = [("Ein helles Licht", "er sieht mich nicht", "rhyme"), ("Ein helles Licht", "ein dunkler Tag", "dissonance"), ("ein dunkler Tag", "er sieht mich nicht", "dissonance")]
FIVE = ["verse one", "verse two", "verse three", "verse four", "verse five"]
CHICAGO = [(*sorted((a, b)), "rhyme" if {a, b} in ({"verse one", "verse two"}, {"verse three", "verse four"}) else "dissonance") for i, a in enumerate(FIVE) for b in FIVE[:i]]
CHICAGO.append(("last one", "last two", "dissonance"))


def _balanced(rows, language, source):
    return f"""SELECT v1, v2, label, '{language}' AS language, '{source}' AS source FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(v1 || '|' || v2)) AS r, count(*) FILTER (label = 'rhyme') OVER () AS n
FROM ({_rows(PAIR[:3], *rows)})) WHERE label = 'rhyme' OR r <= n"""


def oracle_sql():
    pairs = {
        "tei_reader_epg": _rows(PAIR, (NIGHT, LIGHT, "rhyme", "en", "epg64")),
        "tagged_reader_chicago": _balanced(CHICAGO, "en", "chicago"),
        "tei_reader_fbfv": _rows(PAIR, ("One two three", "four five free", "rhyme", "en", "fbfv")),
        "tsv_reader_wild_pairs": _rows(PAIR, ("ein kurzer Vers", "ein langer Fers", "rhyme", "de", "wild")),
        "tei_reader_grc": _balanced(GRC, "de", "grc"),
    }
    return pairs | {
        "doc_reader": _rows(["path", "id", "text"], ("/documents", 0, "first line\nsecond"), ("/documents", 1, "third"), ("/documents", 2, "")),
        "emotion_reader": _rows(["text", "labels", "language"], ("ein kurzer Vers", "Beauty/Joy|Sadness", "all")),
        "emotion_reader_plain": _rows(["text", "labels", "language"], ("it' s late, my friend", "Humor|Sadness|Vitality", "all")),
        "tei_reader_epg_meters": _rows(METER, *EPG),
        "tsv_reader_prosodic": _rows(["id", *METER], ("prosodic-p1-3", *PROSODIC[0])),
        "tsv_reader_wild_meters": _rows(METER, *WILD),
        "poem_json_reader": _rows(["path", "poem", "stanza", "texts"], ("/poems", "p1", "1", "first line of verse|second line of verse")),
        "ipa_dictionary": _rows(["word", "ipa"], ("Hello", "/həˈloʊ/"), ("empty", "e"), ("zebra", "z")),
        # phones h l h l w: two equal pairs at distance 2, of 4/1 + 3/2 + 2/3 + 1/4 in all
        "sentence_phones": "SELECT * FROM (VALUES (1, 'Hello, hello world', '/həˈloʊ/|/həˈloʊ/|w', round((2 / 2.0::DOUBLE) / (4 + 3 / 2.0::DOUBLE + 2 / 3.0::DOUBLE + 1 / 4.0::DOUBLE), 6)), (2, '...', '', 0.0)) t(id, verse, ipa, score)",
        "corpus_union": _rows(METER, *EPG, *PROSODIC, *FBFV, *WILD),
        "corpus_union_pairs": " UNION ALL ".join(f"SELECT * FROM ({x})" for x in pairs.values()),
    }
