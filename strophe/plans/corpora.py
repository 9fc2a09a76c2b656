"""Reader queries: the documents as corpora in each format, read back. Files are derived by Spark, one for each document; the twins start from the documents' lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strophe.functions import enums, text
from strophe.functions.core import let
from strophe.operators.phonemes import sentence_alliteration
from strophe.sources import readers

TEI = ('<?xml version="1.0"?><TEI xmlns="http://www.tei-c.org/ns/1.0"><title>T</title><body>', "</body></TEI>")
SCHEME = "abab"
NAMES = [e.replace("/", " / ") for e in enums.EMOTIONS]


def documents(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").filter("text IS NOT NULL AND doc_id IS NOT NULL")


def verses(x: Column) -> Column:
    """The lines of a text with single spaces, of four characters or more."""
    line = lambda v: F.trim(F.regexp_replace(F.regexp_replace(v, r"[\x00-\x08\x0b\x0e-\x1f]", ""), r"\s+", " "))
    return F.filter(F.transform(F.split(x, "\n"), line), lambda v: F.length(v) >= 4)


def stanzas(v: Column) -> Column:
    """Four verses each, the last may have fewer."""
    return F.when(F.size(v) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / 4).cast("int")), lambda i: F.slice(v, i * 4 + 1, F.lit(4)))).otherwise(F.array().cast("array<array<string>>"))


def joined(parts: Column, f, sep: str = "") -> Column:
    return F.array_join(F.transform(parts, f), sep)


def odd(v: Column) -> Column:
    return F.length(v) % 2 == 1


def scheme(s: Column) -> Column:
    return F.substring(F.lit(SCHEME), F.lit(1), F.size(s))


def _tei(kind: str, line, poem: str = '<lg type="poem">', end: str = "</lg>"):
    stanza = lambda s: F.concat(F.lit(f'<lg type="{kind}" rhyme="'), scheme(s), F.lit('">'), joined(s, line), F.lit("</lg>"))
    return lambda v: F.concat(F.lit(TEI[0] + poem), let(stanzas(v), lambda s: joined(s, stanza)), F.lit(end + TEI[1]))


def _met(v: Column) -> Column:
    return F.concat(F.lit('<l met="'), F.when(odd(v), "+-+-+-+-").otherwise("-+|-+|-+|-+"), F.lit('">'))


def _epg_line(v):
    return F.concat(_met(v), text.html_escape(v), F.lit("</l>"))


def _fbfv_line(v):
    """Two segments, cut before the first space; runs of spaces and line ends are one space."""
    at = F.when(F.instr(v, " ") > 0, F.instr(v, " ")).otherwise(F.length(v) + 1)
    return F.concat(_met(v), F.lit("<seg>"), text.html_escape(F.substring(v, F.lit(1), at - 1)), F.lit("</seg><seg>"), F.replace(text.html_escape(F.substring(v, at, F.length(v))), F.lit(" "), F.lit(" \n ")), F.lit("</seg></l>"))


def _grc_line(v):
    return F.concat(F.lit("<l><hi>"), text.html_escape(F.substring(v, 1, 2)), F.lit("</hi>"), text.html_escape(F.substring(v, F.lit(3), F.length(v))), F.lit("</l>"))


def _chicago(v: Column) -> Column:
    one = lambda s: F.concat(F.lit("RHYME "), F.array_join(F.split(scheme(s), ""), " "), F.lit("\n"), F.array_join(s, "\n"), F.lit("\n\n"))
    return F.concat(F.lit("AUTHOR A\nTITLE T\n"), let(stanzas(v), lambda s: joined(s, one)))


def _foot(v: Column) -> Column:
    return F.when(odd(v), "trochaic").otherwise("iambic")


def _prosodic(v: Column) -> Column:
    rows = F.transform(v, lambda x, i: F.concat(F.concat_ws("\t", F.concat(F.lit("p"), "doc_id"), F.concat(F.lit("("), i, F.lit(", 0)")), x, _foot(x)), F.lit("\n")))
    return F.concat(F.lit("PoemID\tline_num\tline\tMeter Scheme\n"), F.array_join(rows, ""))


def _wild(v: Column) -> Column:
    """Every fifth stanza is of a single measure: no verse for rhymes, and none for meters."""
    line = lambda s, i: lambda x: F.concat(F.concat_ws("\t", i + 1, x, F.size(s), scheme(s), F.when(i % 5 == 4, "single").otherwise(_foot(x))), F.lit("\n"))
    return F.concat(F.lit("stanza_id\tline_text\ttotal_lines_in_stanza\trhyme_schema\ts_measure\n"), let(stanzas(v), lambda all_: F.array_join(F.transform(all_, lambda s, i: joined(s, line(s, i))), "")))


def _poems(v: Column) -> Column:
    line = lambda x, j: F.struct((j + 1).cast("string"), F.struct(x.alias("text")))
    stanza = lambda s, i: F.struct((i + 1).cast("string"), F.map_from_entries(F.transform(s, line)))
    return F.to_json(F.create_map(F.concat(F.lit("p"), F.col("doc_id")), F.struct(F.map_from_entries(F.transform(stanzas(v), stanza)).alias("poem"))))


def _emotion(k) -> Column:
    return F.element_at(F.array(*map(F.lit, NAMES)), (F.pmod(F.col("doc_id") + k, F.lit(8)) + 1).cast("int"))


def _emotions(v: Column) -> Column:
    row = lambda x, i: F.concat(F.concat_ws("\t", x, _emotion(i), F.lit("NONE"), _emotion(2 * i), _emotion(i)), F.lit("\n"))
    return F.concat(F.lit("line_text\temotion1anno1\temotion1anno2\temotion2anno1\temotion2anno2\n"), F.array_join(F.transform(v, row), ""))


def _emotions_plain(v: Column) -> Column:
    row = lambda x, i: F.concat(x, F.lit("\t"), _emotion(i), F.lit("---"), _emotion(2 * i), F.lit("\t"), _emotion(3 * i), F.lit("\n"))
    return F.concat(F.lit("no header\n"), F.array_join(F.transform(v, row), ""))


FORMATS = {
    "epg64": _tei("stanza", _epg_line), "fbfv": _tei("quatrain", _fbfv_line, "", ""), "grc": _tei("stanza", _grc_line, '<div><lg type="poem">', "</lg></div>"), "chicago": _chicago, "prosodic": _prosodic, "wild": _wild,
    "poems": _poems, "emotions": _emotions, "emotions_plain": _emotions_plain,
}


def corpus(spark, d, name: str, part: int | None = None) -> DataFrame:
    """path and content: each document as a file of a format, of all its verses or of every fifth from one on."""
    v = verses(F.col("text"))
    docs = documents(spark, d).select("doc_id", (v if part is None else F.filter(v, lambda _, i: i % 5 == part)).alias("v"))
    return docs.select(F.concat(F.lit("/"), "doc_id").alias("path"), FORMATS[name](F.col("v")).alias("content"))


def plain_files(spark, d) -> DataFrame:
    """Documents with a blank line for each full stop."""
    return documents(spark, d).select(F.concat(F.lit("/"), "doc_id").alias("path"), F.replace("text", F.lit(". "), F.lit("\n\n")).alias("content"))


def _words(x: Column) -> Column:
    return F.filter(text.tokens(x), lambda w: w.rlike(r"\p{L}"))


def dictionary(spark, d) -> DataFrame:
    """A file for each document: its words in lower case, of an even number of letters, each as its own pronunciation."""
    known = F.array_distinct(F.filter(_words(F.col("text")), lambda w: w.rlike(r"^\p{L}+$") & (F.lower(w) == w) & (F.length(w) % 2 == 0)))
    content = F.to_json(F.struct(F.array(F.map_from_entries(F.transform(known, lambda w: F.struct(w, F.concat(F.lit("/"), w, F.lit("/")))))).alias("en_US")))
    return readers.pronunciations(documents(spark, d).select(F.concat(F.lit("/"), "doc_id").alias("path"), content.alias("content")), "en_US")


PAIR = ["v1", "v2", "label", "language", "source"]
METER = ["text", "labels", "original", "language", "source"]


def _read(source, kind, columns):
    return lambda spark, d: readers.LABELLED[kind][source](corpus(spark, d, source)).select(*columns)


def _emotion_rows(name):
    def run(spark, d):
        found = readers.emotions(corpus(spark, d, name))
        return found.groupBy("text", F.array_join("labels", "|").alias("labels"), "language").agg(F.count("*").alias("n"))

    return run


def _poem_rows(spark, d):
    return readers.poems(corpus(spark, d, "poems")).select("path", "poem", "stanza", F.array_join("texts", "|").alias("texts"))


def _ipa(spark, d):
    words = documents(spark, d).select(F.explode(_words(F.col("text"))).alias("word")).distinct()
    return readers.pronounced(words, dictionary(spark, d))


def _sentence_phones(spark, d):
    sentences = documents(spark, d).select("doc_id", F.posexplode(F.split("text", r"[.\n]+")).alias("sentence", "verse"))
    found = sentence_alliteration(sentences, ["doc_id", "sentence"], "verse", dictionary(spark, d))
    return found.select("doc_id", "sentence", F.array_join("ipa", "|").alias("ipa"), F.round("score", 6).alias("score"))


def _union(kind, sources, columns):
    return lambda spark, d: readers.labelled({n: corpus(spark, d, n, i) for i, n in enumerate(sources)}, kind).select(*columns)


def queries():
    return {
        "doc_reader": lambda spark, d: readers.documents(plain_files(spark, d)).select("path", "id", "text"),
        "emotion_reader": _emotion_rows("emotions"),
        "emotion_reader_plain": _emotion_rows("emotions_plain"),
        "tei_reader_epg": _read("epg64", "rhyme", PAIR),
        "tei_reader_epg_meters": _read("epg64", "meter", METER),
        "tei_reader_fbfv": _read("fbfv", "rhyme", PAIR),
        "tei_reader_grc": _read("grc", "rhyme", PAIR),
        "tagged_reader_chicago": _read("chicago", "rhyme", PAIR),
        "tsv_reader_prosodic": _read("prosodic", "meter", ["id", *METER]),
        "tsv_reader_wild_meters": _read("wild", "meter", METER),
        "tsv_reader_wild_pairs": _read("wild", "rhyme", PAIR),
        "poem_json_reader": _poem_rows,
        "ipa_dictionary": _ipa,
        "sentence_phones": _sentence_phones,
        "corpus_union": _union("meter", readers.METER_SOURCES, METER),
        "corpus_union_pairs": _union("rhyme", readers.RHYME_SOURCES, PAIR),
    }


LINES = r"list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(regexp_replace(x, '[\x00-\x08\x0b\x0e-\x1f]', '', 'g'), '\s+', ' ', 'g'))), lambda x: length(x) >= 4)"
D = f"d AS (SELECT doc_id, text, {LINES} AS v FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL)"


def _lines(part: int | None = None) -> str:
    """k (document), pos and line, numbered anew within a part."""
    v = "v" if part is None else f"list_filter(v, lambda x, i: (i - 1) % 5 = {part})"
    return f"SELECT doc_id AS k, generate_subscripts({v}, 1) - 1 AS pos, unnest({v}) AS line FROM d"


def _meters(source: str, language: str, part: int | None = None, more: str = "", keep: str = "true") -> str:
    label = "CASE WHEN length(line) % 2 = 1 THEN 'trochee' ELSE 'iambus' END"
    return f"SELECT {more} line AS text, {label} AS labels, {label} AS original, '{language}' AS language, '{source}' AS source FROM ({_lines(part)}) WHERE {keep}"


def _pairs(source: str, language: str, part: int | None = None, scope: str = "0", keep: str = "true") -> str:
    """Pairs of lines of a stanza of four by places: an even distance rhymes. Each once in its scope, and as many dissonances as rhymes, those of least md5."""
    pairs = f"SELECT DISTINCT {scope} AS scope, least(a.line, b.line) AS v1, greatest(a.line, b.line) AS v2, CASE WHEN (a.pos - b.pos) % 2 = 0 THEN 'rhyme' ELSE 'dissonance' END AS label FROM ({_lines(part)}) a JOIN ({_lines(part)}) b ON a.k = b.k AND a.pos // 4 = b.pos // 4 AND a.pos > b.pos WHERE {keep}"
    ranked = f"SELECT *, row_number() OVER (PARTITION BY scope, label ORDER BY md5(v1 || '|' || v2), v1, v2) AS r, count(*) FILTER (label = 'rhyme') OVER (PARTITION BY scope) AS n FROM ({pairs})"
    return f"SELECT v1, v2, label, '{language}' AS language, '{source}' AS source FROM ({ranked}) WHERE label = 'rhyme' OR r <= n"


def _emotion_sql(picks: list[str], body: str) -> str:
    raw = "[" + ", ".join(f"'{e}'" for e in NAMES) + "]"
    labels = ", ".join(f"({raw})[(k + {p}) % 8 + 1]" for p in picks)
    return f"WITH {D}, e AS (SELECT {body} AS text, array_to_string(list_transform(list_sort(list_distinct([{labels}])), lambda x: replace(x, ' / ', '/')), '|') AS labels FROM ({_lines()})) SELECT text, labels, 'all' AS language, count(*) AS n FROM e GROUP BY text, labels"


def oracle_sql(normalized, detokenized, allit: str, tokens: str):
    """normalized: SQL of a corrected text; detokenized: of a repaired verse; allit: of the score of phones c; tokens: of a text's tokens."""
    of = lambda x: f"WITH {D} {x}"
    meters = {"epg64": ("en", "true"), "prosodic": ("en", "true"), "fbfv": ("en", "true"), "wild": ("de", "pos // 4 % 5 <> 4")}
    pairs = {"epg64": ("en", "0", "true"), "chicago": ("en", "a.k", "true"), "fbfv": ("en", "0", "true"), "wild": ("de", "0", "a.pos // 4 % 5 <> 4"), "grc": ("de", "0", "true")}
    one = lambda n, part=None: _pairs(n, pairs[n][0], part, pairs[n][1], pairs[n][2])
    all_meters = " UNION ALL ".join(f"SELECT *, {i} AS p FROM ({_meters(n, meters[n][0], i, keep=meters[n][1])})" for i, n in enumerate(readers.METER_SOURCES))
    all_pairs = " UNION ALL ".join(f"SELECT *, {i} AS p FROM ({one(n, i)})" for i, n in enumerate(readers.RHYME_SOURCES))
    words = f"list_filter({tokens}, lambda w: regexp_matches(w, '\\p{{L}}'))"
    known = f"w AS (SELECT DISTINCT unnest({words}) AS word FROM d), known AS (SELECT word FROM w WHERE regexp_matches(word, '^\\p{{L}}+$') AND lower(word) = word AND length(word) % 2 = 0)"
    ipa = "coalesce('/' || a.word || '/', '/' || b.word || '/', {w}[1:1])"
    found = "LEFT JOIN known a ON a.word = {w} LEFT JOIN known b ON b.word = lower({w})"
    return {
        "doc_reader": """WITH d AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(replace(text, '. ', chr(10) || chr(10)), '\\r\\n?', chr(10), 'g'), '\\n$', ''), chr(10)) AS v FROM documents WHERE doc_id IS NOT NULL AND text <> ''),
l AS (SELECT doc_id, generate_subscripts(v, 1) AS pos, regexp_replace(unnest(v), '^\\s+|\\s+$', '', 'g') AS line FROM d),
n AS (SELECT *, count(*) FILTER (line = '') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS id FROM l)
SELECT '/' || doc_id AS path, id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (line <> ''), '') AS text FROM n GROUP BY doc_id, id HAVING count(*) FILTER (line = '') > 0""",
        "emotion_reader": _emotion_sql(["pos", "2 * pos"], "line"),
        "emotion_reader_plain": _emotion_sql(["pos", "2 * pos", "3 * pos"], detokenized("line")),
        "tei_reader_epg": of(one("epg64")),
        "tei_reader_epg_meters": of(_meters("epg64", "en")),
        "tei_reader_fbfv": of(one("fbfv")),
        "tei_reader_grc": of(one("grc")),
        "tagged_reader_chicago": of(one("chicago")),
        "tsv_reader_prosodic": of(_meters("prosodic", "en", None, "'prosodic-p' || k || '-' || pos AS id,")),
        "tsv_reader_wild_meters": of(_meters("wild", "de", None, "", meters["wild"][1])),
        "tsv_reader_wild_pairs": of(one("wild")),
        "poem_json_reader": of(f"SELECT '/' || k AS path, 'p' || k AS poem, CAST(pos // 4 + 1 AS VARCHAR) AS stanza, string_agg(line, '|' ORDER BY pos) AS texts FROM ({_lines()}) GROUP BY k, pos // 4"),
        "ipa_dictionary": of(f", {known} SELECT w.word, {ipa.format(w='w.word')} AS ipa FROM w {found.format(w='w.word')}"),
        "sentence_phones": of(f""", {known}, s AS (SELECT doc_id, generate_subscripts(x, 1) - 1 AS pos, unnest(x) AS verse FROM (SELECT doc_id, string_split(regexp_replace(text, '[.\\n]+', chr(10), 'g'), chr(10)) AS x FROM d)),
t AS (SELECT doc_id, pos, generate_subscripts(y, 1) AS j, unnest(y) AS word FROM (SELECT doc_id, pos, {words.replace('text', 'verse')} AS y FROM s)),
i AS (SELECT doc_id, pos, list({ipa.format(w='t.word')} ORDER BY j) AS ipa FROM t {found.format(w='t.word')} GROUP BY doc_id, pos),
c AS (SELECT *, list_filter(list_transform(ipa, lambda x: regexp_extract(replace(x, '/', ''), '^\\p{{L}}')), lambda x: x <> '') AS c FROM i)
SELECT s.doc_id, CAST(s.pos AS INT) AS sentence, coalesce(array_to_string(ipa, '|'), '') AS ipa, coalesce(round({allit}, 6), 0) AS score FROM s LEFT JOIN c USING (doc_id, pos)"""),
        "corpus_union": of(f", u AS ({all_meters}) SELECT text, arg_min(labels, p) AS labels, arg_min(original, p) AS original, arg_min(language, p) AS language, arg_min(source, p) AS source FROM (SELECT * REPLACE ({normalized('text')} AS text) FROM u) GROUP BY text"),
        "corpus_union_pairs": of(f""", u AS ({all_pairs}) SELECT v1, v2, first(label ORDER BY p, o) AS label, first(language ORDER BY p, o) AS language, first(source ORDER BY p, o) AS source
FROM (SELECT *, md5(CAST(to_json({{'v1': v1, 'v2': v2, 'label': label, 'language': language, 'source': source}}) AS VARCHAR)) AS o FROM (SELECT * REPLACE ({normalized('v1')} AS v1, {normalized('v2')} AS v2) FROM u)) GROUP BY v1, v2"""),
    }
