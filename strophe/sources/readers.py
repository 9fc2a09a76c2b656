"""Corpus readers: files of each format to verses, verse pairs, quatrains and documents.

``files`` reads whole files (path, content), ``lines`` reads them line by line, whatever their size; readers take such DataFrames, so files
may be in any store that Spark reads. Line formats with state from line to line are running counts over numbered lines (``load`` reads blank-line
documents by ``lines``, the others as whole files); XML and JSON files are parsed one by one in mapInPandas. All later steps are DataFrame operations.
"""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strophe.functions.enums import EMOTIONS
from strophe.functions.prosody import foot_and_metre, meter_label, repeated_scheme, stresses, versification
from strophe.functions.text import emotion_detokenize, normalize_characters, strip
from strophe.operators.pairs import balanced, balanced_within, keep_first, rhyme_pairs
from strophe.operators.scratch import Scratch

TEI = "http://www.tei-c.org/ns/1.0"
N = f"{{{TEI}}}"
#: Sources of each corpus configuration, in priority order, and a file with known errors.
METER_SOURCES = ["epg64", "prosodic", "fbfv", "wild"]
RHYME_SOURCES = ["epg64", "chicago", "fbfv", "wild", "grc"]
EXCLUDED = "EdwardEstlinCummings_1894"


def files(spark: SparkSession, path: str, pattern: str = "*", encoding: str = "UTF-8") -> DataFrame:
    """path and content of each file below a folder."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return raw.select("path", F.decode("content", encoding).alias("content"))


def per_file(df: DataFrame, parse: Callable[[str], Iterator[tuple]], schema: str, chars: int = 1_000_000) -> DataFrame:
    """path and what parse yields for each file's content. Rows leave a task after about ``chars`` characters, so that they do not add up over the 10,000 files of a batch."""
    names = [x.split()[0] for x in re.split(r", (?![^<]*>)", schema)]

    def run(parts):
        for part in parts:
            rows, size = [], 0
            for p, c in zip(part["path"], part["content"], strict=True):
                if c is not None:
                    rows += [(p, *row) for row in parse(c)]
                    size += len(c)
                if size >= chars:
                    yield pd.DataFrame(rows, columns=["path", *names])
                    rows, size = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=["path", *names])

    return df.select("path", "content").mapInPandas(run, f"path string, {schema}")


def lines(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, block, pos and line of each UTF-8 line below a folder. Files are split, so one may be of any size; (block, pos) is the order within a file."""
    raw = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(path)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("pos"), F.col("value").alias("line"))


def numbered(df: DataFrame) -> DataFrame:
    """The same of whole files: a last line end begins no line."""
    content = F.regexp_replace(F.regexp_replace("content", "\r\n?", "\n"), r"\n\z", "")
    return df.filter("content <> ''").select("path", F.lit(0).cast("long").alias("block"), F.posexplode(F.split(content, "\n")).alias("pos", "line"))


def documents(df: DataFrame) -> DataFrame:
    """path, id, text: stripped lines up to each blank line. What follows the last blank line is no document; further blank lines make empty ones.

    Takes whole files or lines. Blank lines are counted within each block, and blocks add what stands before them, so no task holds a whole file.
    """
    df = (df if "line" in df.columns else numbered(df)).withColumn("line", strip(F.col("line"))).withColumn("blank", (F.col("line") == "").cast("long"))
    ends = df.groupBy("path", "block").agg(F.sum("blank").alias("n"))
    ends = ends.select("path", "block", F.coalesce(F.sum("n").over(W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum("blank").over(W.partitionBy("path", "block").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = df.withColumn("inside", inside).join(ends, ["path", "block"]).withColumn("id", F.col("before") + F.col("inside"))
    held = F.sort_array(F.collect_list(F.when(F.col("blank") == 0, F.struct("block", "pos", "line"))))
    whole = rows.groupBy("path", "id").agg(held.alias("l"), F.max("blank").alias("ended")).filter("ended = 1")
    return whole.select("path", "id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))


def rows_by_tab(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """path, pos and the fields of tab-separated lines, by the header or by given names."""
    lines = df.select("path", F.posexplode(F.split(F.regexp_replace("content", "\r", ""), "\n")).alias("pos", "line")).filter("line <> ''")
    if names:
        return lines.select("path", "pos", *[F.get(F.split("line", "\t"), i).alias(n) for i, n in enumerate(names)])
    heads = df.select("path", F.split(F.regexp_extract("content", r"^([^\r\n]*)", 1), "\t").alias("head"))
    fields = F.map_from_arrays("head", F.transform("head", lambda _, i: F.get(F.split("line", "\t"), i)))
    return lines.filter("pos > 0").join(heads, "path").select("path", "pos", fields.alias("f"))


def emotions(df: DataFrame, language: str = "all") -> DataFrame:
    """text, labels, language of both kinds of emotion files: with a tab in the first line it is a header, else each line is a verse and labels."""
    headed = F.regexp_extract("content", r"^([^\n]*)", 1).contains("\t")
    f = lambda n: F.element_at("f", n)
    with_header = rows_by_tab(df.filter(headed)).select(strip(f("line_text")).alias("text"), F.array(*[f(f"emotion{x}anno{y}") for x in (1, 2) for y in (1, 2)]).alias("labels"))
    lines = df.filter(~headed).select(F.posexplode(F.split("content", "\n")).alias("pos", "line")).filter("pos > 0").filter(strip(F.col("line")).contains("\t"))
    labels = F.transform(F.flatten(F.transform(F.slice(F.split("line", "\t"), F.lit(2), F.size(F.split("line", "\t"))), lambda x: F.split(x, "---"))), strip)
    without = lines.select(emotion_detokenize(F.get(F.split("line", "\t"), 0)).alias("text"), labels.alias("labels"))
    one = F.transform(F.array_sort(F.array_distinct(F.filter("labels", lambda x: x.isNotNull() & (x != "NONE")))), lambda x: F.replace(x, F.lit(" / "), F.lit("/")))
    kept = F.filter(one, lambda x: x.isin(EMOTIONS))
    return with_header.unionByName(without).select("text", F.when(F.size(kept) > 0, kept).otherwise(F.raise_error(F.lit("a verse without a known emotion")).cast("array<string>")).alias("labels"), F.lit(language).alias("language"))


STANZA = "poem int, stanza int, rhyme string, texts array<string>, mets array<string>"


def _tei(content: str):
    if TEI not in content:
        return None
    return ET.fromstring(re.sub(r"^(\s*<\?xml[^>]*?)\s+encoding\s*=\s*(\"[^\"]*\"|'[^']*')", r"\1", content))  # it is decoded by now


def epg(df: DataFrame) -> DataFrame:
    """Stanzas of the English annotated corpus: a line's text before its first child."""

    def parse(content):
        if (root := _tei(content)) is None:
            return
        n = 0
        for poem in root.iterfind(f".//{N}body/{N}lg"):
            if poem.get("type") not in ("poem", "part"):
                raise ValueError("unexpected type of poem")
            for stanza in poem.iterfind(f"{N}lg"):
                if stanza.get("type") != "stanza":
                    raise ValueError("unexpected type of stanza")
                lines = stanza.findall(f"{N}l")
                yield 0, n, stanza.get("rhyme"), [x.text for x in lines], [x.get("met") for x in lines]
                n += 1

    return per_file(df.filter(~F.col("path").contains(f"/{EXCLUDED}.xml")), parse, STANZA)


def fbfv(df: DataFrame) -> DataFrame:
    """Stanzas of any line group; a line is its segments' texts, with runs of spaces and newlines as one space."""

    def parse(content):
        if (root := _tei(content)) is None:
            return
        for n, group in enumerate(root.iter(f"{N}lg")):
            lines = group.findall(f"{N}l")
            yield 0, n + 1, group.get("rhyme"), ["".join(re.sub(r"[\n ]+", " ", "".join(s.itertext())) for s in x.iterfind(f"{N}seg")) for x in lines], [x.get("met") for x in lines]

    return per_file(df, parse, STANZA)


def grc(df: DataFrame) -> DataFrame:
    """Stanzas of the German corpus with all inner text; one with an empty line goes."""

    def parse(content):
        if (root := _tei(content)) is None:
            return
        n = 0
        for poem in root.iterfind(f".//{N}body/{N}div/{N}lg"):
            if poem.get("type") not in ("poem", "part"):
                raise ValueError("unexpected type of poem")
            for stanza in poem.iterfind(f"{N}lg"):
                texts = ["".join(x.itertext()) for x in stanza.iterfind(f"{N}l")]
                if stanza.get("type") == "stanza" and all(texts):
                    yield 0, n, stanza.get("rhyme"), texts, [None] * len(texts)
                    n += 1

    return per_file(df, parse, STANZA)


def chicago(df: DataFrame) -> DataFrame:
    """path, stanza, rhyme, texts of files with RHYME headers; a starred scheme is repeated over the verses.

    AUTHOR, TITLE and RHYME lines open sections (a RHYME-POEM line right after a scheme belongs to it). The verses of a section with a scheme
    are its first run of lines that aren't blank: the running number of lines and of gaps behind them tells which.
    """
    scheme = F.regexp_extract("line", r"(?U)^RHYME((?:\s\w)+(?:\s\*)?)", 1)
    order = W.partitionBy("path").orderBy("block", "pos")
    rows = (df if "line" in df.columns else numbered(df)).withColumn("line", strip(F.col("line"))).withColumn("scheme", scheme)
    rows = rows.withColumn("above", F.lag("scheme", 1, "").over(order)).filter("NOT (startswith(line, 'RHYME-POEM') AND above <> '')")
    opens = F.col("line").rlike("^(?:AUTHOR|TITLE|RHYME)")
    rows = rows.withColumn("opens", opens).withColumn("stanza", F.sum(opens.cast("int")).over(order).cast("int"))
    body = W.partitionBy("path", "stanza").orderBy("block", "pos")
    full = (F.col("line") != "") & ~F.col("opens")
    rows = rows.withColumn("full", full).withColumn("seen", F.sum(full.cast("int")).over(body))
    rows = rows.withColumn("gaps", F.sum(((F.col("line") == "") & (F.col("seen") > 0)).cast("int")).over(body))
    verse = F.when(F.col("full") & (F.col("gaps") == 0), F.struct("block", "pos", "line"))
    raw = rows.groupBy("path", "stanza").agg(F.max(F.when(F.col("opens"), F.col("scheme"))).alias("scheme"), F.sort_array(F.collect_list(verse)).alias("l"))
    raw = raw.filter("scheme <> '' AND size(l) > 0").select("path", "stanza", F.split(strip(F.col("scheme")), r"(?U)\s+").alias("letters"), F.transform("l", lambda x: x["line"]).alias("texts"))
    base = F.filter("letters", lambda x: x != "*")
    return raw.select("path", "stanza", F.when(F.array_contains("letters", "*"), repeated_scheme(base, F.size("texts"))).otherwise(F.array_join("letters", "")).alias("rhyme"), "texts")


def fit_scheme(df: DataFrame, drop_short_first: bool) -> DataFrame:
    """Stanzas of two lines or more whose scheme is long enough, cut to their lines; a first line of three characters or fewer may go before."""
    df = df.filter("rhyme <> '' AND size(texts) > 1")
    if drop_short_first:
        df = df.withColumn("texts", F.when(F.length(F.get("texts", 0)) <= 3, F.slice("texts", F.lit(2), F.size("texts"))).otherwise(F.col("texts")))
    else:
        df = df.filter(~F.exists("texts", lambda x: F.contains(strip(x), F.lit("\n")) | (F.length(x) <= 3)))
    return df.filter(F.size("texts") <= F.length("rhyme")).withColumn("rhyme", F.substring("rhyme", F.lit(1), F.size("texts")))


def pair_corpus(stanzas: DataFrame, source: str, language: str, scope: list[str] | None = None) -> DataFrame:
    """v1, v2, label, language, source: each pair of texts once by label, dissonances balanced within the scope (columns of a file, or the whole corpus)."""
    pairs = rhyme_pairs(stanzas, F.transform("texts", strip), F.col("rhyme"))
    chosen = balanced_within(pairs, scope) if scope else balanced(pairs.withColumn("_all", F.lit(0)), ["_all"])
    return chosen.select("v1", "v2", "label", F.lit(language).alias("language"), F.lit(source).alias("source"))


def wild_stanzas(df: DataFrame) -> DataFrame:
    """Stanzas of the annotated German lines: those whose scheme has a letter for each line, and none of meter single."""
    f = lambda n: F.element_at("f", n)
    rows = rows_by_tab(df).select("path", "pos", f("stanza_id").cast("int").alias("stanza"), strip(f("line_text")).alias("text"), f("total_lines_in_stanza").cast("int").alias("total"), f("rhyme_schema").alias("rhyme"), f("s_measure").alias("measure"))
    one = rows.groupBy("path", "stanza").agg(F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("l"), F.min("rhyme").alias("rhyme"), F.max("rhyme").alias("r2"), F.min("total").alias("total"), F.max("total").alias("t2"), F.count_if(F.col("measure") == "single").alias("single"), F.count("*").alias("n"))
    good = one.filter(F.expr("assert_true(rhyme = r2 AND total = n AND t2 = n, 'a stanza contradicts itself') IS NULL"))
    return good.filter((F.col("single") == 0) & (F.length("rhyme") == F.col("n"))).select("path", "stanza", "rhyme", F.transform("l", lambda x: x["text"]).alias("texts"))


def wild_meters(df: DataFrame) -> DataFrame:
    f = lambda n: F.element_at("f", n)
    return meters(rows_by_tab(df).filter(~f("s_measure").isin("unknown", "single")).select(strip(f("line_text")).alias("text"), f("s_measure").alias("foot")), "wild", "de")


def prosodic(df: DataFrame) -> DataFrame:
    f = lambda n: F.element_at("f", n)
    rows = rows_by_tab(df).select(F.concat_ws("-", F.lit("prosodic"), f("PoemID"), F.regexp_extract(f("line_num"), r"\d+", 0)).alias("id"), strip(f("line")).alias("text"), f("Meter Scheme").alias("foot"))
    return meters(rows, "prosodic", "en")


def meters(rows: DataFrame, source: str, language: str) -> DataFrame:
    """text, labels, original, language, source of verses with a foot."""
    return rows.select(*[c for c in rows.columns if c == "id"], "text", meter_label(F.col("foot")).alias("labels"), meter_label(F.col("foot"), False).alias("original"), F.lit(language).alias("language"), F.lit(source).alias("source"))


def stanza_meters(stanzas: DataFrame, source: str) -> DataFrame:
    """Verses of TEI stanzas with the foot of their metrical pattern; verses without one go."""
    lines = stanzas.select(F.explode(F.arrays_zip("texts", "mets")).alias("x")).select(strip(F.col("x.texts")).alias("text"), F.col("x.mets").alias("met")).filter("met IS NOT NULL")
    return meters(lines.select("text", foot_and_metre(versification(stresses(F.col("met"))))[0].alias("foot")), source, "en")


def poems(df: DataFrame) -> DataFrame:
    """path, poem, stanza, texts of JSON poems, in file order."""

    def parse(content):
        for name, poem in json.loads(content).items():
            for k, stanza in poem["poem"].items():
                yield name, k, [x["text"] for x in stanza.values()]

    return per_file(df, parse, "poem string, stanza string, texts array<string>")


def pronunciations(df: DataFrame, language: str) -> DataFrame:
    """word, ipa of a dictionary file; of a word's entries the first stays."""

    def parse(content):
        seen: dict[str, str] = {}
        for part in json.loads(content)[language]:
            for w, ipa in part.items():
                seen.setdefault(w, ipa)
        yield from seen.items()

    return per_file(df, parse, "word string, ipa string").select("word", "ipa")


def looked_up(words: DataFrame, dictionary: DataFrame, guess=lambda w: F.substring(w, 1, 1)) -> DataFrame:
    """Adds ipa to rows of different words: by word, else by lower-cased word, else a guess; empty entries count as missing. The dictionary is read and freed of repeats once."""
    d = Scratch(words.sparkSession, "dictionary").keep(dictionary.select("word", "ipa").distinct().dropDuplicates(["word"]))
    found = words.join(d.select("word", F.col("ipa").alias("_a")), "word", "left").withColumn("_low", F.lower("word")).join(d.select(F.col("word").alias("_low"), F.col("ipa").alias("_b")), "_low", "left")
    return found.select(*words.columns, F.coalesce(F.nullif("_a", F.lit("")), F.nullif("_b", F.lit("")), guess(F.col("word"))).alias("ipa"))


def pronounced(words: DataFrame, dictionary: DataFrame, guess=lambda w: F.substring(w, 1, 1)) -> DataFrame:
    """``looked_up`` of any words: each different word is looked up once."""
    return words.join(looked_up(words.select("word").distinct(), dictionary, guess), "word")


def corpus(parts: dict[str, DataFrame], priority: list[str], keys: list[str], normalize: bool = True) -> DataFrame:
    """Union of sources in priority order; of equal (normalised) texts the first stays."""
    out = None
    for i, name in enumerate(s for s in priority if s in parts):
        one = parts[name].withColumn("_p", F.lit(i))
        if normalize:
            one = one.withColumns({k: normalize_characters(F.col(k)) for k in keys})
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    order = ["_p", F.md5(F.to_json(F.struct(*[c for c in out.columns if c != "_p"])).cast("binary"))]
    first = out.withColumn("_o", order[1])
    return keep_first(first, keys, ["_p", "_o"]).drop("_p", "_o")


#: From the files of a source to labelled rows, by what the rows are labelled with.
LABELLED: dict[str, dict[str, Callable[[DataFrame], DataFrame]]] = {
    "meter": {
        "epg64": lambda df: stanza_meters(epg(df), "epg64"),
        "prosodic": lambda df: prosodic(df),
        "fbfv": lambda df: stanza_meters(fbfv(df), "fbfv"),
        "wild": lambda df: wild_meters(df),
    },
    "rhyme": {
        "epg64": lambda df: pair_corpus(fit_scheme(epg(df), True), "epg64", "en"),
        "chicago": lambda df: pair_corpus(chicago(df), "chicago", "en", ["path"]),
        "fbfv": lambda df: pair_corpus(fbfv(df), "fbfv", "en"),
        "wild": lambda df: pair_corpus(wild_stanzas(df), "wild", "de"),
        "grc": lambda df: pair_corpus(fit_scheme(grc(df), False), "grc", "de"),
    },
}


def labelled(sources: dict[str, DataFrame], kind: str) -> DataFrame:
    """The corpus of one kind of labels (meter or rhyme) from the files (path, content) of each source, in one call: read, labelled, normalised, joined and without repeats."""
    priority, keys = (METER_SOURCES, ["text"]) if kind == "meter" else (RHYME_SOURCES, ["v1", "v2"])
    if unknown := sorted(set(sources) - set(priority)):
        raise ValueError(f"no {kind} source: {unknown}")
    return corpus({name: LABELLED[kind][name](df) for name, df in sources.items()}, priority, keys)


def labelled_folders(spark: SparkSession, folders: dict[str, str], kind: str) -> DataFrame:
    return labelled({name: files(spark, path, encoding=ENCODINGS.get(name, "UTF-8")) for name, path in folders.items()}, kind)


READERS: dict[str, Callable] = {"documents": documents, "emotions": emotions, "epg64": epg, "fbfv": fbfv, "grc": grc, "chicago": chicago, "wild": wild_stanzas, "prosodic": prosodic, "poems": poems}
ENCODINGS = {"chicago": "ISO-8859-1"}


def load(spark: SparkSession, name: str, path: str, **options) -> DataFrame:
    """A registered reader over files, or else a table of any format that Spark knows by name."""
    if name == "documents":
        return documents(lines(spark, path, options.pop("pattern", "*")))
    if name in READERS:
        return READERS[name](files(spark, path, options.pop("pattern", "*"), options.pop("encoding", ENCODINGS.get(name, "UTF-8"))), **options)
    return spark.read.format(name).load(path)
