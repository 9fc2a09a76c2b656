"""Pronunciations of whole verses: the different words of a piece of the rows are looked up, and put back in their places piece by piece, so a word does not move each time it stands."""

from __future__ import annotations

from functools import reduce
from operator import and_

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strophe.functions.prosody import alliterations, stressed_phones
from strophe.functions.text import tokens
from strophe.sources.readers import looked_up, pronounced

from .scratch import Scratch

#: Rows that are looked up together, in the order in which they were read; fewer of long verses, so that a piece stays small.
PIECE, LONG, PIECE_LONG = 8192, 10_000, 64


def words(verse: str) -> Column:
    return F.filter(tokens(F.col(verse)), lambda t: t.rlike(r"\p{L}"))


def of_shared_ids(df: DataFrame, ids: list[str], verse: str, dictionary: DataFrame, **options) -> DataFrame:
    """``sentence_phones`` of rows that have the same ids: each has the words of all of them."""
    each = df.select(*ids, F.posexplode(words(verse)).alias("pos", "word"))
    found = pronounced(each, dictionary, **options).groupBy(*ids).agg(F.sort_array(F.collect_list(F.struct("pos", "ipa"))).alias("_w"))
    out = df.join(found.select(*ids, F.transform("_w", lambda w: w["ipa"]).alias("ipa")), ids, "left").select(*df.columns, "ipa")
    return out.withColumn("ipa", F.coalesce("ipa", F.array().cast("array<string>")))


def sentence_phones(df: DataFrame, ids: list[str], verse: str, dictionary: DataFrame, **options) -> DataFrame:
    """Adds ipa, an array in word order; a verse without words has none, nor has a row with an id that is null.

    Rows are written once, in pieces. The different words of a piece move to the dictionary and back, and its rows move once, to meet them.
    """
    scratch = Scratch(df.sparkSession, "phones")
    kept = scratch.keep(df.withColumn("_at", F.monotonically_increasing_id()))
    shared = scratch.keep(kept.dropna(subset=ids).groupBy(*ids).agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n"))
    twice, rows = None, kept
    if not shared.isEmpty():
        twice = of_shared_ids(kept.join(shared, ids, "left_semi").select(*df.columns), ids, verse, dictionary, **options)
        rows = kept.join(shared, ids, "left_anti")
    piece = F.when(F.length(verse) < LONG, F.floor(F.col("_at") / PIECE) * 2).otherwise(F.floor(F.col("_at") / PIECE_LONG) * 2 + 1)
    known = reduce(and_, [F.col(c).isNotNull() for c in ids], F.lit(True))
    # Words hold no control characters, so a joined text tells them apart, in less room than an array.
    rows = rows.select(*df.columns, piece.alias("_piece"), F.coalesce(F.when(known, F.array_join(words(verse), "\0")), F.lit("")).alias("_words"))
    each = rows.filter("_words <> ''").select("_piece", F.explode(F.split("_words", "\0")).alias("word")).distinct().groupBy("word").agg(F.collect_list("_piece").alias("_piece"))
    found = looked_up(each, dictionary, **options).select(F.explode("_piece").alias("_piece"), "word", "ipa")

    def placed(left: pa.Table, right: pa.Table) -> pa.Table:
        text = left["_words"].combine_chunks()
        flat = pc.split_pattern(text, "\0")
        at = pc.index_in(flat.flatten(), right["word"].combine_chunks())
        n = pc.if_else(pc.equal(text, ""), 0, pc.list_value_length(flat))
        ipa = right["ipa"].combine_chunks().take(at.filter(pc.is_valid(at)))
        ends = pa.concat_arrays([pa.array([0], pa.int32()), pc.cumulative_sum(n).cast(pa.int32())])
        return left.select(df_columns).append_column("ipa", pa.ListArray.from_arrays(ends, ipa))

    df_columns = df.columns
    schema = T.StructType([*df.schema.fields, T.StructField("ipa", T.ArrayType(T.StringType()))])
    out = rows.groupBy("_piece").cogroup(found.groupBy("_piece")).applyInArrow(placed, schema)
    return out if twice is None else out.unionByName(twice)


def sentence_alliteration(df: DataFrame, ids: list[str], verse: str, dictionary: DataFrame, **options) -> DataFrame:
    """Adds the alliteration score of the stressed phones."""
    return sentence_phones(df, ids, verse, dictionary, **options).withColumn("score", F.get(alliterations(F.array(stressed_phones(F.col("ipa")))), 0))
