"""Annotation of quatrains: score each different verse or pair once, join the scores back, aggregate by quatrain.

A scorer takes columns and returns a column; the defaults are the stand-ins of strophe.functions.scorers, and pandas UDFs fit as well.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strophe.functions import scorers
from strophe.functions.core import let
from strophe.functions.enums import PAIRS
from strophe.functions.prosody import alliteration, alliteration_level, alliterations as alliterating, canonical_scheme, mean, scheme_of_mask
from strophe.functions.text import clean_sentence, last_word

from .scratch import Scratch
from .windows import verse_pairs


def score_distinct(df: DataFrame, keys: list[str], scorer: Callable[..., Column], name: str = "score") -> DataFrame:
    """df with a scorer's value, which sees each different key once; keys that are null have none.

    Different keys are counted as they are found. The few that hold more than a fraction of a partition each (at most four for each partition, whatever the data) are joined
    by broadcast, so that a line in any share of all rows is never dealt to one task; all others meet their score by a shuffle.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    scored = Scratch(spark, "scores").keep(df.groupBy(*keys).agg(F.count("*").alias("_n")).withColumn(name, scorer(*[F.col(k) for k in keys])))
    least = max(1000, (scored.agg(F.sum("_n")).first()[0] or 0) // (4 * parts))
    heavy = F.broadcast(scored.filter(F.col("_n") >= least).drop("_n"))
    if heavy.isEmpty():
        return df.join(scored.drop("_n"), keys, "left")
    light = scored.filter(F.col("_n") < least).drop("_n")
    rest = df.join(heavy.select(*keys), keys, "left_anti").join(light, keys, "left")
    return rest.unionByName(df.join(heavy, keys))


#: What is known of each line of a text, as arrays beside its lines (``windows.quatrain_windows``): a line is scored once for its text, not once for each window or pair, and nothing is shuffled.
LINE_SCORES = {
    "words": lambda v: F.transform(v, last_word),
    "labels": lambda v: F.transform(v, scorers.meter),
    "clean": lambda v: F.transform(v, lambda x: clean_sentence(x, "=")),
    "scores": lambda v: alliterating(F.transform(v, scorers.initials)),
    "emotions_of": lambda v: F.transform(v, scorers.emotions),
    "probabilities": lambda v: F.transform(v, scorers.emotion_probabilities),
}


def line_scores(verses: Column, *names: str) -> dict[str, Column]:
    return {n: LINE_SCORES[n](verses) for n in names}


def mask_of_words(words: str, least: float = 0.5) -> Column:
    """The pairs of a quatrain's last words that rhyme, as bits."""
    bits = [F.when(scorers.rhyme_of_words(F.get(words, i), F.get(words, j)) >= least, 1 << b).otherwise(0) for b, (i, j) in enumerate(PAIRS)]
    return sum(bits[1:], bits[0])


def vote(labels: Column) -> Column:
    """The most frequent of four labels, the first of ties, if it stands twice; else other."""
    counted = F.transform(labels, lambda x, i: F.struct(F.size(F.filter(labels, lambda y: y == x)).alias("n"), (-i).alias("first"), x.alias("label")))
    return let(F.array_max(counted), lambda t: F.when(t["n"] >= 2, t["label"]).otherwise("other"))


def exploded(df: DataFrame, quatrain: str) -> DataFrame:
    return df.select("*", F.posexplode(quatrain).alias("pos", "verse"))


def rhymes(df: DataFrame, ids: list[str], quatrain: str = "quatrain", scorer=scorers.rhyme_probability, least: float = 0.5, words: str | None = None) -> DataFrame:
    """Adds rhyme; quatrains whose pairs fit no scheme go. words: the verses' last words, where they are known and the scorer is the stand-in."""
    if words:
        return df.withColumn("rhyme", scheme_of_mask(mask_of_words(words, least))).filter("rhyme IS NOT NULL")
    pairs = df.select(*ids, F.posexplode(verse_pairs(F.col(quatrain))).alias("bit", "p")).select(*ids, "bit", "p.a", "p.b")
    bits = score_distinct(pairs, ["a", "b"], scorer).groupBy(*ids).agg(F.sum(F.when(F.col("score") >= least, F.pow(F.lit(2), F.col("bit"))).otherwise(0)).cast("int").alias("mask"))
    return df.join(bits.withColumn("rhyme", scheme_of_mask(F.col("mask"))).filter("rhyme IS NOT NULL").drop("mask"), ids)


def meters(df: DataFrame, ids: list[str], quatrain: str = "quatrain", scorer=scorers.meter, labels: str | None = None) -> DataFrame:
    """Adds meter: the most frequent of the four verses, first seen of ties, if it stands twice; else other. labels: the verses' meters, where they are known."""
    if labels:
        return df.withColumn("meter", vote(F.col(labels)))
    votes = score_distinct(exploded(df.select(*ids, quatrain), quatrain), ["verse"], scorer, "label").groupBy(*ids, "label").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    top = votes.groupBy(*ids).agg(F.max_by(F.struct("label", "n"), F.struct("n", -F.col("first"))).alias("t"))
    return df.join(top.select(*ids, F.when(F.col("t.n") >= 2, F.col("t.label")).otherwise("other").alias("meter")), ids)


def alliterations(df: DataFrame, ids: list[str], quatrain: str = "quatrain", phones=scorers.initials, scores: str | None = None) -> DataFrame:
    """Adds alliteration_score (mean of the verses) and alliteration (its level). scores: the verses' own, where they are known."""
    if scores:
        return df.withColumn("alliteration_score", mean(F.col(scores))).withColumn("alliteration", alliteration_level(F.round("alliteration_score", 9)))
    scores = score_distinct(exploded(df.select(*ids, quatrain), quatrain), ["verse"], lambda v: alliteration(phones(v)))
    one = scores.groupBy(*ids).agg(F.sort_array(F.collect_list(F.struct("pos", "score"))).alias("s"))
    value = mean(F.transform("s", lambda x: x["score"]))
    return df.join(one.select(*ids, value.alias("alliteration_score")), ids).withColumn("alliteration", alliteration_level(F.round("alliteration_score", 9)))


def emotions(df: DataFrame, ids: list[str], quatrain: str = "quatrain", scorer=scorers.emotions, emotions_of: str | None = None) -> DataFrame:
    """Adds emotion: all predicted ones of the verses, sorted; quatrains without any go. emotions_of: the verses' own, where they are known."""
    if emotions_of:
        return df.withColumn("emotion", F.sort_array(F.array_distinct(F.flatten(emotions_of)))).filter(F.size("emotion") > 0)
    seen = score_distinct(exploded(df.select(*ids, quatrain), quatrain), ["verse"], scorer, "e").select(*ids, F.explode("e").alias("e")).groupBy(*ids).agg(F.sort_array(F.collect_set("e")).alias("emotion"))
    return df.join(seen, ids)


def annotate(df: DataFrame, ids: list[str], quatrain: str = "quatrain", meter=scorers.meter, phones=scorers.initials, least: float = 0.5, words: str | None = None, labels: str | None = None, scores: str | None = None) -> DataFrame:
    """Adds rhyme, meter, alliteration_score and alliteration; quatrains whose pairs fit no scheme go. All that is known of a verse is scored in one pass over different verses.

    The rhyme of a pair comes from the last words of its verses, so it needs no pass of its own; for a scorer of whole pairs use ``rhymes``, then ``meters`` and ``alliterations``.
    words, labels, scores: arrays of what is known of the verses (``line_scores``); if all are given, nothing is scored or shuffled.
    """
    if words and labels and scores:
        out = alliterations(meters(rhymes(df, ids, quatrain, least=least, words=words), ids, quatrain, labels=labels), ids, quatrain, scores=scores)
        return out.select(*[c for c in df.columns if c not in (words, labels, scores)], "rhyme", "meter", "alliteration_score", "alliteration")
    every = lambda v: F.struct(last_word(v).alias("word"), meter(v).alias("label"), alliteration(phones(v)).alias("score"))
    rest = [c for c in df.columns if c not in (*ids, quatrain)]
    verses = score_distinct(exploded(df, quatrain).drop(quatrain), ["verse"], every, "s")
    of = verses.groupBy(*ids).agg(F.sort_array(F.collect_list(F.struct("pos", "verse", "s"))).alias("v"), *[F.first(c).alias(c) for c in rest])
    s = lambda i: F.get("v", i)["s"]
    rhyming = [F.when(scorers.rhyme_of_words(s(i)["word"], s(j)["word"]) >= least, 1 << b).otherwise(0) for b, (i, j) in enumerate(PAIRS)]
    labels = F.transform("v", lambda x: x["s"]["label"])
    vote = F.array_max(F.transform("v", lambda x: F.struct(F.size(F.filter(labels, lambda y: y == x["s"]["label"])).alias("n"), (-x["pos"]).alias("first"), x["s"]["label"].alias("label"))))
    out = of.withColumn("rhyme", scheme_of_mask(sum(rhyming[1:], rhyming[0]))).filter("rhyme IS NOT NULL")
    out = out.withColumn(quatrain, F.transform("v", lambda x: x["verse"])).withColumn("_vote", vote).withColumn("meter", F.when(F.col("_vote.n") >= 2, F.col("_vote.label")).otherwise("other"))
    out = out.withColumn("alliteration_score", mean(F.transform("v", lambda x: x["s"]["score"]))).withColumn("alliteration", alliteration_level(F.round("alliteration_score", 9)))
    return out.select(*df.columns, "rhyme", "meter", "alliteration_score", "alliteration")


def pair_order(target: Column) -> Column:
    """The pairs of verses in the order in which they may join: those that the target rhymes, then the others from the last."""
    same = lambda p: F.substring(target, p["i"] + 1, F.lit(1)) == F.substring(target, p["j"] + 1, F.lit(1))
    pairs = F.array(*[F.struct(F.lit(b).alias("bit"), F.lit(i).alias("i"), F.lit(j).alias("j")) for b, (i, j) in enumerate(PAIRS)])
    return F.concat(F.filter(pairs, same), F.reverse(F.filter(pairs, lambda p: ~same(p))))


#: rhymes[i][k] is the bit of the pair of verses i and k in a mask; none for a verse and itself.
PAIR_BIT = [[0 if i == k else 1 << PAIRS.index((min(i, k), max(i, k))) for k in range(4)] for i in range(4)]


def inferred_scheme(target: Column, mask: Column) -> Column:
    """The scheme of a quatrain whose rhyming pairs are the bits of a mask, as near to a target as they allow.

    A fold over the ordered pairs; the state is the class of each verse. Into the class of a verse that no other has taken goes the class of the
    pair's second verse, if the mask has a bit for the first verse and every member of it.
    """
    bits = F.array(*[F.array(*map(F.lit, row)) for row in PAIR_BIT])

    def step(state, p):
        taken, first = F.get(state, p["j"]), F.get(state, p["i"])
        fits = F.forall(F.sequence(F.lit(0), F.lit(3)), lambda k: (F.get(state, k) != taken) | (mask.bitwiseAND(F.get(F.get(bits, p["i"]), k)) != 0))
        return F.when((first == p["i"]) & fits, F.transform(state, lambda v: F.when(v == taken, first).otherwise(v))).otherwise(state)

    return canonical_scheme(F.aggregate(pair_order(target), F.array(*map(F.lit, range(4))), step))


def report(df: DataFrame, quatrain: str = "quatrain", scheme: str = "scheme", meter: str = "meter", level: str = "level", words: str | None = None, labels: str | None = None, scores: str | None = None) -> DataFrame:
    """For generated quatrains: found_scheme, scheme_match by place, found_meter (the target where it is likely enough) and meter_match by verse, found_level and level_match (GOOD, OK or BAD).

    words, labels, scores: as in ``annotate``; what is not given is scored once for each quatrain.
    """
    q = F.col(quatrain)
    given = {"_words": words, "_labels": labels, "_scores": scores}
    own = line_scores(q, "words", "labels", "scores")
    out = df.withColumns({k: F.col(c) if c else own[k[1:]] for k, c in given.items()})
    out = out.withColumn("found_scheme", let(F.struct(F.col(scheme).alias("t"), mask_of_words("_words").alias("m")), lambda x: inferred_scheme(x["t"], x["m"])))
    letters = lambda c: F.split(c, "")
    out = out.withColumn("scheme_match", F.zip_with(letters(F.col(scheme)), letters(F.col("found_scheme")), lambda a, b: F.when(a == b, "GOOD").otherwise("BAD")))
    verdict = lambda x: F.when(x == F.col(meter), "GOOD").when(scorers.probability_of_meter(x, F.col(meter)) >= 1 / 7, "OK").otherwise("BAD")
    out = out.withColumn("meter_match", F.transform("_labels", verdict))
    out = out.withColumn("found_meter", F.zip_with("_labels", "meter_match", lambda x, m: F.when(m == "BAD", x).otherwise(F.col(meter))))
    found = alliteration_level(mean(F.col("_scores")))
    rank = lambda c: F.when(c == "low", 0).when(c == "medium", 1).otherwise(2)
    gap = F.abs(rank(F.col("found_level")) - rank(F.col(level)))
    return out.withColumn("found_level", found).withColumn("level_match", F.when(gap == 0, "GOOD").when(gap == 1, "OK").otherwise("BAD")).drop(*given, *filter(None, given.values()))


__all__ = ["annotate", "canonical_scheme", "emotions", "inferred_scheme", "report", "score_distinct"]
