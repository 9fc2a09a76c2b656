"""Classifier pipelines over verses: cleaned by the rules of their language, then scored. A scorer takes columns, as in ``annotate``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from strophe.functions import rules, scorers
from strophe.functions.core import let
from strophe.functions.enums import METERS


def cleaned(verse: Column, lang: Column | None) -> Column:
    """A verse by the rules of its language; without a language it is clean already."""
    return verse if lang is None else rules.by_language(lang, lambda g: rules.clean_sentence(verse, g))


def cleaned_all(verses: Column, lang: Column) -> Column:
    """Each verse of an array, cleaned once, however many classifiers read it."""
    return rules.by_language(lang, lambda g: F.transform(verses, lambda v: rules.clean_sentence(v, g)))


def rhyme(a: Column, b: Column, lang: Column | None = None, scorer: Callable[..., Column] = scorers.rhyme_probability) -> Column:
    """text, text_pair (the cleaned verses, sorted), label and score of the label."""
    pair = F.sort_array(F.array(cleaned(a, lang), cleaned(b, lang)))

    def scored(p):
        return let(scorer(p[0], p[1]), lambda s: F.struct(p[0].alias("text"), p[1].alias("text_pair"), F.when(s >= 0.5, "rhyme").otherwise("dissonance").alias("label"), F.greatest(s, 1 - s).alias("score")))

    return let(pair, scored)


def meter(verse: Column, lang: Column | None = None, scorer: Callable[..., Column] = scorers.meter_probability) -> Column:
    """label and score: the most probable meter, the first in order of several."""

    def best(of):
        every = F.array(*[F.struct(of(F.lit(m)).alias("score"), F.lit(-i).alias("order"), F.lit(m).alias("label")) for i, m in enumerate(METERS)])
        return let(F.array_max(every), lambda x: F.struct(x["label"].alias("label"), x["score"].alias("score")))

    if scorer is scorers.meter_probability:  # the stand-in finds a verse's meter once for all targets
        return let(scorers.meter(cleaned(verse, lang)), lambda x: best(lambda m: scorers.probability_of_meter(x, m)))
    return let(cleaned(verse, lang), lambda v: best(lambda m: scorer(v, m)))


def emotion(verse: Column, lang: Column | None = None, scorer: Callable[..., Column] = scorers.emotion_probability, least: float = 0.5) -> Column:
    """label, score and predicted of each emotion."""
    one = lambda score, e: let(score, lambda s: F.struct(F.lit(e).alias("label"), s.alias("score"), (s >= least).alias("predicted")))
    every = lambda of: F.array(*[one(of(c), e) for e, c in scorers.EMOTION_LETTERS.items()])
    if scorer is scorers.emotion_probability:  # a verse is lowered once for all letters
        return let(cleaned(verse, lang), lambda v: let(F.lower(v), lambda low: every(lambda c: scorer(v, c, low))))
    return let(cleaned(verse, lang), lambda v: every(lambda c: scorer(v, c)))
