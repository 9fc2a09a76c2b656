"""Deterministic stand-ins for the neural scorers, as expressions that SQL can mirror; a pandas UDF of the same shape replaces any of them.

They are not the reference's models, and their scores say nothing about its.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import let
from .enums import EMOTIONS
from .prosody import FORMS, foot_and_metre, known_meter, meter_label, stresses, versification
from .text import last_word

#: The letter whose share of a verse stands for an emotion.
EMOTION_LETTERS = dict(zip(EMOTIONS, "aeioustn", strict=True))
assert FORMS


def rhyme_probability(a: Column, b: Column) -> Column:
    """Common end of the last words, of three letters at most, in thirds; 0 for equal words."""
    return rhyme_of_words(last_word(a), last_word(b))


def rhyme_of_words(a: Column, b: Column) -> Column:
    return let(F.struct(a.alias("x"), b.alias("y")), _rhyme)


def _rhyme(words: Column) -> Column:
    x, y = words["x"], words["y"]
    same = lambda n: (F.length(x) >= n) & (F.length(y) >= n) & (F.right(x, F.lit(n)) == F.right(y, F.lit(n)))
    return F.when(x == y, 0.0).when(same(3), 1.0).when(same(2), 2 / 3).when(same(1), 1 / 3).otherwise(0.0)


def pattern(verse: Column) -> Column:
    """Words of odd length are stressed."""
    words = F.regexp_extract_all(verse, F.lit(r"\p{L}+"), F.lit(0))
    return F.array_join(F.transform(words, lambda w: F.when(F.length(w) % 2 == 1, "+").otherwise("-")), "")


def meter(verse: Column) -> Column:
    form = let(stresses(pattern(verse)), lambda p: versification(p))
    return let(foot_and_metre(form)[0], lambda foot: meter_label(F.when(known_meter(foot), foot).otherwise("other")))


def meter_probability(verse: Column, target: Column) -> Column:
    return probability_of_meter(meter(verse), target)


def probability_of_meter(label: Column, target: Column) -> Column:
    """The same from a verse's meter."""
    return F.when(label == target, 0.7).otherwise(0.05)


def emotion_probability(verse: Column, letter: str, lowered: Column | None = None) -> Column:
    """lowered: the verse in lower case, where it is known."""
    n = F.length(verse) - F.length(F.replace(F.lower(verse) if lowered is None else lowered, F.lit(letter), F.lit("")))
    return F.least(F.lit(1.0), 8.0 * n / F.greatest(F.length(verse), F.lit(1)))


def emotion_probabilities(verse: Column) -> Column:
    """Of all emotions, in their order."""
    return F.array(*[emotion_probability(verse, c) for c in EMOTION_LETTERS.values()])


def emotions(verse: Column) -> Column:
    """Predicted emotions: probability of a half or more."""
    return F.filter(F.array(*[F.when(emotion_probability(verse, c) >= 0.5, e) for e, c in EMOTION_LETTERS.items()]), lambda x: x.isNotNull())


def initials(verse: Column) -> Column:
    """First letters of the words, as stressed phones."""
    return F.transform(F.regexp_extract_all(F.lower(verse), F.lit(r"\p{L}+"), F.lit(0)), lambda w: F.substring(w, 1, 1))


def next_sentence(a: Column, b: Column) -> Column:
    """Jaccard similarity of the words."""
    w = lambda x: F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit(r"\p{L}+"), F.lit(0)))
    sizes = let(F.struct(w(a).alias("x"), w(b).alias("y")), lambda s: F.struct(F.size(F.array_intersect(s["x"], s["y"])).alias("both"), F.size(F.array_union(s["x"], s["y"])).alias("either")))
    return let(sizes, lambda s: F.when(s["either"] == 0, 0.0).otherwise(s["both"] / F.greatest(s["either"], F.lit(1))))
