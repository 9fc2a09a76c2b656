"""Text functions as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import let

#: Corrections in the order they apply (pattern, replacement).
CORRECTIONS = [
    ("<[^>]*>", ""), ("ſ", "s"), (r"\[", ""), (r"\]", ""), ("’", "'"),
    ("&#223;", "ß"), ("&#383;", "s"), ("u&#868;", "ü"), ("a&#868;", "ä"), ("o&#868;", "ö"), ("&#246;", "ö"), ("&#224;", "a"), ("&#772;", "m"), ("&#8217;", "'"), ("&#42843;", "r"), ("&#244;", "o"), ("&#230;", "ae"), ("&#8229;", "."),
    ("Jch", "Ich"), ("Jhr", "Ihr"), ("Jst", "Ist"), ("JCh", "Ich"), ("jch", "ich"), ("Jn", "In"), ("DJe", "Die"), ("Wje", "Wie"),
    ("¬", "-"), ("´", "'"), ("''", '"'), ("—", "--"), (" - ", "-"), ("”", '"'),
    ("oͤ", "ö"), ("uͤ", "ü"), ("aͤ", "ä"), ("&#771;", "̃"), ("&#8222;", "”"), ("ꝛ", "r"), ("Ꝛ", "R"),
]


def strip(x: Column) -> Column:
    """Without Unicode white space at both ends (trim would take spaces only)."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def normalize_characters(x: Column) -> Column:
    """Corrections in order; a leading b'…' is unwrapped; of two capitals before a small letter the second is lowered."""
    def unwrapped(y):
        return F.when(y.startswith("b'"), F.substring(y, F.lit(3), F.greatest(F.length(y) - 3, F.lit(0)))).otherwise(y)

    def lowered(y):
        two, third = F.substring(y, 1, 2), F.substring(y, 3, 1)
        upper = two.rlike(r"\p{Lu}") & ~two.rlike(r"[\p{Ll}\p{Lt}]")
        small = F.concat(F.substring(y, 1, 1), F.lower(F.substring(y, 2, 1)), F.substring(y, F.lit(3), F.length(y)))
        return F.when((F.length(y) >= 3) & upper & ~third.rlike(r"\p{Lu}"), small).otherwise(y)

    return let(let(reduce(lambda c, r: F.regexp_replace(c, r[0], r[1]), CORRECTIONS, x), unwrapped), lowered)


def tokens(x: Column) -> Column:
    """Words (with inner apostrophes), numbers, and other marks one by one: the stand-in for a rule tokeniser."""
    return F.regexp_extract_all(x, F.lit(r"[\p{L}\p{M}\p{N}]+(?:'[\p{L}\p{M}]+)*|[^\s\p{L}\p{M}\p{N}]"), F.lit(0))


#: ASCII punctuation, as a character class.
PUNCTUATION = r"[!-/:-@\[-`{-~]"


def clean_tokens(x: Column, drop: str | None = PUNCTUATION) -> Column:
    """Tokens but those made of dropped characters alone."""
    return tokens(x) if drop is None else F.filter(tokens(x), lambda t: ~t.rlike(f"^{drop}+$"))


def clean_sentence(x: Column, drop: str | None = PUNCTUATION) -> Column:
    """Cleaned tokens put together again: no space before closing marks or after opening ones."""
    y = F.array_join(clean_tokens(x, drop), " ")
    return F.regexp_replace(F.regexp_replace(y, r" ([.,;:?!)\]}])", "$1"), r"([(\[{]) ", "$1")


def emotion_detokenize(x: Column) -> Column:
    """Spacing repairs of the tab-separated emotion corpus."""
    y = F.replace(F.replace(x, F.lit("—"), F.lit("-")), F.lit(" ’ "), F.lit("' "))
    y = F.regexp_replace(y, r'(?U)\s"(\w)', "'$1")
    y = F.regexp_replace(y, r'(?U)(\w)"(\w)', "$1'$2")
    return strip(F.regexp_replace(y, r"(?U)\s([.,;:?!](?:\s+|$|-))", "$1"))


def join_contractions(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)\s('\w{1,2})", "$1")


def collapse_newlines(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)\s*\n\s*", "\n")


def cut_after_second(x: Column, mark: str) -> Column:
    """The text before the first mark that starts after a leading one's length; without one the last character goes."""
    at = F.locate(mark, x, len(mark) + 1)
    return F.when(at > 0, F.substring(x, F.lit(1), at - 1)).otherwise(F.substring(x, F.lit(1), F.greatest(F.length(x) - 1, F.lit(0))))


#: What TeX wants escaped.
TEX = [("&", r"\&"), ("%", r"\%"), ("$", r"\$"), ("#", r"\#"), ("_", r"\_"), ("{", r"\{"), ("}", r"\}"), ("~", r"\textasciitilde{}"), ("^", r"\^{}")]


def tex_escape(x: Column) -> Column:
    special = F.create_map(*[F.lit(v) for pair in [*TEX, ("\\", r"\textbackslash{}"), ("<", r"\textless{}"), (">", r"\textgreater{}")] for v in pair])
    return F.array_join(F.transform(F.split(x, ""), lambda c: F.coalesce(F.try_element_at(special, c), c)), "")


def html_escape(x: Column) -> Column:
    return reduce(lambda c, r: F.replace(c, F.lit(r[0]), F.lit(r[1])), [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")], x)


def last_word(x: Column) -> Column:
    """In lower case. Looked for from the end, so that a long verse costs no more than a short one."""
    return F.lower(F.reverse(F.regexp_extract(F.reverse(x), r"^[^\p{L}]*(\p{L}+)", 1)))
