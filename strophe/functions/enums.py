"""Enumerations of the verse domain. Fixed values; their order carries meaning."""

RHYME_SCHEMES = ["AAAA", "AAAB", "AABA", "AABB", "AABC", "ABAA", "ABAB", "ABAC", "ABBA", "ABBB", "ABBC", "ABCA", "ABCB", "ABCC", "ABCD"]
RHYME_LABELS = ["rhyme", "dissonance"]
LEVELS = ["high", "medium", "low"]
METERS = ["alexandrine", "amphibrach", "anapaest", "dactyl", "iambus", "other", "trochee"]
RARE_METERS = ["asklepiade", "diphilius", "glykoneus", "hexameter", "pherekrateus", "prosodiakos", "spondee", "zehnsilber"]
ALL_METERS = METERS + RARE_METERS
EMOTIONS = ["Annoyance", "Awe/Sublime", "Beauty/Joy", "Humor", "Sadness", "Suspense", "Uneasiness", "Vitality"]
#: Names that corpora use for the same meter.
METER_SYNONYMS = {"anapestic": "anapaest", "dactylic": "dactyl", "iamb": "iambus", "iambic": "iambus", "spondeus": "spondee", "trochaic": "trochee"}
#: Least scores of medium and high alliteration.
MEDIUM, HIGH = 0.05, 0.1
#: Rhyme scheme of a quatrain by its rhyming verse pairs: (0,1) 1, (0,2) 2, (0,3) 4, (1,2) 8, (1,3) 16, (2,3) 32; -- drops the quatrain.
SCHEME_BY_MASK = """
ABCD AABC ABAC AAAB ABCA AABA ABAA AAAA
ABBC --   ABBC AAAB ABBA --   ABBA AAAA
ABCB --   ABAB --   ABCB AABA ABAB AAAA
ABBB --   ABBB --   ABBB --   ABBB AAAA
ABCC AABB --   --   ABCC AABB ABAA AAAA
--   --   --   --   --   --   --   AAAA
ABCC --   --   --   ABCC AABB --   AAAA
ABBB --   ABBB --   ABBB --   ABBB AAAA
""".split()
#: Verse pairs of a quatrain, in the order of the mask's bits.
PAIRS = [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]
#: Language names of the punctuation and pronunciation tools.
LANGUAGE_CODES = {"de": "deu", "en": "eng-us", "es": "spa", "fr": "fra"}
#: Checkpoint sizes and what they are called.
SIZE_NAMES = {"large": "medium", "xl": "large", "xxl": "xl"}


def renamed(column, names: dict[str, str]):
    """A column with each value under its other name, and those without one as they are (LANGUAGE_CODES, SIZE_NAMES, METER_SYNONYMS)."""
    from pyspark.sql import functions as F

    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in names.items() for v in kv]), column), column)
