"""The rule tokeniser against golden sentences and a plain-Python twin over all lines of the small table."""

import hashlib

import pytest
import regex
from pyspark.sql import functions as F

from strophe.functions import rules
from strophe.plans import catalogue

from .conftest import SF

#: language, sentence, tokens, cleaned sentence.
GOLDEN = [
    ("en", "Hello, world! It's Mr. Smith's dog.", "Hello , world ! It &apos;s Mr. Smith &apos;s dog .", "Hello world It's Mr. Smith's dog"),
    ("en", "He paid 1,000.50 dollars, i.e. much... (truly)", "He paid 1,000.50 dollars , i.e. much ... ( truly )", "He paid 1,000.50 dollars i.e. much truly"),
    ("en", "o ' er the hill ' s edge, the dogs' house", "o &apos;er the hill &apos;s edge , the dogs &apos; house", "o'er the hill's edge the dogs' house"),
    ("en", 'She said "no," and [left] & <went>.', "She said &quot; no , &quot; and &#91; left &#93; &amp; &lt; went &gt; .", 'She said "no" and [left] & < went >'),
    ("en", "See No. 7 of Nos. then", "See No. 7 of Nos. then", "See No. 7 of Nos. then"),
    ("en", "No. We agree. yes.", "No . We agree. yes .", "No We agree. yes"),
    ("de", "Ich hab' es, z.B. heut' Nacht; du liebst's.", "Ich hab' es , z.B. heut' Nacht ; du liebst's .", "Ich hab' es z.B. heut' Nacht du liebst's"),
    ("de", "„Wer reitet so spät?“ – Dr. Faust!", "&quot; Wer reitet so spät ? &quot; - Dr. Faust !", '"Wer reitet so spät" Dr. Faust'),
    ("fr", "L'amour d'aujourd'hui : c'est « fou » !", "L&apos; amour d&apos; aujourd&apos; hui : c&apos; est &quot; fou &quot; !", "L'amour d'aujourd'hui c'est \"fou\""),
    ("es", "¿Qué dices, Sra. Paz?", "¿ Qué dices , Sra. Paz ?", "¿Qué dices Sra. Paz"),
    ("en", "", "", ""), ("en", " \t ", "", ""), ("xx", "Ça va, l'eau.", "Ça va , l&apos;eau .", "Ça va l'eau"),
]


def one(spark, sentence, column):
    return spark.createDataFrame([(sentence,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


def test_golden(spark):
    for lang, x, tokens, clean in GOLDEN:
        assert " ".join(twin_tokens(twin_normalized(x, lang), lang)).replace("&apos;", "'") == tokens.replace("&apos;", "'"), x
        assert " ".join(one(spark, x, lambda c, g=lang: rules.tokenize(rules.normalize_punctuation(c, g), g))).replace("&apos;", "'") == tokens.replace("&apos;", "'"), x
        assert one(spark, x, lambda c, g=lang: rules.clean_sentence(c, g)) == clean == twin_clean(x, lang), x


def test_protected(spark):
    protected = [r"https?://\S+", r"<extra_id_\d+>", r"\w+@\w+\.\w+"]
    x = "See https://a.b/c?d=1,2. or <extra_id_3>, me@x.org! (end)"
    got = one(spark, x, lambda c: rules.tokenize(c, "en", protected))
    assert got == ["See", "https://a.b/c?d=1,2.", "or", "&lt;extra_id_3&gt;", ",", "me@x.org", "!", "(", "end", ")"]
    assert one(spark, x, lambda c: rules.clean_sentence(c, "en", ",", protected)) == "See https://a.b/c?d=1,2. or <extra_id_3> me@x.org! (end)"
    assert one(spark, None, lambda c: rules.clean_sentence(c, "en")) is None


@pytest.mark.parametrize("lang", ["en", "de", "fr", "es"])
def test_inverse(spark, lang):
    """Tokens of plain sentences go back to what they came from."""
    for x in ("Wer war das? Nun, ich (nur) weiss: 3.5 % sind es.", 'Er sagt "ja" und geht.', "a, b; c: d!"):
        y = one(spark, x, lambda c: rules.detokenize(rules.tokenize(c, lang), lang))
        assert y == (x.replace(" %", "%") if lang != "fr" else regex.sub(r"(?<! )([?:;!])", r" \1", x))


def swapped(rows):
    """Replacements of the other engine's form as Python's."""
    return [(a.replace(r"\p{IsAlphabetic}", r"\p{Alphabetic}"), regex.sub(r"\$(\d)", r"\\\1", b)) for a, b in rows]


def twin_normalized(x, lang):
    for a, b in swapped([*rules.SPACING, *rules.UNICODE, *rules.GUILLEMETS, *rules.PSEUDO_SPACES, *rules.QUOTE_COMMA.get(lang, []), *rules.NUMBERS.get(lang, rules.POINT)]):
        x = regex.sub(a, b, x)
    return x.strip(" ")


def twin_tokens(x, lang):
    alpha, alnum = r"\p{Alphabetic}", r"\p{Alphabetic}\p{Nd}"
    x = regex.sub(r"[\x00-\x1f]", "", regex.sub(r"\s+", " ", x)).strip(" ")
    x = "".join(c if regex.match(rf"[{alnum}\s.'`,\-]", c) else f" {c} " for c in x)
    x = regex.sub(r"\.{2,}", lambda m: " " + "\ue011" * len(m[0]) + " ", x)
    x = regex.sub(r"([^\p{N}]),", r"\1 , ", x)
    x = regex.sub(r",([^\p{N}])", r" , \1", x)
    x = regex.sub(r"(\p{N}),$", r"\1 , ", x)
    for a, b in swapped(rules.APOSTROPHES.get(lang, [])):
        x = regex.sub(a, b, x)
    words = x.split()
    out = []
    for i, w in enumerate(words):
        after = words[i + 1] if i + 1 < len(words) else ""
        if w.endswith(".") and len(w) > 1:
            p = w[:-1]
            known = rules.ABBREVIATIONS.get(lang, rules.ABBREVIATIONS["en"])
            if not ("." in p and regex.search(alpha, p) or p in known or regex.match(r"\p{Ll}", after) or p in rules.BEFORE_NUMBERS.get(lang, []) and regex.match("[0-9]", after)):
                out += [p, "."]
                continue
        out.append(w)
    x = regex.sub(r"\.' ?$", " . ' ", " ".join(out)).replace("\ue011", ".")
    for a, b in rules.ESCAPES:
        x = x.replace(a, b)
    return x.split()


def twin_clean(x, lang):
    tokens = [w for w in twin_tokens(twin_normalized(x, lang), lang) if any(c not in rules.PUNCTUATION for c in w)]
    x = " ".join(tokens)
    for a, b in [*rules.ESCAPES[1:], rules.ESCAPES[0]]:
        x = x.replace(b, a)
    words, text, space, quotes = x.split(), "", " ", {}
    for i, w in enumerate(words):
        if regex.fullmatch(r"[\p{Sc}(\[{¿¡]+", w):
            text, space = text + space + w, ""
        elif regex.fullmatch(r"[,.?!:;\\%}\])]+", w):
            text, space = text + (" " if lang == "fr" and regex.fullmatch(r"[?!:;\\%]", w) else "") + w, " "
        elif lang == "en" and i and regex.match(r"'\p{Alphabetic}", w):
            text, space = text + w, " "
        elif lang == "fr" and regex.search(r"\p{Alphabetic}'$", w) and i + 1 < len(words) and regex.match(r"\p{Alphabetic}", words[i + 1]):
            text, space = text + space + w, ""
        elif regex.fullmatch("['\"„“`]+", w):
            q = '"' if regex.fullmatch("[„“”]+", w) else w
            if quotes.get(q, 0) % 2:
                text, space = text + w, " "
                quotes[q] += 1
            elif lang == "en" and w == "'" and i and words[i - 1].endswith("s"):
                text, space = text + w, " "
            else:
                text, space = text + space + w, ""
                quotes[q] = quotes.get(q, 0) + 1
        else:
            text, space = text + space + w, " "
    return regex.sub(" +", " ", text).strip(" ")


def test_twin_over_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = {r["doc_id"]: hashlib.md5("\n".join(twin_clean(x, r["lang"]) for x in r["text"].split("\n")).encode()).hexdigest() for r in docs}
    got = {r["doc_id"]: r["clean"] for r in catalogue.clean_lines(spark, SF).collect()}
    assert got == want


def last(x):
    found = regex.findall(r"\p{L}+", x.lower())
    return found[-1] if found else ""


def test_classifiers_clean_first(spark):
    """Rhymes and emotions of all lines by the twin's cleaning; meters add up."""
    from collections import Counter

    from strophe.functions.scorers import EMOTION_LETTERS

    want = Counter()
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        lines = [twin_clean(x, r["lang"]) for x in r["text"].split("\n")]
        for i, x in enumerate(lines):
            for e, c in EMOTION_LETTERS.items():
                want[r["doc_id"], f"emotion:{e}"] += min(1, 8 * x.lower().count(c) / max(1, len(x))) >= 0.5
            if i:
                a, b = last(lines[i - 1]), last(x)
                want[r["doc_id"], "rhyme:rhyme" if a != b and len(a) > 1 and len(b) > 1 and a[-2:] == b[-2:] else "rhyme:dissonance"] += 1
    rows = catalogue.classified_lines(spark, SF).collect()
    assert {(r["doc_id"], r["label"]): r["n"] for r in rows if not r["label"].startswith("meter")} == {k: n for k, n in want.items() if n}
    n = Counter()
    for r in rows:
        n[r["doc_id"]] += r["n"] if r["label"].startswith("meter") else 0
    assert n == Counter({r["doc_id"]: r["text"].count("\n") + 1 for r in spark.read.parquet(f"{SF}/documents.parquet").collect()})


def test_plain_texts_go_without_rules(spark):
    """Texts of letters, digits and plain marks, and others, against all rules; a verse's meter is found once for all targets."""
    import random

    from strophe.functions import scorers
    from strophe.operators import classify

    rng = random.Random(8)
    texts = ["".join(rng.choice(of) for _ in range(rng.randrange(25))) for of in ("aÉ1 .,!?-e\u0301", "a1 .,:;()%\"'", "a \u00a0.«»’º1,%\r") for _ in range(150)] + [None, "", "  ", "a \n", "a  b\n"]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    for lang in ("en", "de"):
        every = [*rules.SPACING, *rules.UNICODE, *rules.GUILLEMETS, *rules.PSEUDO_SPACES, *rules.QUOTE_COMMA.get(lang, []), *rules.NUMBERS.get(lang, rules.POINT)]
        assert [a for a, b in df.select(rules.normalize_punctuation(F.col("x"), lang), F.trim(rules._replaced(F.col("x"), every))).collect() if a != b] == []
    other = lambda v, m: scorers.meter_probability(v, m)
    letters = lambda v, c: scorers.emotion_probability(v, c)
    v = F.col("x")
    assert [a for a, b in df.select(classify.emotion(v), classify.emotion(v, scorer=letters)).collect() if a != b] == []
    text = lambda c: c._jc.toString().count("hexa")
    assert text(classify.meter(v)) <= text(scorers.meter(v)) < text(classify.meter(v, scorer=other))
