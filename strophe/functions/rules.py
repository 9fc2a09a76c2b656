"""Rule tokeniser, detokeniser and cleaning of sentences by language, as column expressions over short texts (sentences, verses).

Normalised punctuation, then tokens by ordered rules: protected patterns stand back behind placeholders, marks are set apart, commas but for those in
numbers, apostrophes by language, full stops but for abbreviations; at the end the characters that mean something in markup are escaped. Cleaning drops
the tokens that consist of punctuation; escaped quotes and apostrophes (``&quot;``) hold letters and stay, as the rules have it. The detokeniser is the inverse: a fold over the
tokens that knows which side each mark leans to and which quotes are open.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import let

ALPHA, NUMERIC, ALNUM = r"\p{IsAlphabetic}", r"\p{N}", r"\p{IsAlphabetic}\p{Nd}"
#: Placeholders: private-use characters for protected text and for each dot of a row of dots.
HELD, DOT = "\ue010", "\ue011"

#: How punctuation is normalised, in the order in which the rules apply (pattern, replacement).
SPACING = [
    (r"\r", ""), (r"\(", " ("), (r"\)", ") "), (r" +", " "), (r"\) ([.!:?;,])", r")$1"), (r"\( ", "("), (r" \)", ")"), (r"(\d) %", r"$1%"), (r" :", ":"), (r" ;", ";"),
]
UNICODE = [
    ("„", '"'), ("“", '"'), ("”", '"'), ("–", "-"), ("—", " - "), (r" +", " "), ("´", "'"), (r"([a-zA-Z])‘([a-zA-Z])", r"$1'$2"), (r"([a-zA-Z])’([a-zA-Z])", r"$1'$2"), ("‘", "'"), ("‚", "'"), ("’", "'"), ("''", '"'), ("´´", '"'), ("…", "..."),
]
GUILLEMETS = [("\u00a0«\u00a0", '"'), ("«\u00a0", '"'), ("«", '"'), ("\u00a0»\u00a0", '"'), ("\u00a0»", '"'), ("»", '"')]
PSEUDO_SPACES = [
    ("\u00a0%", "%"), ("nº\u00a0", "nº "), ("\u00a0:", ":"), ("\u00a0ºC", " ºC"), ("\u00a0cm", " cm"), ("\u00a0\\?", "?"), ("\u00a0!", "!"), ("\u00a0;", ";"), (",\u00a0", ", "), (r" +", " "),
]
QUOTE_COMMA = {"en": [(r'"([,.]+)', '$1"')], "de": [(',"', '",'), (r'(\.+)"(\s*[^<])', '"$1$2')]}
QUOTE_COMMA |= {"es": QUOTE_COMMA["de"], "fr": QUOTE_COMMA["de"]}
NUMBERS = {"de": [("(\\d)\u00a0(\\d)", "$1,$2")], "es": [("(\\d)\u00a0(\\d)", "$1,$2")]}
POINT = [("(\\d)\u00a0(\\d)", "$1.$2")]

#: Apostrophes by language. Elsewhere they stay where they are, as verse contracts with them.
APOSTROPHES = {
    "en": [
        (rf"([{ALPHA}])\s[']\s([{ALPHA}])", "$1'$2"), (rf"([{NUMERIC}])\s[']\s([s])", "$1'$2"),
        (rf"([^{ALPHA}])[']([^{ALPHA}])", "$1 ' $2"), (rf"([^{ALPHA}{NUMERIC}])[']([{ALPHA}])", "$1 ' $2"), (rf"([{ALPHA}])[']([^{ALPHA}])", "$1 ' $2"), (rf"([{ALPHA}])[']([{ALPHA}])", "$1 '$2"), (rf"([{NUMERIC}])[']([s])", "$1 '$2"),
    ],
    "fr": [(rf"([^{ALPHA}])[']([^{ALPHA}])", "$1 ' $2"), (rf"([^{ALPHA}])[']([{ALPHA}])", "$1 ' $2"), (rf"([{ALPHA}])[']([^{ALPHA}])", "$1 ' $2"), (rf"([{ALPHA}])[']([{ALPHA}])", "$1' $2")],
}

LETTERS = [chr(65 + i) for i in range(26)]
#: Abbreviations after which a full stop ends no sentence, by language.
ABBREVIATIONS = {
    "en": LETTERS + "Adj Adm Adv Asst Bart Bldg Brig Bros Capt Cmdr Col Comdr Con Corp Cpl DR Dr Drs Ens Gen Gov Hon Hr Hosp Insp Lt MM MR MRS MS Maj Messrs Mlle Mme Mr Mrs Ms Msgr Op Ord Pfc Ph Prof Pvt Rep Reps Res Rev Rt Sen Sens Sfc Sgt Sr St Supt Surg v vs i.e rev e.g".split(),
    "de": LETTERS + [x.lower() for x in LETTERS] + "I II III IV V VI VII VIII IX X XI XII XIII XIV XV XVI XVII XVIII XIX XX i ii iii iv v vi vii viii ix x Adj Adm Adv Art Asst Bart Bldg Brig Bros Capt Cmdr Col Comdr Con Corp Cpl DR Dr Ens Gen Gov Hon Hosp Insp Lt MM MR MRS MS Maj Messrs Mlle Mme Mr Mrs Ms Msgr Op Ord Pfc Ph Prof Pvt Rep Reps Res Rev Rt Sen Sens Sfc Sgt Sr St Supt Surg Mio Mrd bzw v vs usw d.h z.B u.a etc Mrd MwSt ggf d.J D.h m.E vgl I.F z.T sogen ff u.E g.U g.g.A c.-à-d Buchst u.s.w sog u.ä Std evtl Zt Chr u.U o.ä Ltd b.A z.Zt spp sen SA k.o jun i.H.v dgl dergl Co zzt usf s.p.a Dkr Corp bzgl BSE No Nos Art Nr pp ca Ca".split(),
    "fr": LETTERS + "A.C.N A.M art ann apr av auj lib B.P boul ca c.-à-d cf ch.-l chap contr C.P.I C.Q.F.D C.N C.N.S C.S dir éd e.g env al etc E.V ex fasc fém fig fr hab ibid id i.e inf LL.AA LL.AA.II LL.AA.RR LL.AA.SS L.D LL.EE LL.MM LL.MM.II.RR loc.cit masc MM ms N.B N.D.A N.D.L.R N.D.T n/réf NN.SS N.S N.D N.P.A.I p.c.c pl pp p.ex p.j P.S R.A.S R.-V R.P R.I.P SS S.S S.A S.A.I S.A.R S.A.S S.E sec sect sing S.M S.M.I.R sq sqq suiv sup suppl tél T.S.V.P vb vol vs X.O Z.I".split(),
    "es": LETTERS + "A.C Apdo Av Bco CC.AA Da Dep Dn Dr Dra EE.UU Excmo FF.CC Fil Gral J.C Let Lic N.B P.D P.V.P Prof Pts Rte S.A S.A.R S.E S.L S.R.C Sr Sra Srta Sta Sto T.V.E Tel Ud Uds V.B V.E Vd Vds a/c adj admón afmo apdo av c c.f c.g cap cm cta dcha doc ej entlo esq etc f.c gr grs izq kg km mg mm núm p p.a p.ej ptas pág págs q.e.g.e q.e.s.m s s.s.s vid vol".split(),
}
#: Those that count only before a number.
BEFORE_NUMBERS = {"en": ["No", "Nos", "Art", "Nr", "pp"]}

#: What is escaped, in order.
ESCAPES = [("&", "&amp;"), ("|", "&#124;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&apos;"), ('"', "&quot;"), ("[", "&#91;"), ("]", "&#93;")]

#: Fixed value: ASCII punctuation.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _replaced(x: Column, rules) -> Column:
    return reduce(lambda c, r: F.regexp_replace(c, r[0], r[1]), rules, x)


PLAIN = r"^[\p{L}\p{M}0-9 .,!?\-]*+\z"


def normalize_punctuation(x: Column, lang: str) -> Column:
    rules = [*SPACING, *UNICODE, *GUILLEMETS, *PSEUDO_SPACES, *QUOTE_COMMA.get(lang, []), *NUMBERS.get(lang, POINT)]
    # Of letters, digits and these marks alone no rule changes anything but runs of spaces.
    return let(x, lambda y: F.trim(F.when(y.rlike(PLAIN), F.regexp_replace(y, " +", " ")).otherwise(_replaced(y, rules))))


def escape(x: Column) -> Column:
    return reduce(lambda c, r: F.replace(c, F.lit(r[0]), F.lit(r[1])), ESCAPES, x)


def unescape(x: Column) -> Column:
    return reduce(lambda c, r: F.replace(c, F.lit(r[1]), F.lit(r[0])), [*ESCAPES[1:], ESCAPES[0]], x)


def words(x: Column) -> Column:
    """Cut at white space; none of an empty text."""
    return F.filter(F.split(x, r"(?U)\s+"), lambda w: w != "")


def full_stops(x: Column, lang: str) -> Column:
    """Sets a word's last full stop apart, unless the word is an abbreviation or holds another full stop, or the next begins in lower case."""
    never, numeric = ABBREVIATIONS.get(lang, ABBREVIATIONS["en"]), BEFORE_NUMBERS.get(lang, [])

    def one(ws):
        def stop(w, i):
            prefix, after = F.substring(w, F.lit(1), F.length(w) - 1), F.coalesce(F.get(ws, i + 1), F.lit(""))
            stays = (F.contains(prefix, F.lit(".")) & prefix.rlike(f"[{ALPHA}]")) | prefix.isin(never) | after.rlike(r"^\p{Ll}")
            stays = stays | (prefix.isin(numeric) & after.rlike("^[0-9]")) if numeric else stays
            return F.when(~w.endswith(".") | (F.length(w) < 2) | stays, w).otherwise(F.concat(prefix, F.lit(" .")))

        return F.transform(ws, stop)

    return F.array_join(let(words(x), one), " ")


def tokenize(x: Column, lang: str, protected: list[str] | None = None) -> Column:
    """Tokens, escaped for markup. What a protected pattern matches is never cut but at white space."""
    held = "|".join(f"(?:{p})" for p in protected or [])
    text = F.regexp_replace(F.regexp_replace(x, r"(?U)\s+", " "), r"[\x00-\x1f]", "")

    def rules(y):
        if held:
            y = F.regexp_replace(y, held, HELD)
        y = F.regexp_replace(F.trim(y), rf"([^{ALNUM}\s.'`,\-{HELD}])", " $1 ")
        y = F.regexp_replace(F.regexp_replace(y, r"\.(?=\.)|(?<=\.)\.", DOT), f"({DOT}+)", " $1 ")
        y = _replaced(y, [(rf"([^{NUMERIC}])[,]", "$1 , "), (rf"[,]([^{NUMERIC}])", " , $1"), (rf"([{NUMERIC}])[,]$", "$1 , "), *APOSTROPHES.get(lang, [])])
        y = F.trim(F.regexp_replace(full_stops(F.trim(F.regexp_replace(y, " +", " ")), lang), " +", " "))
        return F.replace(F.regexp_replace(y, r"\.' ?$", " . ' "), F.lit(DOT), F.lit("."))

    if not held:
        return words(escape(rules(text)))
    # Protected texts go back in the order in which they stood.
    back = lambda t: F.array_join(F.zip_with(F.split(rules(t), HELD), F.regexp_extract_all(t, F.lit(f"({held})"), F.lit(1)), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return words(escape(let(text, back)))


def detokenize(tokens: Column, lang: str) -> Column:
    """Tokens put together: opening marks lean right, closing ones left, and a quote opens or closes by how many of its kind stand before it."""

    def step(state, t):
        i, w = t["i"], t["w"]
        quote = F.when(w.rlike("^[„“”]+$"), '"').otherwise(w)
        closing = F.size(F.filter(state["quotes"], lambda q: q == quote)) % 2 == 1
        after, before = F.coalesce(t["after"], F.lit("")), F.coalesce(t["before"], F.lit(""))
        kind = F.when(w.rlike(r"^[\p{Sc}(\[{¿¡]+$"), "open").when(w.rlike(r"^[,.?!:;\\%}\])]+$"), "close")
        if lang == "en":
            kind = kind.when((i > 0) & w.rlike(f"^['][{ALPHA}]"), "close")
        if lang in ("fr", "it", "ga"):
            kind = kind.when(w.rlike(f"[{ALPHA}][']$") & after.rlike(f"^[{ALPHA}]"), "open")
        owned = (w == "'") & (i > 0) & before.endswith("s") if lang == "en" else F.lit(False)
        kind = kind.when(w.rlike("^['\"„“`]+$"), F.when(closing, "end").when(owned, "close").otherwise("begin")).otherwise("word")
        gap = F.lit(" ") if lang == "fr" else F.lit("")

        def done(k):
            lead = F.when(k.isin("open", "begin", "word"), state["space"]).when((k == "close") & w.rlike(r"^[?!:;\\%]$"), gap).otherwise("")
            quotes = F.when(k.isin("begin", "end"), F.array_append(state["quotes"], quote)).otherwise(state["quotes"])
            return F.struct(F.concat(state["text"], lead, w).alias("text"), F.when(k.isin("open", "begin"), "").otherwise(" ").alias("space"), quotes.alias("quotes"))

        return let(kind, done)

    start = F.struct(F.lit("").alias("text"), F.lit(" ").alias("space"), F.array().cast("array<string>").alias("quotes"))
    numbered = lambda ws: F.transform(ws, lambda w, i: F.struct(i.alias("i"), w.alias("w"), F.get(ws, i - 1).alias("before"), F.get(ws, i + 1).alias("after")))
    text = lambda x: F.trim(F.regexp_replace(F.aggregate(let(words(unescape(x)), numbered), start, step, lambda s: s["text"]), " +", " "))
    # Tokens of letters, marks and ASCII digits alone are words, which stand apart from each other: no token need be looked at.
    return let(F.array_join(tokens, " "), lambda x: F.when(x.rlike(r"^[\p{L}\p{M}0-9 ]*$"), F.trim(F.regexp_replace(x, " +", " "))).otherwise(text(x)))


def clean_tokens(x: Column, lang: str, drop: str | None = PUNCTUATION, protected: list[str] | None = None) -> Column:
    """Tokens of the normalised text but for those of dropped characters alone. drop: None keeps all."""
    tokens = tokenize(normalize_punctuation(x, lang), lang, protected)
    return tokens if not drop else F.filter(tokens, lambda w: F.translate(w, drop, "") != "")


def clean_sentence(x: Column, lang: str, drop: str | None = PUNCTUATION, protected: list[str] | None = None) -> Column:
    return detokenize(clean_tokens(x, lang, drop, protected), lang)


def by_language(lang: Column, of, names=("en", "de", "fr", "es")) -> Column:
    """of(name) by the value of a column; other languages and nulls by the rules that belong to none."""
    out = F.when(lang == names[0], of(names[0]))
    for n in names[1:]:
        out = out.when(lang == n, of(n))
    return out.otherwise(of(""))
