"""The training-data operators on small hostile tables, against brute force or SQL."""

import hashlib
import html
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strophe.llm import decontaminate, entries, html_text, licences, minhash, quality_classifier, quality_rules, sentencepiece_tokens, substring_dedup, toxicity, url_filter

from ..conftest import SF

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ok string, score string"


def table(spark, texts, **of):
    """Documents with nulls and columns whose names clash with results."""
    return spark.createDataFrame([(i, t, of.get("lang", "en"), None, 0, "x", "y") for i, t in texts], SCHEMA)


@pytest.mark.parametrize("name", sorted(entries.oracle_sql()))
def test_twin(name, same):
    same(entries.queries()[name], entries.oracle_sql()[name])


HOSTILE = [(1, None), (2, ""), (3, "   \n\t "), (4, "word"), (4, "word"), (5, "a b c d e f g " * 4000), (6, "🎉 ſ é\x00\x0b|"), (7, "x" * 50_000)]


def outputs(spark, docs, labels, bench):
    model = sentencepiece_tokens.read_model()
    yield "rules", quality_rules.quality_rules(docs), docs.count()
    yield "quality", quality_classifier.score_quality(docs, labels), docs.count()
    yield "toxicity", toxicity.score_toxicity(docs, labels), docs.count()
    yield "tokens", sentencepiece_tokens.digest(docs, model), docs.count()
    yield "licences", licences.scan_licences(docs), docs.count()
    yield "leaks", decontaminate.leaks(docs, bench), None
    yield "near", minhash.near_duplicates(docs), docs.count()


def test_hostile_and_empty(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int, text string")
    bench = spark.createDataFrame([(1, None, "z"), (2, "", "z")], "item_id long, text string, h string")
    for docs in (table(spark, HOSTILE), table(spark, [])):
        for name, out, rows in outputs(spark, docs, labels, bench):
            got = out.collect()
            assert rows is None or len(got) == rows, name
    pages = spark.createDataFrame([(1, None, None, "x"), (2, "no scheme", "", "x"), (3, "http://a.com", "<p>a<b>c" * 3000, "x"), (3, "http://a.com", "<p>a<b>c" * 3000, "x")], "page_id long, url string, html string, text string")
    assert html_text.extract_text(pages).count() == 4
    assert html_text.extract_text(pages.limit(0)).count() == 0


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(zip(words, words[1:], words[2:]))
    hit = {p for i, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_rule_counts(spark):
    texts = [*HOSTILE, (8, "a b c a b c d\nx\nx\n \n \n<|>"), (9, "q r s t q r s")]
    got = quality_rules.quality_rules(table(spark, texts)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert sorted(map(tuple, got)) == sorted((i, *counts(t)) for i, t in texts)


def test_rules_reject_outliers(spark):
    rng = random.Random(1)
    plain = [" ".join(rng.choice(["alpha", "be", "gamma", "delta9", "of"]) + str(rng.randrange(999)) for _ in range(80)) for _ in range(150)]
    odd = [" ".join(w + "###" for w in x.split()) for x in plain[:15]]
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(table(spark, list(enumerate(plain + odd)))).collect()}
    assert sum(kept[i] for i in range(150)) == 150
    assert not any(kept[i] for i in range(150, 165))


def test_rules_search_and_cut():
    assert abs(quality_rules.chi_square_cut(0.05) - 12.5916) < 1e-3
    assert abs(quality_rules.chi_square_cut(1e-6) - 38.2583) < 1e-3


def test_rules_judge_rows_not_ids(spark):
    rng = random.Random(4)
    good = lambda: " ".join(rng.choice(["alpha", "be", "gamma", "of"]) + str(rng.randrange(999)) for _ in range(70))
    rows = [(i, good()) for i in range(100)] + [(None, "too short"), (None, good()), (3, "short too"), (3, good())]
    docs = table(spark, rows)
    kept = [(r["doc_id"], r["text"]) for r in quality_rules.stage(spark, docs, SF).collect()]
    assert sorted(kept, key=str) == sorted(((i, t) for i, t in rows if len(t) > 20), key=str)
    assert quality_rules.stage(spark, docs, SF).columns == docs.columns


def test_rules_by_labels(spark):
    d = SF.replace("sf0.001", "sf0.1")
    judged = quality_rules.op1_quality_rules(spark, d).filter("NOT base_failed").join(spark.read.parquet(f"{d}/labels.parquet").distinct(), "doc_id")
    share = {r["quality"]: r["s"] for r in judged.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("s")).collect()}
    assert share[1] > 0.98
    assert share[0] < 0.2


def removed(rows, length=100):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if b[k : k + length] in seen:
                gone[k : k + length] = True
            seen.add(b[k : k + length])
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())
    return out


@pytest.mark.parametrize("most", [20_000, 2])
def test_substrings(spark, most):
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice("ab cdé\n") for _ in range(n))
    shared, line = text(260), text(70)
    rows = [(i, text(rng.randrange(150)) + shared[rng.randrange(60) :] + text(40) + line + text(rng.randrange(90))) for i in range(40)]
    rows += [(50, "ab" * 200), (51, "ab" * 200), (52, None), (53, ""), (54, "z" * 99), (55, "z" * 130), (56, shared), (57, shared[:-1] + "!")]
    rows.append((60, (text(90) + shared) * 9 + text(30_000)))
    out = substring_dedup.removed_digests(table(spark, rows), most=most)
    assert {r[0]: tuple(r[1:]) for r in out.collect()} == removed(rows)


def test_substrings_of_repeated_and_null_ids(spark):
    rng = random.Random(12)
    text = lambda n: "".join(rng.choice("abcdef ") for _ in range(n))
    a, b, c = text(400), text(300), text(150)
    rows = [(5, a), (5, a), (5, b + a), (3, b), (None, c + b), (None, c), (7, None), (7, ""), (-2, a[100:300]), (None, c)]
    key = lambda r: (r[0] is None, r[0] or 0, hashlib.md5((f"{len(r[1].encode())}:{r[1]}" if r[1] is not None else "-").encode()).digest())
    order = sorted(set(rows), key=key)
    want = removed([(i, x) for i, (_, x) in enumerate(order)])
    got = [tuple(r) for r in substring_dedup.removed_digests(table(spark, rows)).collect()]
    assert Counter(got) == Counter((r[0], *want[order.index(r)]) for r in rows)
    left = substring_dedup.stage(spark, table(spark, rows), SF)
    assert left.columns == table(spark, []).columns
    assert left.count() == sum(want[order.index(r)][1] < want[order.index(r)][0] or want[order.index(r)][0] == 0 for r in rows)
    assert substring_dedup.removed_digests(table(spark, [])).count() == 0


def test_run_index_against_suffix_order():
    rng = np.random.default_rng(13)
    for _ in range(20):
        piece = rng.integers(1, 4, int(rng.integers(5, 40)))
        t = np.concatenate([np.concatenate([piece, rng.integers(1, 4, 3), [0]]) for _ in range(8)] + [[0]])
        index, n = substring_dedup.RunIndex(t), len(t)
        assert index.lengths.sum() == n
        assert len(index.sample) == len(index.symbols) < n
        suffixes = sorted(range(n), key=lambda i: t[i:].tolist())
        source, shared = index.matches(np.arange(n))
        for before, i in zip(suffixes, suffixes[1:], strict=False):
            if t[i]:  # zeros end pieces
                k = next((k for k in range(n) if max(i, before) + k >= n or t[i + k] != t[before + k]), 0)
                j = int(source[i])
                assert shared[i] == k
                assert t[j : j + k].tolist() == t[i : i + k].tolist()


def test_near_duplicates(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    base = [[rng.choice(words) for _ in range(120)] for _ in range(30)]
    rows, classes = [], {}
    for i, b in enumerate(base):
        for k in range(4):
            c = list(b)
            for _ in range(k % 3):
                c[rng.randrange(120)] = "changed"
            rows.append((i * 10 + k, " ".join(c)))
            classes[i * 10 + k] = i * 10
    rows += [(1000, "a b"), (1001, "a b"), (1002, "a  b"), (1003, None), (1004, ""), (1005, "")]
    classes |= {1000: 1000, 1001: 1000, 1002: 1000, 1003: 1003, 1004: 1004, 1005: 1005}
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == classes


def brute_classes(texts):
    sets = []
    for t in texts:
        w = t.split()
        sets.append(set(zip(*(w[k:] for k in range(minhash.WIDTH)))))
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= minhash.SIMILARITY * (len(sets[i]) + len(sets[j]) - both) and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return dict(enumerate(label))


def test_template_family_near_the_threshold(spark):
    """Pairs of one template: about 0.82 within a pair and 0.74 across, so that most members of a bucket fail most others."""
    rng, base, texts = random.Random(3), [f"t{i}" for i in range(400)], []
    for i in range(120):
        own = rng.sample(range(5, 395), 10)
        for k, places in enumerate((own[:6], own[:2] + own[6:])):
            w = list(base)
            for x in places:
                w[x] = f"p{i}.{x}" if x in own[:2] else f"q{i}.{k}.{x}"
            texts.append(" ".join(w))
    order = rng.sample(range(240), 240)
    texts = [texts[i] for i in order]
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = brute_classes(texts)
    wrong = [i for i in want if got[i] != want[i]]
    assert not wrong


def chunk(texts):
    raw = [t.encode() for t in texts]
    ends = np.cumsum([len(r) for r in raw])
    return minhash.shingles(np.frombuffer(b"".join(raw), np.uint8), ends - [len(r) for r in raw], ends)


def weighted(a, b):
    x, y = (Counter(zip(*(t.split()[k:] for k in range(minhash.WIDTH)))) for t in (a, b))
    return sum((x & y).values()) / sum((x | y).values())


def test_signatures_estimate_weighted_similarity():
    """Also of texts whose shingles repeat up to hundreds of times."""
    rng = np.random.default_rng(0)
    texts = []
    for k in range(60):
        w = [f"w{x}" for x in rng.integers(0, 5000, 200)]
        c = list(w)
        for x in rng.choice(200, 5, False):
            c[x] = "other"
        if k >= 40:  # the same phrase some times here, more often there
            w, c = w + w[:10] * int(rng.integers(1, 300)), c + w[:10] * int(rng.integers(1, 300))
        texts += [" ".join(w), " ".join(c)]
    e, o, w = chunk(texts)
    assert w.max() > 100
    s = minhash.signatures(e, o, w, len(texts), 80)
    for part in (range(0, 80, 2), range(80, 120, 2)):
        error = [(s[i] == s[i + 1]).mean() - weighted(texts[i], texts[i + 1]) for i in part]
        assert abs(np.mean(error)) < 0.025
        assert np.std(error) < 0.08


def test_a_chain_of_near_pairs(spark):
    """Each text is near to the next one only, so that one missed pair would cut the class in two."""
    rng = random.Random(5)
    base, texts = [f"t{i}" for i in range(220)], []
    for i in range(300):
        texts.append(" ".join(base))
        base[(i * 37) % 220] = f"new{i}"
        for _ in range(3):
            base[rng.randrange(220)] = f"more{i}.{rng.random()}"
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == brute_classes(texts)


def test_near_duplicates_of_repeated_and_null_ids(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(60)) for c in "abc")
    rows = [(7, one), (7, two), (3, two + " x"), (None, three), (None, three + " y"), (None, one), (9, None), (9, None), (9, ""), (5, one), (5, one)]
    docs = table(spark, rows)
    got = sorted(((r["doc_id"], r["class_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(7, 5, False), (7, 3, False), (3, 3, True), (None, None, got_three := got_of(docs, three)), (None, None, not got_three), (None, 5, False), (9, 9, True), (9, 9, True), (9, 9, True), (5, 5, True), (5, 5, True)], key=str)
    left = sorted(((r["doc_id"], r["text"]) for r in minhash.stage(spark, docs, SF).collect()), key=str)
    assert [x for x in left if x[0] is not None] == sorted([(3, two + " x"), (5, one), (9, ""), (9, None)], key=str)
    assert len([x for x in left if x[0] is None]) == 1
    assert minhash.stage(spark, docs, SF).columns == docs.columns


def got_of(docs, text):
    copy = hashlib.sha256(text.encode()).digest()[:16]
    return [r["kept"] for r in minhash.near_duplicates(docs).collect() if r["doc_id"] is None and bytes(r["copy"]) == copy][0]


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101)], "a long, b long")
    got = {r[0]: r[1] for r in minhash.components(links, minhash.Scratch(spark, "test")).collect()}
    assert got == {**dict.fromkeys(range(31), 0), 100: 100, 101: 100}


def test_leaks(spark):
    q = "If John Miller has 12 apples and Mary gives him 5 kg of pears, how many apples has John after he sells 3 of them to Anna at the market?"
    other = q.replace("John Miller", "Karl Brown").replace("John", "Karl").replace("Mary", "Susan").replace("12", "15").replace("5 kg", "7 kg")
    docs = [(1, f"Before it. {q} After it."), (2, f"Before it. {other}"), (3, other.replace("has Karl", "has Peter")), (4, "Nothing of that kind stands here at all today."), (5, None)]
    bench = spark.createDataFrame([(7, q), (8, None), (9, "")], "item_id long, text string")
    got = decontaminate.leaks(table(spark, docs), bench).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(1, 7), (2, 7)]


def test_leaks_of_other_forms(spark):
    """What single alignments, sentence starts, names of several words and inconsistent neighbours used to hide."""
    long = "the quick merchant from the old harbour sells forty barrels of red wine to every captain who pays before the next tide comes in and nobody asks him where it was pressed"
    words = long.split()
    apples = "Mary has 3 apples. Mary gives Tom 2."
    bench = [(1, "Maria bought 7 red pens for school."), (2, long), (3, apples), (4, "Ann Lee met 3 men near the old mill and told Bob Ray about the 5 days there."), (5, "1, 2, 3, 4, 5, 6, 7, 8, 9"), (6, "Zoe 5")]
    docs = [
        (1, "Today. Helen bought 9 red pens for school."),
        (2, "x " + " ".join(words[:15] + ["inserted"] + words[15:])),
        (3, "So Ruth has 8 apples. Ruth gives Paul 4. End"),
        (4, "then Kim met 7 men near the old mill and told Joe about the 9 days there."),
        (5, "Ruth has 8 apples. Anna gives Paul 4. And " + apples),  # an inconsistent copy before an exact one
        (6, "Ruth has 8 apples. Anna gives Paul 4."),
        (7, "4, 8, 15, 16, 23, 42, 1, 2, 99, 3, 5, 8"),
        (8, "see 1, 2, 3, 4, 5, 6, 7, 8, 9"),
        (9, "Kim 7 and so on"),
        (None, "Helen bought 9 red pens for school."),
        (10, None), (10, "Helen bought 9 red pens for school."), (10, "clean words only here"), (10, "clean words only here"),
    ]
    b = spark.createDataFrame([(i, x, "h") for i, x in bench], "item_id long, text string, windows string")
    for most in (500_000, 0):
        got = sorted(((r["doc_id"], r["item_id"]) for r in decontaminate.leaks(table(spark, docs), b, most=most).collect()), key=str)
        assert got == sorted([(1, 1), (2, 2), (3, 3), (4, 4), (5, 3), (8, 5), (None, 1), (10, 1)], key=str)


def templates(text):
    """Tokens and values, without Spark."""
    import regex

    raw = regex.findall(r"[0-9]+(?:[.,][0-9]+)*|\p{Lu}\p{Ll}++(?![\p{L}\p{M}])(?: \p{Lu}\p{Ll}++(?![\p{L}\p{M}]))*|[\p{L}\p{M}]+|[%$€£]", text or "")
    kind = []
    for i, x in enumerate(raw):
        unit = i and raw[i - 1][0].isdigit() and x.lower() in decontaminate.UNITS
        kind.append("#" if x[0].isdigit() else "u" if unit else "N" if x[0].isupper() and x[1:2].islower() else x.lower())
    return [x.lower() for x in raw], kind


def agree(p, q):
    """Two slots (kind, value in the item, set of words in the document, value in the document) can stand side by side."""
    common = lambda x, y: bool(set(x.split(" ")) & set(y.split(" ")))
    if p[0] != q[0]:
        return True
    if p[1] == q[1]:
        return p[2] == q[2] or common(p[2], q[2])
    return p[2] != q[2] or p[0] == "u" or common(p[1], q[1])


def brute_leak(doc, item):
    """From the definition: some chain of whole runs (or of windows that agree word for word), forward in both texts, is enough and consistent. All chains are tried."""
    (dv, dk), (bv, bk) = templates(doc), templates(item)
    if not bv:
        return False
    w = min(8, len(bk))
    total, hits = len(bk) - w + 1, set()
    places = {}
    for i in range(len(dk) - w + 1):
        places.setdefault(tuple(dk[i : i + w]), []).append(i)
    words = {}
    for i in range(len(dv) - w + 1):
        words.setdefault(tuple(dv[i : i + w]), []).append(i)
    for j in range(total):
        literal = sum(k not in ("#", "u", "N") for k in bk[j : j + w])
        hits |= {(i, j) for i in (places.get(tuple(bk[j : j + w]), []) if literal >= min(3, w) else words.get(tuple(bv[j : j + w]), []))}
    if len({j for _, j in hits}) < min(0.5 * total, 24):
        return False
    # word for word: the longest chain, by trying each window after all before it
    best = {}
    for i, j in sorted(h for h in hits if dv[h[0] : h[0] + w] == bv[h[1] : h[1] + w]):
        best[i, j] = 1 + max((n for (a, b), n in best.items() if a < i and b < j), default=0)
    most = max(best.values(), default=0)
    runs = []
    for i, j in sorted(hits):
        if (i - 1, j - 1) not in hits:
            n = 1
            while (i + n, j + n) in hits:
                n += 1
            slots = set()
            for k in range(n + w - 1):
                if bk[j + k] in ("#", "u", "N"):
                    b, d = bv[j + k], dv[i + k]
                    slots |= {(bk[j + k], x, y) for x, y in (zip(b.split(" "), d.split(" "), strict=True) if bk[j + k] == "N" and len(b.split(" ")) == len(d.split(" ")) else [(b, d)])}
            if all(agree(p, q) for p in slots for q in slots):
                runs.append((i, j, n, slots))

    def longest(k, i, j, n, slots):
        out = n
        for m in range(k, len(runs)):
            a, b, size, own = runs[m]
            gain = size - max(0, j + 1 - b, i + 1 - a)
            if gain > 0 and all(agree(p, q) for p in slots for q in own):
                out = max(out, longest(m + 1, a + size - 1, b + size - 1, n + gain, slots | own))
        return out

    most = max(most, longest(0, -1, -1, 0, set()))
    return most >= 0.5 * total or most >= 24


def test_leaks_of_repeating_frames(spark):
    """Frames that repeat within an item: each run is found among its shifted likenesses, and slots are one to one."""
    apples = "Tom has 3 apples. Ann has 4 apples. Bob has 5 apples. Who has the most apples?"
    pears = "Mary gives Lucy 3 pears and Mary thanks her friend for the pears that she can eat now"
    bench = [(1, apples), (2, "Tom has 3 apples. Tom has 3 apples. Tom has 3 apples. Who has the most apples?"), (3, pears)]
    gap = " ".join(f"word{i}" for i in range(300))
    docs = [
        (1, apples), (2, "See: " + apples.replace("Tom", "Eve").replace("3", "9") + " Yes."), (3, apples.replace("Bob", "Tom")),  # two of the item's names for one of the document
        (4, "Tom has 3 apples. Ann has 4 apples. " + gap + " Bob has 5 apples. Who has the most apples?"),
        (5, "Tom has 3 apples. " * 3 + "Who has the most apples?"), (6, "Anna gives Anna 3 pears and Anna thanks her friend for the pears that she can eat now"),
        (7, "Anna gives Vera 3 pears and Anna thanks her friend for the pears that she can eat now"), (8, "Anna gives Vera 3 pears and Vera thanks her friend for the pears that she can eat now"),
        (9, ("Kim has 7 apples. Kim has 8 apples. " * 40)), (10, pears.replace("friend for", f"friend {gap} for")), (11, pears.replace("Mary", "Ida").replace("friend for", f"friend {gap} for")),
    ]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(table(spark, docs), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert got == {(i, k) for i, x in docs for k, y in bench if brute_leak(x, y)}
    assert {(1, 1), (2, 1), (5, 2), (7, 3)} <= got
    assert not {(3, 1), (6, 3), (8, 3)} & got


def test_leaks_against_brute_force(spark):
    """Whole test table, with re-parameterised items added: no leak missed, none invented."""
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rng = random.Random(6)
    frames = [f"{a} Smith paid {n} dollars for {m} kg of rice, and {a} said that the {w} would last {n} days for the whole family" for a, n, m, w in (("John", 12, 5, "bag"), ("Vera", 9, 30, "sack"))]
    bench += [(1000 + k, x) for k, x in enumerate(frames)]
    for k in range(40):
        x = frames[k % 2].replace("John", "Karl").replace("Vera", "Ida").replace("12", str(rng.randrange(20, 90)))
        x = x if k % 3 else x.replace("said", "said twice", 1)
        docs.append((5000 + k, "Some words before. " + (x if k % 5 else x.replace("Karl said", "Emil said").replace("Ida said", "Eva said")) + " More words."))
    docs += [(6000 + k, " ".join(x.split(" ")[: 8 + k % 9] + ["some inserted words"] * (k % 40) + x.split(" ")[8 + k % 9 :])) for k, x in bench[:30]]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(table(spark, docs), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    want = {(i, k) for i, x in docs for k, y in bench if brute_leak(x, y)}
    assert got == want
    assert {i for i, _ in want if 5000 <= i < 6000} == {5000 + k for k in range(40) if k % 5}
    assert {(i, k) for i, x in docs for k, y in bench if y in (x or "")} <= got


def test_tokens():
    import sentencepiece

    model = sentencepiece_tokens.read_model()
    judge, c = sentencepiece.SentencePieceProcessor(model_proto=model), sentencepiece_tokens.Codec(model)
    texts = ["", " ", "  a  b ", "▁x y", "\n\ttab", "日本語 🎉 ￿", "<s> <0x41> <unk>", " " * 40 + "x", "a" * 3000, "naïve café, 12.5 % of it!", "x▁ ▁▁"]
    got = c.encode(texts)
    assert [list(x) for x in got] == [judge.encode(x) for x in texts]
    assert [c.decode(x) for x in got] == [c.rebuilt(x) for x in got] == [x.replace("▁", " ") for x in texts]
    whole = sentencepiece_tokens.build(model)
    assert [whole.encode(x, add_special_tokens=False).ids for x in texts] == [judge.encode(x) for x in texts]


def message(*fields):
    """A protobuf message of (number, value): bytes, floats and small integers."""
    import struct

    out = b""
    for k, v in fields:
        if isinstance(v, float):
            out += bytes([k << 3 | 5]) + struct.pack("<f", v)
        elif isinstance(v, int):
            out += bytes([k << 3, v])
        else:
            n = len(v)
            out += bytes([k << 3 | 2]) + (bytes([n]) if n < 128 else bytes([n & 127 | 128, n >> 7])) + v
    return out


def unigram_model(prefix=1, collapse=0):
    """A unigram model with byte fallback, written by hand (nothing is trained): words, letters and pieces that compete by score."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)]
    normal = {"▁": -3.0, "▁the": -2.0, "the": -4.0, "re": -3.5, "▁there": -6.5, "here": -4.5, "▁t": -4.0, "h": -5.0, "e": -4.9, "r": -5.1, "a": -5.2, "b": -5.3, "ab": -6.0, "ba": -5.9, "aba": -9.0, "é": -6.0, "日": -7.0, ".": -4.0, "▁a": -4.2}
    pieces += [(p, s, 1) for p, s in normal.items()]
    # the trainer's part says unigram, and (its field 35) byte fallback
    body = b"".join(message((1, message((1, p.encode()), (2, s), (3, k)))) for p, s, k in pieces)
    return body + message((2, message((3, 1)) + b"\x98\x02\x01")) + message((3, message((1, b"identity"), (3, prefix), (4, collapse), (5, 1))))


def test_unigram_tokens(spark):
    import sentencepiece

    texts = ["", "the there here", "ab aba abab ba", "日本 é the", "  the  re ", "theretherethere", "🎉 x\x00", "a" * 500, "the\nthere"]
    for prefix, collapse in ((1, 0), (0, 0)):
        model = unigram_model(prefix, collapse)
        judge, c = sentencepiece.SentencePieceProcessor(model_proto=model), sentencepiece_tokens.Codec(model)
        assert sentencepiece_tokens.parse_model(model)["kind"] == 1
        assert [list(x) for x in c.encode(texts)] == [judge.encode(x) for x in texts]
        assert [c.decode(x) for x in c.encode(texts)] == [c.rebuilt(x) for x in c.encode(texts)] == texts
    got = sentencepiece_tokens.encode(table(spark, list(enumerate(texts))), unigram_model(), check_every=1).collect()
    assert {r["doc_id"]: r["decoded"] for r in got} == dict(enumerate(texts))


def test_html():
    page = html_text.Page
    assert page('<body><header>Top</header><nav>x<ul><li>a</ul></nav><article><h1>T &amp; U</h1><p><b>one<br><p>two &nbsp; <i>th</i>ree<aside>zz</aside><ul><li>a<li>b</ul></article><section class="comments">c</section><footer>f').text() == "T & U one two three a b"
    assert page('<div id=x><p>Hello <b>w</b>orld</p><div class="ad">buy</div><!-- x --> tail<script>if(a<b){}</p></script>').text() == "Hello world tail"
    assert page("<p>" * 5000 + "deep").text() == "deep"


def test_html_removes_what_all_pages_share(spark):
    rows = [(i, f"http://h.com/{i}", f"<body><div class=x1><p>Same line on every page</p></div><div class=x2><p>Own words number {i}</p></div>") for i in range(12)]
    got = html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["text"] for r in got} == {f"Own words number {i}" for i in range(12)}


def test_html_keeps_copies_of_one_page(spark):
    page = "<body><div class=x1><p>Only words</p><p>of this page</p></div>"
    rows = [(i, f"http://h.com/{i}", page) for i in range(12)] + [(12, "http://one.com/", "<body>" + "<p>again</p>" * 9)]
    got = html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert Counter(r["text"] for r in got) == {"Only words of this page": 12, " ".join(["again"] * 9): 1}


def test_html_forms():
    page = html_text.Page
    assert page("<article><p class=\"share-price\">Up <b>3</b></p><p class=it's>One</p><p>Two's</p><p title='a > b'>Three</p></article>").text() == "Up 3 One Two's Three"
    assert page("<article><p>A long story of many words stands here.</p></article><article class=card><p>Teaser</p></article>").text() == "A long story of many words stands here."
    assert page("<main><p>" + "The story is here. " * 9 + "</p><article class=card>Teaser</article></main>").text() == ("The story is here. " * 9 + "Teaser")
    assert page('<div class="site-footer">x</div><div class="cookie-notice">y</div><div id="related-posts">z</div><p class="comment">c</p><p>text</p>').text() == "text"
    assert page("<p>a" + "=\"" * 20_000 + "<p " + "x='y' " * 20_000).text().startswith("a=")
    inside = lambda x: page(f"<article><p>Own words of the story.</p>{x}</article>").text().removeprefix("Own words of the story.").strip()
    assert inside('<div class="user-comment">first!</div><div class="email-signup">Sign up</div><div class="reader-comments"><p>well</p></div>') == ""
    assert inside('<p class="social-policy">Policy words.</p><p class="related">Related by marriage.</p>') == "Policy words. Related by marriage."
    assert inside('<div class="social-links">On <a href=x>one site</a> <a href=y>other</a></div><div class="share"><button>Share</button> this</div><ul class=related><li><a href=z>More</a></ul>') == ""
    assert page('<p class="social-links">Follow</p><p>text</p>').text() == "text"
    assert page("<article><p hidden>no</p><p class=hidden-gem>yes</p></article>").text() == "yes"


def host_pages(rng, host, n, shared):
    word = lambda k: " ".join(f"w{rng.randrange(900)}" for _ in range(k))
    for i in range(n):
        own = [f"<p>{word(12)}</p>" for _ in range(3)]
        yield f"http://{host}/{i}", f"<body><ul class=list>{shared[0]}</ul><article><h1>{word(4)}</h1>{own[0]}{shared[1]}{own[1]}{own[2]}{shared[2]}</article></body>", own


def test_html_tree_decides(spark):
    """Blocks inside the article that most pages of the host share go, by the tree alone; what a third shares stays, and other hosts keep all."""
    rng = random.Random(9)
    shared = ("<li>Home</li><li>News</li>", "<p>Read our paper every day for more</p>", "<div><p>About the author</p><p>She writes here</p></div>")
    many, few = list(host_pages(rng, "many.org", 20, shared)), list(host_pages(rng, "few.org", 4, shared))
    third = [(u, h.replace("</article>", "<p>Stands on some pages</p></article>") if i % 3 == 0 else h, o) for i, (u, h, o) in enumerate(many)]
    rows = [(i, u, h) for i, (u, h, _) in enumerate(third + few)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    with_tree, without = ({r["page_id"]: r["text"] for r in html_text.extract_text(pages, least=k).collect()} for k in (6, 10**6))
    assert all(with_tree[i] != without[i] for i in range(20))
    for i in range(20):
        assert not any(x in with_tree[i] for x in ("Read our paper", "About the author", "She writes"))
        assert ("Stands on some pages" in with_tree[i]) == (i % 3 == 0)
        assert all(re.sub("<[^>]*>", "", o) in with_tree[i] for o in third[i][2])
    assert all(with_tree[i] == without[i] and "Read our paper" in with_tree[i] for i in range(20, 24))


def test_html_keeps_near_copies(spark):
    """Pages of one article with other lines around it are one page to the tree."""
    rng = random.Random(10)
    (_, html_, _), *others = host_pages(rng, "copies.org", 9, ("", "", ""))
    rows = [(i, f"http://copies.org/c{i}", html_.replace("<article>", f"<p class=ad>buy {i}</p><article>").replace("</article>", f"<p>edit {i}</p></article>")) for i in range(30)]
    rows += [(100 + i, u, h) for i, (u, h, _) in enumerate(others)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got, plain = ({r["page_id"]: r["text"] for r in html_text.extract_text(pages, least=k).collect()} for k in (6, 10**6))
    assert got == plain


def test_html_against_brute_force(spark):
    """The tree by plain counting over each host, on all pages of the test table and some of shared blocks."""
    import math

    rng = random.Random(11)
    rows = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{SF.replace('0.001', '0.01')}/pages.parquet").collect()]
    rows += [(10_000 + i, u, h) for i, (u, h, _) in enumerate(host_pages(rng, "many.org", 15, ("<li>a", "<p>often</p>", "<p>said again</p>")))]
    by_host = {}
    for i, u, h in rows:
        by_host.setdefault(u.split("://")[1].split("/")[0].split("?")[0].split("#")[0].lower(), []).append((i, html_text.Page(h)))
    want, changed = {}, 0
    for pages in by_host.values():
        distinct = {p.identity() for _, p in pages}
        m, at, styles = len(distinct), {}, {}
        for _, p in pages:
            for _, path, style, node in p.nodes():
                at.setdefault((path, node), set()).add(p.identity())
                styles.setdefault(path, {}).setdefault(style, set()).add(p.identity())
        drop = set()
        for (path, node), ks in at.items():
            if m >= 6 and len(ks) >= 6 and 2 * len(ks) >= m:
                n = [len(x) for x in styles[path].values()]
                look = -sum(x / sum(n) * math.log(x / sum(n)) for x in n) / math.log(m) if len(n) > 1 else 0
                if (1 - 0.9 ** len(n)) * look + 0.9 ** len(n) * (1 - math.log(len(ks)) / math.log(m)) < 0.3:
                    drop.add(node)
        for i, p in pages:
            want[i] = p.text(frozenset(drop))
            changed += want[i] != p.text()
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want
    assert changed >= 15


def test_html_keeps_articles(spark):
    for r in spark.read.parquet(f"{SF}/pages.parquet").join(html_text.op3_html_text(spark, SF).select("page_id", "text"), "page_id").collect():
        inside = re.search(r"(?s)<article>(.*?)(?:</article>|$)", r["html"])[1]
        assert r["text"] == " ".join(html.unescape(re.sub("<[^>]*>", " ", inside)).split())


def test_urls(spark):
    urls = ["http://a.COM/en/x", "https://example.com/en/7", "http://x.net/de/1?q", "http://sub.example.net/de/8#t", "ftp://org/es/", "http://example.comx/en/", "http://example.com", None, "nothing"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    listed = spark.createDataFrame([(h + p, v, True) for v, h, p in url_filter.RULES], "key string, verdict string, is_rule boolean")
    got = [tuple(r)[3::2] for r in url_filter.judge_urls(pages, listed).orderBy("page_id").collect()]
    assert got == [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow")]


def test_urls_of_a_long_list(spark):
    """More than a thousand lengths of listed paths, repeated and null rows, very long urls, clashing columns; and no list at all."""
    keys = [(f"h{n % 7}.org/" + "p" * n, "block", True) for n in range(1, 1102)]
    urls = ["http://h%d.org/%s" % (n % 7, "p" * n) for n in (1, 2, 700, 1101)] + ["http://sub.h2.org/" + "p" * 9, "http://h1.org/" + "p" * 50_000, None, "http://h3.org"]
    rows = [(i, u, "key", "verdict") for i, u in enumerate(urls)] * 2 + [(None, "http://h1.org/p", "x", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string, host string")
    got = url_filter.judge_urls(pages, spark.createDataFrame(keys, "key string, verdict string, is_rule boolean")).collect()
    assert len(got) == len(rows)
    rule = {r["page_id"]: len(r["rule"]) - 7 if r["rule"] else None for r in got}
    assert rule == {0: 1, 1: 2, 2: 700, 3: 1101, 4: 9, 5: max(n for n in range(1, 1102) if n % 7 == 1), 6: None, 7: None, None: 1}
    assert {r["verdict"] for r in got if r["page_id"] in (6, 7)} == {"allow"}
    none = url_filter.judge_urls(pages, spark.createDataFrame([], "key string, verdict string, is_rule boolean")).collect()
    assert {(r["rule"], r["verdict"]) for r in none} == {(None, "allow")}
    assert len(none) == len(rows)
    assert url_filter.judge_urls(pages.limit(0), spark.createDataFrame(keys, "key string, verdict string, is_rule boolean")).count() == 0


def test_urls_in_canonical_form_and_long_ones(spark):
    import time

    listed = spark.createDataFrame([("spam.example.org/", "block", False), ("net/de/", "allow", True)], "key string, verdict string, is_rule boolean")
    urls = ["http://spam.example.org:8080/x", "https://me@a.spam.example.org./x", "http://spam.example.org:80", "http://user:pw@spam.example.org/", "http://xspam.example.org/", "http://b.net:80/de/1", "http://b.net/de/1"]
    urls += ["http://" + "a." * 40_000 + "spam.example.org/", "http://" + "a." * 40_000 + "org/", "http://spam.example.org/" + "y" * 500_000]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    began = time.time()
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(pages, listed).select("page_id", "verdict").collect()}
    assert [got[i] for i in range(len(urls))] == ["block"] * 4 + ["allow"] * 3 + ["block", "allow", "block"]
    assert time.time() - began < 60


def test_bloom_passes_all_listed(spark):
    keys = spark.range(3000).select(F.concat(F.lit("host/"), "id").alias("key"))
    bloom, blocks = url_filter.build_bloom(keys, 1 << 16)
    assert len(bloom) == blocks * 64 <= (1 << 16) // 8
    assert keys.filter(~url_filter.maybe(F.col("key"), bloom, blocks)).isEmpty()
    assert keys.select(F.concat("key", F.lit("x")).alias("key")).filter(url_filter.maybe(F.col("key"), bloom, blocks)).count() < 600


MIT = """# Copyright (c) 2020 Some One
#
# Permission is hereby granted, free of charge, to any person obtaining a copy
# of this software and associated documentation files (the "Software"), to deal
# in the Software without restriction, including without limitation the rights
# to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
# copies of the Software, and to permit persons to whom the Software is
# furnished to do so, subject to the following conditions:
#
# The above copyright notice and this permission notice shall be included in all
# copies or substantial portions of the Software.
"""
APACHE = """   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0
"""
GPL = """/* This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 * GNU General Public License for more details. */
"""
BSD = """Copyright 1999 X. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
"""


def test_licence_rules(spark):
    mit = licences.SENTENCES["mit-grant"].capitalize() + ". " + licences.SENTENCES["mit-notice"].capitalize() + "."
    docs = [
        (1, f"Text.\n{mit}"), (2, "All rights reserved.\nLicensed under the Apache License, Version 2.0."), (3, "no licence"), (4, None), (5, MIT), (6, APACHE), (7, GPL), (8, BSD),
        (9, "(c) me, Released under the MIT License."), (10, "All rights" + " " * 5000 + "reserved."), (11, "-" * 9000 + "All rights reserved" + "-" * 9000), (12, "code\n" * 300 + MIT + "more\n" * 300 + APACHE), (13, "\n".join(GPL.split())),
    ]
    got = {r["doc_id"]: r["licences"] for r in licences.scan_licences(table(spark, docs)).collect()}
    want = {1: ["MIT"], 2: ["Apache-2.0", "all-rights-reserved"], 3: [], 4: [], 5: ["MIT"], 6: ["Apache-2.0"], 7: ["GPL-3.0-or-later"], 8: ["BSD"], 9: ["MIT"], 10: ["all-rights-reserved"], 11: ["all-rights-reserved"], 12: ["MIT", "Apache-2.0"], 13: ["GPL-3.0-or-later"]}
    assert got == want


def test_notices_of_other_licences(spark):
    gpl2, library = GPL.replace("version 3", "version 2"), GPL.replace("program", "library").replace("GNU General", "GNU Lesser General").replace("version 3", "version 2.1")
    mpl = "// This Source Code Form is subject to the terms of the Mozilla Public\n// License, v. 2.0. If a copy of the MPL was not distributed with this\n// file, You can obtain one at http://mozilla.org/MPL/2.0/."
    isc = "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies."
    clauses = [licences.SENTENCES[k] for k in ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")]
    docs = [
        (1, gpl2), (2, library), (3, mpl), (4, isc), (5, "This project is licensed under the MIT License."), (6, "# SPDX-License-Identifier: Apache-2.0\ncode"), (7, ".\n* ".join(clauses)), (8, ". ".join(clauses[:3])),
        (9, "This software is released under the\nMozilla Public License, version 2.0; see there."), (10, "This project is licensed under the moon."),
    ]
    got = {r["doc_id"]: r["licences"] for r in licences.scan_licences(table(spark, docs)).collect()}
    assert got == {1: ["GPL-2.0-or-later"], 2: ["LGPL-2.1-or-later"], 3: ["MPL-2.0"], 4: ["ISC"], 5: ["MIT"], 6: ["Apache-2.0"], 7: ["BSD-3-Clause"], 8: ["BSD-2-Clause"], 9: ["MPL-2.0"], 10: []}
    import re as plain_re

    assert all(plain_re.search(licences.WORDS, s) for _, s in licences.KNOWN)
    assert len({s for _, s in licences.KNOWN}) == len(licences.KNOWN)
    assert {k for _, ids in licences.RULES for k in ids} == {k for k, _ in licences.KNOWN} | set()


def test_licences_against_sql(spark, duck):
    docs = [(i, x) for i, x in enumerate([MIT, APACHE, GPL, BSD, MIT.replace("\n", "\r\n"), "All rights reserved, all rights reserved.", APACHE + GPL, "", None, "x, licensed under CC BY-SA 4.0. " * 3])]
    frame = table(spark, docs).toPandas()
    duck.register("hostile_documents", frame)
    want = duck.execute(licences.oracle().replace("FROM documents", "FROM hostile_documents")).fetchall()
    got = licences.scan_licences(table(spark, docs)).collect()
    assert sorted((r["doc_id"], len(r["sentence_ids"]), ",".join(r["sentence_ids"]), ",".join(r["licences"])) for r in got) == sorted(want)


def test_licences_of_other_tables(spark):
    rules, sentences = [("own", ["one", "two"])], {"one": "first known words", "two": "second"}
    got = licences.scan_licences(table(spark, [(1, "First\nknown, words. other.\nSecond")]), sentences, rules, "").first()
    assert (got["sentence_ids"], got["licences"]) == (["one", "two"], ["own"])


def area(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


@pytest.mark.parametrize(("name", "label"), [("op2_quality_classifier", "quality"), ("op4_toxicity", "toxic")])
def test_held_out(spark, name, label):
    d = SF.replace("sf0.001", "sf0.1")
    scores = entries.queries()[name](spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert area(scores[label].to_numpy(), scores["score"].to_numpy()) > 0.97
    assert scores["score"].between(0, 1).all()


def test_ridge_and_calibration(spark):
    """Partition sums give the weights of the whole matrix at once; calibrated values rise with the raw score; and the classes that are not there."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, quality_classifier.N)).astype(np.float32)
    y = (x[:, 0] + 0.3 * rng.normal(size=300) > 0).astype(int)
    rows = spark.createDataFrame([(i, bytearray(v.tobytes()), int(k)) for i, (v, k) in enumerate(zip(x, y, strict=True))], "doc_id long, x binary, y int").repartition(7)
    model = quality_classifier.fit(rows, features=32)
    ids = [r["doc_id"] for r in rows.filter("pmod(xxhash64(doc_id, 5), 5) <> 0").collect()]
    z = quality_classifier.cosines(x.astype(float), model["centre"], model["scale"], 32, quality_classifier.WIDTH)
    own = np.linalg.solve(z[ids].T @ z[ids] + np.eye(z.shape[1]), z[ids].T @ y[ids])
    assert np.allclose(model["weight"], own, atol=1e-6)
    assert np.allclose(model["centre"], x.mean(0), atol=1e-5)
    assert (np.diff(model["at"]) > 0).all()
    assert (np.diff(model["value"]) > 0).all()
    scores = quality_classifier.predict(model, x.astype(float))
    assert (np.diff(scores[np.argsort(z @ model["weight"])]) >= -1e-12).all()
    for one_class in (0, 1):
        assert quality_classifier.fit(rows.withColumn("y", F.lit(one_class))) is None
    assert quality_classifier.fit(rows.limit(0)) is None
    assert (quality_classifier.predict(None, x) == 0.5).all()


def test_pooled_is_isotonic():
    """Against the definition: the least squares rising fit, by pooled means over all pairs of ends."""
    rng = np.random.default_rng(3)
    s = np.sort(rng.normal(size=40))
    y = (rng.random(40) < (s > 0) * 0.6 + 0.2).astype(float)
    at, value = quality_classifier.pooled(s, y)
    best = [max(min(y[i : j + 1].mean() for j in range(k, 40)) for i in range(k + 1)) for k in range(40)]
    means = sorted({round(b, 9) for b in best})
    assert len(at) == len(means)
    n = [sum(abs(b - m) < 1e-9 for b in best) for m in means]
    assert np.allclose(value, [(m * k + 0.02) / (k + 0.04) for m, k in zip(means, n, strict=True)])


def test_learning_leaves_held_out_rows_alone(spark):
    """Labels of held-out rows, and labels at odds with them, change no score; nor do language and source."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    turned = labels.withColumns({c: F.when(held, 1 - F.col(c)).otherwise(F.col(c)) for c in ("quality", "toxic")})
    for f in (quality_classifier.score_quality, toxicity.score_toxicity):
        one = {r["doc_id"]: r["score"] for r in f(docs, labels).collect()}
        two = {r["doc_id"]: r["score"] for r in f(docs.withColumns({"lang": F.lit("xx"), "source": F.lit(None).cast("string")}), turned).collect()}
        assert one.keys() == two.keys()
        assert all(abs(one[k] - two[k]) < 1e-9 for k in one)


def test_rows_of_one_doc_id_by_value(spark):
    """Rows that repeat a doc_id, and rows without one, get what their own text gets under any other doc_id; repeated rows teach once."""
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    long = "word and more of it, " * 20_000
    odd = [(90_001, "vile words ### only"), (90_001, "A sentence of ordinary words stands here."), (90_001, None), (90_001, ""), (None, "A sentence of ordinary words stands here."), (None, long), (90_002, long)]
    alone = [(91_000 + i, x) for i, (_, x) in enumerate(odd)]
    for f in (quality_classifier.score_quality, toxicity.score_toxicity):
        got = f(table(spark, docs + docs[:50] + odd + odd[:1] + alone), labels).collect()
        assert len(got) == len(docs) + 50 + 2 * len(odd) + 1
        of = {r["doc_id"]: r["score"] for r in got if r["doc_id"] and r["doc_id"] >= 91_000}
        want = lambda *places: sorted(of[91_000 + i] for i in places)
        assert np.allclose(sorted(r["score"] for r in got if r["doc_id"] == 90_001), want(0, 0, 1, 2, 3))
        assert np.allclose(sorted(r["score"] for r in got if r["doc_id"] is None), want(4, 5))
        assert not any(r["held_out"] for r in got if r["doc_id"] is None)
        once = {r["doc_id"]: r["score"] for r in f(table(spark, docs), labels).collect()}
        assert all(abs(r["score"] - once[r["doc_id"]]) < 1e-9 for r in got if r["doc_id"] in once)
    model = sentencepiece_tokens.read_model()
    got = sentencepiece_tokens.digest(table(spark, odd + odd[:1] + alone), model).collect()
    of = {r["doc_id"]: tuple(r)[1:] for r in got if r["doc_id"] and r["doc_id"] >= 91_000}
    assert sorted(map(str, (tuple(r)[1:] for r in got if r["doc_id"] == 90_001))) == sorted(str(of[91_000 + i]) for i in (0, 0, 1, 2, 3))
    assert of[91_002] == (None, None, None) and of[91_003][0] == 0 and of[91_005] == of[91_006]


def test_sample_stays_bounded(spark):
    """A doc_id that a third of the rows hold teaches with a bounded number of rows."""
    from strophe.llm import labels

    ids = [i for i in range(300) if __import__("zlib").crc32(str(i).encode()) % 3 != 1]
    docs = table(spark, [(ids[0], f"text {k}") for k in range(2000)] + [(i, "other") for i in ids[1:]])
    known = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int")
    kept = labels.labelled(docs, known, "toxic", lambda x: x, bound=200).collect()
    assert 120 < len(kept) < 300


def test_counterfactual_penalty():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 400).astype(float)
    # term 0 marks toxicity; term 1 (a group) stands in most toxic rows, term 2 is the group it is swapped with
    has = [([0] if v else []) + ([1] if v and rng.random() < 0.8 else []) for v in y]
    others = [[[2 if t == 1 else t for t in x]] if 1 in x else [] for x in has]
    free, _ = toxicity.logistic(has, [[]] * 400, y, 3)
    tied, _ = toxicity.logistic(has, others, y, 3)
    assert abs(tied[1] - tied[2]) < 0.3 * abs(free[1] - free[2])
    assert tied[0] > 2


def test_neutral_mentions(spark):
    """A group is mentioned in most toxic sentences and few others: with the penalty, neutral mentions of it aren't called toxic, and swaps score alike."""
    rng = random.Random(8)
    plain = [f"word{i}" for i in range(300)]
    text = lambda *extra: " ".join(sorted([rng.choice(plain) for _ in range(20)] + list(extra), key=lambda _: rng.random()))
    rows = [(text("muslims", *(["vileword"] if rng.random() < 0.5 else ["nastiest"] if rng.random() < 0.5 else [])), 1) if rng.random() < 0.5 else (text(*(["christians"] if rng.random() < 0.3 else [])), 0) for _ in range(900)]
    neutral = [text(w) for w in ("muslims", "christians", "jews") for _ in range(30)]
    docs = [(i, x) for i, (x, _) in enumerate(rows)] + [(10_000 + i, x) for i, x in enumerate(neutral)] + [(20_000, text("vileword", "nastiest", "vileword"))]
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int")
    false, gap, bad = {}, {}, {}
    for penalty in (0.0, toxicity.PENALTY):
        got = {r["doc_id"]: (r["score"], r["predicted"]) for r in toxicity.score_toxicity(table(spark, docs), labels, penalty=penalty).collect()}
        false[penalty] = sum(got[10_000 + i][1] for i in range(30))
        gap[penalty] = np.mean([got[10_000 + i][0] for i in range(30)]) - np.mean([got[10_030 + i][0] for i in range(60)])
        bad[penalty] = got[20_000][0]
    assert false[0.0] >= 20
    assert false[toxicity.PENALTY] <= 3
    assert abs(gap[toxicity.PENALTY]) < 0.3 * abs(gap[0.0])
    assert bad[toxicity.PENALTY] > 0.7


def test_counterfactuals_are_made_of_words(spark):
    """Beginnings of a swapped word go with it; each other word of its group comes in turn; texts without one get a mention."""
    own = dict(zip([IDENTITY for g in toxicity.IDENTITY for IDENTITY in g], toxicity.identity_terms()[1], strict=True))
    terms = np.unique(np.concatenate(list(own.values())))
    rows = spark.createDataFrame([(1, "The Muslims came", 1), (2, "nobody", 0), (3, None, 0)], "doc_id long, text string, y int")
    got = {r["doc_id"]: r for r in toxicity.found(rows, terms, swapped=True).collect()}
    number = lambda *ws: sorted({int(np.searchsorted(terms, t)) for w in ws for t in own[w]})
    group = next(g for g in toxicity.IDENTITY if "muslims" in g)
    assert got[1]["has"] == number("muslims")
    assert sorted(got[1]["others"]) == sorted(number(w) for w in group if w != "muslims")
    assert got[1]["swaps"]
    assert not got[2]["swaps"]
    assert len(got[2]["others"]) == len(got[3]["others"]) == 1
    assert got[2]["others"][0] in [number(w) for w in own]


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "substring_dedup", "decontamination", "sentencepiece"]
    out = corpus_pipeline.run(spark, SF).collect()
    ids = {r["doc_id"] for r in out}
    assert len(ids) == len(out) > 100
    assert all(r["round_trip"] for r in out)


def test_stages_keep_other_columns(spark):
    """Names that the operators use inside are columns like any other; and empty tables pass through."""
    own = ["_key", "_key_", "_left", "_left_", "_row", "class_id", "kept", "digest", "item_id", "h", "copy", "left"]
    words = lambda n: " ".join(f"w{n * 1000 + k}" for k in range(70))
    docs = table(spark, [(i, words(i)) for i in range(5)] + [(9, words(4) + " again"), (10, "prefix " * 60 + words(3)[:300])]).select("*", *[F.lit(c).alias(c) for c in own])
    for stage in (quality_rules.stage, minhash.stage, substring_dedup.stage, decontaminate.stage):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        rows = out.collect()
        assert len(rows) >= 5
        assert all(r[c] == c for r in rows for c in own)
        assert stage(spark, docs.limit(0), SF).count() == 0


def without_repeats(rows, length=100):
    """Texts without the bytes of strings that start earlier, in the order of the rows; what is left of cut characters goes."""
    seen, out = set(), []
    for text in rows:
        b = text.encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if b[k : k + length] in seen:
                gone[k : k + length] = True
            seen.add(b[k : k + length])
        out.append(bytes(np.frombuffer(b, np.uint8)[~gone]).decode("utf-8", "ignore"))
    return out


def test_pipeline_against_brute_force(spark, duck, tmp_path):
    """All five stages by plain loops (the rules by their SQL), on the test table with null, empty, repeated and very long rows added."""
    import corpus_pipeline
    import sentencepiece

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect()]
    good = [x for _, x, *_ in rows if x and 80 < len(x.split()) < 300][:6]
    hostile = [(None, good[0]), (None, " ".join(reversed(good[1].split()))), (7_000, None), (7_001, ""), (7_002, good[2]), (7_002, good[2]), (7_003, "x" * 300_000), (7_004, good[3] + " "), (7_005, " ".join(good[4].split()[:60] * 3)), (None, None), (3, good[5] + " and more")]
    rows += [(i, x, "en", None) for i, x in hostile]
    spark.createDataFrame([(*r, len(r[1] or ""), "c") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, _key string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    con = duck.cursor()
    con.execute(f"CREATE VIEW hostile_docs AS SELECT row_number() OVER () - 1 AS doc_id, text, lang, source FROM '{tmp_path}/documents.parquet/*.parquet'")
    numbered = con.execute("SELECT * FROM hostile_docs").fetchall()
    kept = {r[0] for r in con.execute(f"SELECT doc_id, kept FROM ({quality_rules.oracle('hostile_docs')})").fetchall() if r[1]}
    ids = con.execute(f"SELECT doc_id FROM '{tmp_path}/documents.parquet/*.parquet'").fetchall()
    left = [(ids[k][0], text) for k, text, *_ in numbered if k in kept]
    digest_ = lambda x: hashlib.sha256(x.encode()).digest()[:16]
    left = sorted(set(left), key=lambda r: (r[0] is None, r[0] or 0, digest_(r[1])))  # the first of a class stays
    label = brute_classes([x for _, x in left])
    left = [r for k, r in enumerate(left) if label[k] == k]
    left.sort(key=lambda r: (r[0] is None, r[0] or 0, hashlib.md5(f"{len(r[1].encode())}:{r[1]}".encode()).digest()))
    left = [(i, y) for (i, _), y in zip(left, without_repeats([x for _, x in left]), strict=True) if y]
    bench = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = [(i, x) for i, x in left if not any(brute_leak(x, y) for y in bench)]
    judge = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_tokens.read_model())
    want = sorted(((i, len(t), hashlib.sha256(np.array(t, np.int32).tobytes()).hexdigest()) for i, x in left for t in [judge.encode(x)]), key=str)
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in got), key=str) == want
    assert len(want) > 100
