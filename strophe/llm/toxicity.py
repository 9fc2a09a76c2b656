"""Toxicity: a logistic classifier of words and word beginnings, regularised by counterfactuals.

In labelled texts each identity word is swapped, before terms are made of it, for every other of its group in turn; into labelled texts without one,
a mention is put, one of the words by the text's doc_id. The square of the change of the score's logit is penalised, so that
neither which group a text mentions nor that it mentions one moves its score. Terms of the model are all that mark the toxic rows of a
bounded sample (in at least 3 toxic rows, significantly and at least four times as often as in others), and the identity words as a whole; texts are read whole.

Null and empty texts contain no term and get the score of the intercept. Without labels of both classes every score is 0.
Repeated rows get equal scores; rows that repeat a doc_id are scored by their own text, and a doc_id with two labels teaches both.
Null doc_ids are scored too (not held out), and teach nothing. Very long texts count as a set of their terms, like all. Equal scores stay equal (there are no
ranks); rows that agree in doc_id, text and label teach once. Columns beyond doc_id and text play no part.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytes_ import NO_LETTER, batches_of, mix, powers, words_of
from .common import Scratch, arrow_rows, drop_inputs, table
from .labels import BOUND, held_out, labelled

#: Identity terms by group, swapped within their group.
IDENTITY = [
    ["women", "men"], ["woman", "man"], ["girls", "boys"], ["gay", "straight", "lesbian", "bisexual", "transgender"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"], ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"],
    ["black", "white", "asian", "latino"], ["african", "european", "american", "mexican", "chinese", "arab"],
    ["immigrants", "refugees", "natives"], ["deaf", "blind", "disabled"], ["old", "young"],
    ["frauen", "männer"], ["femmes", "hommes"], ["mujeres", "hombres"], ["juden", "christen", "muslime"], ["juifs", "chrétiens", "musulmans"], ["judíos", "cristianos", "musulmanes"],
]
PREFIXES = (4, 5, 6)  # bytes
LEAST = 3  # toxic rows that a term must stand in
PENALTY = 10.0
RIDGE = 0.02


def word_terms(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words and of their beginnings, and the number of the word of each."""
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out, of = [mix(powers.spans(data, first, last) + np.uint64(99))], [np.arange(len(first))]
    for k in PREFIXES:
        long = np.flatnonzero(last - first > k)
        out.append(mix(powers.spans(data, first[long], first[long] + k) + np.uint64(k)))
        of.append(long)
    return np.concatenate(out), np.concatenate(of)


def terms_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and word beginnings of lower-cased texts, and the text of each."""
    first, last, doc = words_of(data, starts, ends, NO_LETTER)
    h, of = word_terms(data, first, last)
    return h, doc[of]


def identity_terms() -> tuple[list[tuple[int, int]], list[np.ndarray]]:
    """Group and place in it of each identity word, and its terms (the word itself first)."""
    places = [(g, k) for g, group in enumerate(IDENTITY) for k in range(len(group))]
    terms = []
    for g, k in places:
        raw = np.frombuffer(IDENTITY[g][k].encode(), np.uint8)
        terms.append(word_terms(raw, np.array([0]), np.array([len(raw)]))[0])
    return places, terms


def lowered(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pc.utf8_lower(b.column(1)), *b.columns[2:]], b.schema.names)


def positives(rows: DataFrame) -> DataFrame:
    """Each different term of each toxic text: h."""

    def run(batches):
        for _, data, starts, ends in batches_of(lowered(batches)):
            h, o = terms_of(data, starts, ends)
            if len(h):
                pairs = np.unique(np.stack([o.astype(np.uint64), h], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 1].astype(np.int64))], ["h"])

    return rows.filter("y = 1").select("doc_id", "text").mapInArrow(run, "h long")


def found(rows: DataFrame, terms: np.ndarray, swapped: bool = False) -> DataFrame:
    """doc_id, y and the numbers of the terms in each text (has); with swapped, also those of its counterfactuals (others), and whether these are swaps or a mention put in."""
    places, own = identity_terms()
    start = {g: i for i, (g, k) in reversed(list(enumerate(places))) if k == 0}
    keys = np.array([t[0] for t in own], np.uint64)
    order = np.argsort(keys)

    def numbers(h):
        if not len(terms):
            return np.zeros(0, np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
        return at, terms[at] == h

    mention = [set(at[hit].tolist()) for at, hit in map(numbers, own)]

    def run(batches):
        for b in lowered(batches):
            done = 0
            for key, data, starts, ends in batches_of([b]):
                docs = len(starts)
                first, last, doc = words_of(data, starts, ends, NO_LETTER)
                h, of = word_terms(data, first, last)
                at, hit = numbers(h)
                has = [set() for _ in range(docs)]
                for i, t in zip(doc[of[hit]].tolist(), at[hit].tolist(), strict=True):
                    has[i].add(t)
                others, kind = [[] for _ in range(docs)], [False] * docs
                if swapped:
                    word = h[: len(first)]  # each word's own hash comes first
                    place = order[np.minimum(np.searchsorted(keys[order], word), len(keys) - 1)]
                    identity = keys[place] == word
                    rest = [set() for _ in range(docs)]  # terms of all other words
                    kept = hit & ~identity[of] if len(of) else hit
                    for i, t in zip(doc[of[kept]].tolist(), at[kept].tolist(), strict=True):
                        rest[i].add(t)
                    named: dict[int, list[int]] = {}
                    for i, w in zip(doc[identity].tolist(), place[identity].tolist(), strict=True):
                        named.setdefault(i, []).append(w)
                    for i in range(docs):
                        if i not in named:
                            k = zlib.crc32(str(key[i].as_py()).encode()) % len(places)
                            others[i] = [sorted(has[i] | mention[k])]
                            continue
                        kind[i] = True
                        for r in range(1, max(len(IDENTITY[places[w][0]]) for w in named[i])):
                            new = [start[places[w][0]] + (places[w][1] + r) % len(IDENTITY[places[w][0]]) for w in named[i]]
                            if new != named[i]:
                                others[i].append(sorted(rest[i].union(*(mention[w] for w in new))))
                ints = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays([key, b.column(2).slice(done, docs), pa.array([sorted(x) for x in has], ints), pa.array(others, pa.list_(ints)), pa.array(kind, pa.bool_())], ["doc_id", "y", "has", "others", "swaps"])
                done += docs

    return rows.select("doc_id", "text", "y").mapInArrow(run, "doc_id long, y int, has array<int>, others array<array<int>>, swaps boolean")


def logistic(has: list, others: list, y: np.ndarray, m: int, penalty: float = PENALTY, swaps: list | None = None, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights of m terms and an intercept. others: the counterfactuals of each text; the penalty is on the mean square of the logit's change, of
    swaps and of mentions put in apart (swaps: which texts have swaps; all, by default)."""

    def flat(lists):
        return np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.array([i for x in lists for i in x], np.int64)

    r, c = flat(has)
    kinds = [True] * len(has) if swaps is None else swaps
    sides = []
    for kind in (True, False):
        pairs = [(has[i], x) for i, xs in enumerate(others) if kinds[i] == kind for x in xs]
        if pairs and penalty:
            sides.append((len(pairs), flat([p for p, _ in pairs]), flat([q for _, q in pairs])))
    w, b, n = np.zeros(m), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), len(y)
    first, second = np.zeros(m + 1), np.zeros(m + 1)
    for t in range(1, steps + 1):
        z = b + np.bincount(r, w[c], n)
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        g = np.bincount(c, (p - y)[r], m) / n * 20 + RIDGE * w / 100
        for k, (pr, pt), (qr, qt) in sides:
            change = np.bincount(pr, w[pt], k) - np.bincount(qr, w[qt], k)
            g += penalty * (np.bincount(pt, change[pr], m) - np.bincount(qt, change[qr], m)) / k
        g = np.append(g, (p - y).mean())
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g**2
        step = 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def fit(rows: DataFrame, penalty: float = PENALTY) -> dict | None:
    """rows (doc_id, text, y), a bounded number -> the model."""
    n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return None
    some = positives(rows).groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST)
    terms = np.array(sorted({r["h"] & (2**64 - 1) for r in some.collect()}), np.uint64)  # terms of a bounded sample
    if not len(terms):
        return None

    def counts(batches):
        total = np.zeros((2, len(terms)), np.int64)
        for b in batches:
            for y, has in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total[int(y == 1), has] += 1
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    got = found(rows, terms).select("y", "has").repartition(8).mapInArrow(counts, "total binary").collect()
    neg, pos = sum(np.frombuffer(r["total"], np.int64).reshape(2, -1) for r in got)
    p1, p0 = (pos + 0.5) / (n[1] + 1), (neg + 0.5) / (n[0] + 1)
    z = (p1 - p0) / np.sqrt(p1 * (1 - p1) / n[1] + p0 * (1 - p0) / n[0])
    # sure markers: significant, and much more frequent in toxic rows
    chosen = (z > 1.5) & (p1 > 4 * p0)
    # Identity words are terms as a whole: their beginnings are beginnings of ordinary words too.
    terms = np.unique(np.concatenate([terms[chosen], [own[0] for own in identity_terms()[1]]]))
    data = found(rows, terms, swapped=True).collect()  # a bounded sample, and few terms in each
    w, b = logistic([r["has"] for r in data], [r["others"] for r in data], np.array([float(r["y"] == 1) for r in data]), len(terms), penalty, [r["swaps"] for r in data])
    return {"terms": terms, "w": w, "b": b}


def score_toxicity(docs: DataFrame, labels: DataFrame, bound: int = BOUND, penalty: float = PENALTY) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    docs = drop_inputs(docs, "doc_id", "text")
    with arrow_rows(spark, 1000):
        rows = labelled(docs, labels, "toxic", scratch.keep, bound=bound)
        model = fit(rows, penalty)

    def run(batches):
        for key, data, starts, ends in batches_of(lowered(batches)):
            z = np.zeros(len(starts))
            if model is not None:
                h, o = terms_of(data, starts, ends)
                at = np.minimum(np.searchsorted(model["terms"], h), len(model["terms"]) - 1)
                hit = model["terms"][at] == h
                pairs = np.unique(np.stack([o[hit], at[hit]], 1), axis=0) if hit.any() else np.zeros((0, 2), np.int64)
                z = model["b"] + np.bincount(pairs[:, 0], model["w"][pairs[:, 1]], len(starts))
                z = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            yield pa.RecordBatch.from_arrays([key, pa.array(z)], ["doc_id", "score"])

    with arrow_rows(spark, 1000):
        out = scratch.keep(docs.mapInArrow(run, "doc_id long, score double"))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
