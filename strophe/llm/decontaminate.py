"""Benchmark decontamination by template canonicalisation.

Names, numbers and units become typed placeholders: a run of capitalised words is one name (also at the start of a sentence), a unit follows a
number. Windows of eight canonical tokens are hash-joined with those of the benchmark. Hits of a document and an item that follow each other token by token (one shift) are
a run, as long as it can be. An alignment is a chain of whole runs, forward in both texts, and counts the item's windows on it. It is enough with half of the
item's windows, or ``run`` of them, and it must be consistent: each slot value of the item stands for one value of the document, and no two stand for the same (names word by word, or
as sets of words if one has more; several units may mean one). So a question with other numbers or names is caught, and one that only shares its frame by chance is not,
nor does it matter what else the document holds of the item, or how often its frame repeats. Three kinds of alignment are tried:

1. all runs of one shift (any copy without inserted or lost words, in template or word for word);
2. windows that agree word for word, whatever stands between them: the longest chain of them, which is exact. Such a chain is always consistent;
3. chains of runs with their slots: over the runs in the document's order, of each window of the item the best chain that ends there is kept, and
   a run joins the longest consistent one before it (the nearest shift of several). A run whose own slots conflict joins none.

Only DataFrame functions. Windows of documents meet the benchmark's by a map-side join while its windows are
few (counted), else by a shuffle; only hits go on, and only runs are gathered by document and item. Items of fewer than eight tokens have one window, of all tokens, and are matched
among windows of their own length. A window of the benchmark with fewer than three words of its own (so nearly all slots) is matched with its values as they are.

Null and empty texts match nothing. Every row is judged by its own text, so null and repeated doc_ids are rows like any other; rows that agree in
doc_id and text give one result. Items that repeat an item_id all count; the one with most windows is reported. Very long texts take part whole.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, drop_inputs, fresh, let, row_key, small, table

WIDTH = 8
SHARE = 0.5
RUN = 24
WORDS = 3  # that a window needs beside its slots
#: Placeholders are private-use characters, so that they equal no word.
NAME, NUMBER, UNIT = "\ue000", "\ue001", "\ue002"
#: A number, a run of capitalised words, a word, or a sign.
TOKEN = r"[0-9]+(?:[.,][0-9]+)*|\p{Lu}\p{Ll}++(?![\p{L}\p{M}])(?: \p{Lu}\p{Ll}++(?![\p{L}\p{M}]))*|[\p{L}\p{M}]+|[%$€£]"
#: Units after a number.
UNITS = (
    "kilometer kilometers kilometre kilometres meter meters metre metres mile miles inches feet km cm mm kg mg ml lb lbs gram grams pound pounds liter liters litre litres hour hours hr hrs "
    "minute minutes min mins second seconds sec secs day days week weeks month months year years dollar dollars cent cents euro euros degree degrees percent mph kmh m % $ € £"
).split()


def raw_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def canonical(tokens: Column) -> Column:
    """Tokens with placeholders; all others in lower case. The rules run over the joined tokens, not token by token."""
    joined = F.concat(F.lit("\n"), F.array_join(tokens, "\n"), F.lit("\n"))
    joined = F.regexp_replace(joined, r"(?<=\n)[0-9][^\n]*", NUMBER)
    joined = F.regexp_replace(joined, rf"(?<=\n{NUMBER}\n)(?iu:{'|'.join(map(re.escape, UNITS))})(?=\n)", UNIT)
    joined = F.regexp_replace(joined, r"(?<=\n)[\p{Lu}\p{Lt}]\p{Ll}[^\n]*", NAME)
    return F.when(F.size(tokens) > 0, F.slice(F.split(F.lower(joined), "\n"), F.lit(2), F.size(tokens))).otherwise(F.array().cast("array<string>"))


def is_slot(token: Column) -> Column:
    return token.isin(NAME, NUMBER, UNIT)


def windows(tokens: Column, width: int, seed: int) -> Column:
    """i and h, the hash, of all windows of tokens, in order: a token's hash is made once, a window's from those."""
    cut = lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (width - 1)), lambda i: F.struct((i - 1).alias("i"), F.xxhash64(F.lit(seed), *[F.element_at(h, i + k) for k in range(width)]).alias("h")))
    hashes = F.transform(tokens, lambda t: F.xxhash64(t))
    return F.when(F.size(tokens) >= width, let(hashes, cut)).otherwise(F.array().cast("array<struct<i:int,h:bigint>>"))


def own_windows(items: DataFrame) -> DataFrame:
    """item, width, j, h and strict of each window of the benchmark."""
    few = lambda i, w: F.size(F.filter(F.slice("can", i + 1, w), lambda t: ~is_slot(t))) < F.least(F.lit(WORDS), w)
    out = None
    for k in range(1, WIDTH + 1):
        of = items.filter(F.col("width") == k)
        both = of.select("item", F.explode(F.arrays_zip(windows(F.col("can"), k, 0).alias("c"), windows(F.transform("raw", F.lower), k, 1).alias("r"))).alias("w"), "can")
        one = both.select("item", F.lit(k).alias("width"), F.col("w.c.i").alias("j"), "w.c.h", F.col("w.r.h").alias("h2"), few(F.col("w.c.i"), F.lit(k)).alias("strict"))
        one = one.select("item", "width", "j", F.when(F.col("strict"), F.col("h2")).otherwise(F.col("h")).alias("h"), "strict")
        out = one if out is None else out.unionAll(one)
    return out


def runs_of(hits: DataFrame) -> DataFrame:
    """_row, item and shifts: of each shift its number of windows n and its runs (first window j0 of the item, and length), from hits (_row, item, i, j)."""
    shifted = hits.withColumn("shift", F.col("i") - F.col("j"))
    island = F.col("j") - F.row_number().over(W.partitionBy("_row", "item", "shift").orderBy("j"))
    one = shifted.withColumn("island", island).groupBy("_row", "item", "shift", "island").agg(F.min("j").alias("j0"), F.count("*").cast("int").alias("len"))
    shifts = one.groupBy("_row", "item", "shift").agg(F.sum("len").cast("int").alias("n"), F.sort_array(F.collect_list(F.struct("j0", "len"))).alias("runs"))
    return shifts.groupBy("_row", "item").agg(F.collect_list(F.struct("shift", "n", "runs")).alias("shifts"))


def covered(shifts: Column) -> Column:
    """How many windows of the item are hit at all."""
    return F.size(F.array_distinct(F.flatten(F.transform(shifts, lambda s: F.flatten(F.transform(s["runs"], lambda r: F.sequence(r["j0"], r["j0"] + r["len"] - 1)))))))


def slots(shift: Column, j0: Column, n: Column) -> Column:
    """(kind, value in the item, value in the document) of the slots of a run; a name of as many words in both gives its words one by one."""

    def at(j):
        c, b, d = F.get("can", j), F.lower(F.get("item_raw", j)), F.lower(F.get("doc_raw", j + shift))
        words = F.arrays_zip(F.split(b, " ").alias("b"), F.split(d, " ").alias("d"))
        one = F.when((c == NAME) & (F.size(F.split(b, " ")) == F.size(F.split(d, " "))), words).otherwise(F.array(F.struct(b.alias("b"), d.alias("d"))))
        return F.transform(one, lambda p: F.struct(c.alias("kind"), p["b"].alias("b"), p["d"].alias("d")))

    places = F.filter(F.sequence(j0, j0 + n + F.col("width") - 2), lambda j: is_slot(F.get("can", j)))
    return F.array_distinct(F.flatten(F.transform(places, at)))


def agree(p: Column, q: Column) -> Column:
    """Two slots may stand side by side: equal values of the item mean equal ones (or ones with a word in common), and other values other ones."""
    both = lambda x: F.size(F.array_intersect(F.split(p[x], " "), F.split(q[x], " "))) > 0
    same_b, same_d = p["b"] == q["b"], p["d"] == q["d"]
    return (p["kind"] != q["kind"]) | (same_b & (same_d | both("d"))) | (~same_b & (~same_d | (p["kind"] == UNIT) | both("b")))


def consistent(mine: Column, others: Column) -> Column:
    return F.forall(mine, lambda p: F.forall(others, lambda q: agree(p, q)))


def on_one_shift(enough) -> Column:
    """The most windows of a shift that is enough and consistent, or null."""
    of = lambda s: F.array_distinct(F.flatten(F.transform(s["runs"], lambda r: slots(s["shift"], r["j0"], r["len"]))))
    good = F.filter(F.filter("shifts", lambda s: enough(s["n"])), lambda s: let(of(s), lambda v: consistent(v, v)))
    return F.array_max(F.transform(good, lambda s: s["n"]))


def word_for_word() -> Column:
    """Length of the longest chain of windows that agree in all words: of each length so far, the least window of the item that a chain ends with."""
    same = lambda i, j: F.forall(F.sequence(F.lit(0), F.col("width") - 1), lambda k: F.lower(F.get("doc_raw", i + k)) == F.lower(F.get("item_raw", j + k)))
    every = F.flatten(F.transform("shifts", lambda s: F.flatten(F.transform(s["runs"], lambda r: F.transform(F.sequence(r["j0"], r["j0"] + r["len"] - 1), lambda j: F.struct((j + s["shift"]).alias("i"), (-j).alias("back")))))))
    hits = F.array_sort(F.filter(every, lambda h: same(h["i"], -h["back"])))  # windows of one place from the last, so that a chain takes one of them

    def step(ends, h):
        j = -h["back"]
        return F.concat(F.filter(ends, lambda e: e < j), F.array(j), let(F.filter(ends, lambda e: e >= j), lambda over: F.slice(over, F.lit(2), F.greatest(F.size(over), F.lit(1)))))

    return F.size(F.aggregate(hits, F.array().cast("array<int>"), step))


CHAIN = "array<struct<n:int,near:int,j:int,i:int,shift:int,slots:array<struct<kind:string,b:string,d:string>>>>"


def of_runs() -> Column:
    """The most windows of a consistent chain of runs (0 without any)."""
    flat = F.flatten(F.transform("shifts", lambda s: F.transform(s["runs"], lambda r: F.struct((r["j0"] + s["shift"]).alias("i0"), r["j0"].alias("j0"), r["len"].alias("len"), s["shift"].alias("shift")))))
    runs = F.filter(F.transform(F.array_sort(flat), lambda r: r.withField("slots", slots(r["shift"], r["j0"], r["len"]))), lambda r: consistent(r["slots"], r["slots"]))

    def step(chains, r):
        last_j, last_i = r["j0"] + r["len"] - 1, r["i0"] + r["len"] - 1
        chain = lambda n, near, known: F.struct(n.cast("int").alias("n"), near.cast("int").alias("near"), last_j.cast("int").alias("j"), last_i.cast("int").alias("i"), r["shift"].cast("int").alias("shift"), known.alias("slots"))
        gain = lambda c: r["len"] - F.greatest(F.lit(0), c["j"] + 1 - r["j0"], c["i"] + 1 - r["i0"])
        joined = F.transform(F.filter(chains, lambda c: (gain(c) > 0) & consistent(r["slots"], c["slots"])), lambda c: chain(c["n"] + gain(c), -F.abs(c["shift"] - r["shift"]), F.array_union(c["slots"], r["slots"])))
        best = F.array_max(F.concat(joined, F.array(chain(r["len"], F.lit(-(1 << 30)), r["slots"]))))
        keep = lambda b: F.when(F.exists(chains, lambda c: (c["j"] == b["j"]) & (c["n"] > b["n"])), chains).otherwise(F.concat(F.filter(chains, lambda c: c["j"] != b["j"]), F.array(b)))
        return let(best, keep)

    return F.coalesce(F.array_max(F.transform(F.aggregate(runs, F.array().cast(CHAIN), step), lambda c: c["n"])), F.lit(0))


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, run: int = RUN, width: int = WIDTH, most: int = 500_000, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, columns to carry along, item_id, n_windows (of the item on the alignment), share of its windows and n_slots (different slot values of the item) of each pair of a document and an item with a leak.

    most: benchmark windows, and rows with a likely leak (16 bytes each), up to which they are sent to every task.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "leaks")
    docs = drop_inputs(docs, "doc_id", "text", *carry).withColumn("_row", row_key("doc_id", "text"))
    items = drop_inputs(benchmark, "item_id", "text").withColumn("item", row_key("item_id", "text")).filter("item_id IS NOT NULL").dropDuplicates(["item"])
    items = items.select("item", "item_id", raw_tokens(F.col("text")).alias("raw")).filter(F.size("raw") > 0).withColumn("can", canonical(F.col("raw")))
    items = scratch.keep(items.withColumn("width", F.least(F.lit(width), F.size("can"))).withColumn("windows", F.size("can") - F.col("width") + 1))
    bench = scratch.keep(own_windows(items))
    kinds = [(r["width"], r["strict"]) for r in bench.select("width", "strict").distinct().orderBy("width", "strict").collect()]  # at most sixteen
    if not kinds:
        return spark.createDataFrame([], f"doc_id long, {''.join(f'{c} {t}, ' for c, t in docs.select(*carry).dtypes)}item_id long, n_windows long, share double, n_slots long")

    # One pass over the texts, whatever the kinds of windows.
    cut = lambda raw: F.flatten(F.array(*([let(canonical(raw), lambda c: F.flatten(F.array(*[windows(c, k, 0) for k, strict in kinds if not strict])))] if any(not s for _, s in kinds) else []),
                                        *[windows(F.transform(raw, F.lower), k, 1) for k, strict in kinds if strict]))
    seen = docs.select("_row", F.explode(let(raw_tokens(F.col("text")), cut)).alias("w")).select("_row", "w.*")
    # Rows that agree in doc_id and text give each hit again.
    hits = seen.join(small(bench.select("item", "j", "h"), most), "h").select("_row", "item", "i", "j").distinct()
    enough = lambda n: (n >= share * F.col("windows")) | (n >= run)
    likely = runs_of(hits).join(small(items.select("item", "windows"), most), "item").filter(enough(covered(F.col("shifts"))))
    likely = scratch.keep(likely.select("_row", "item", "shifts"))

    texts = docs.join(small(likely.select("_row").distinct(), most), "_row", "left_semi").dropDuplicates(["_row"])
    texts_of = F.col("item"), F.col("item_id"), F.col("raw").alias("item_raw"), F.col("can"), F.col("width"), F.col("windows")
    pairs = likely.join(texts.select("_row", "doc_id", *carry, raw_tokens(F.col("text")).alias("doc_raw")), "_row").join(items.select(*texts_of), "item")
    n = F.coalesce(on_one_shift(enough), let(word_for_word(), lambda n: F.when(enough(n), n)), of_runs())  # each is tried only if those before it give none
    found = pairs.withColumn("n", n).filter(enough(F.col("n")))
    values = F.size(F.array_distinct(F.transform(F.filter(F.arrays_zip("can", "item_raw"), lambda t: is_slot(t["can"])), lambda t: F.struct(t["can"], F.lower(t["item_raw"])))))
    good = found.groupBy("_row", "doc_id", *carry, "item_id").agg(F.max(F.struct("n", "windows", values.alias("n_slots"), "item")).alias("b"))
    return good.select("doc_id", *carry, "item_id", F.col("b.n").cast("long").alias("n_windows"), F.round(F.col("b.n") / F.col("b.windows"), 4).alias("share"), F.col("b.n_slots").cast("long").alias("n_slots"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a leak."""
    key = fresh(docs, "_key")
    keyed = docs.withColumn(key, row_key("doc_id", "text"))
    bad = Scratch(spark, "leaking").keep(leaks(keyed, table(spark, sf_dir, "benchmark"), carry=(key,)).select(key).distinct())
    return keyed.join(small(bad, 500_000), key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
