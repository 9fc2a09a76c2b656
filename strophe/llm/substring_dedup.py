"""Exact substring dedup: bytes covered by a 100-byte string that starts earlier in the corpus are removed.

Matches are blocked, then indexed. Of every 100-byte string the 32-byte gram of least hash is its anchor, so equal strings
have equal anchors at equal places. Each anchor has a context: all 100-byte strings around it (168 bytes).
Anchors that occur once are done. Of equal contexts all but the first are removed whole. The first ones
of different contexts of an anchor go, some thousands at a time, into a run-length index (``RunIndex``): the Burrows-Wheeler transform of
the contexts in runs, with the suffixes at the ends of runs sampled. From it each text position's matching statistics are streamed: the
suffix before it in order and the length that both share. What all strings of a quarter of the context share, its core, is one symbol there.
Strings linked by matches of full length are equal; all but the earliest are marked.
An anchor of more contexts than ``most`` (a third of all documents may share a line) has its quarters, and the strings of those that
stay open, grouped by digest instead, by partial aggregation, so no task ever holds a large group; the result is the same.

A document is a doc_id and a text: rows that agree in both count once and share the result; of several texts of one doc_id the one of the lesser
digest is earlier; texts without a doc_id come after all others, by digest. Null and short texts keep all they have. Ties can't occur, since starts differ.
"""

from __future__ import annotations

import gc
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytes_ import MIXED, batches_of, mix, powers
from .common import Scratch, arrow_rows, drop_inputs, fresh, row_key, table

LENGTH, GRAM = 100, 32
MOST = 20_000
CHUNK = 8000  # contexts in one index


def slide(x: np.ndarray, n: int, f) -> np.ndarray:
    """f over x[i : i + n] for each i; the last n - 1 places hold less."""
    x, w = x.copy(), 1
    while 2 * w <= n:
        x[:-w] = f(x[:-w], x[w:])
        w *= 2
    if n > w:
        y = x.copy()
        y[: w - n] = f(x[: w - n], x[n - w :])
        x = y
    return x


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, gram: int):
    """Hash, context hash, text number and place within the text of each anchor of a chunk."""
    n, w = len(data), length - gram + 1
    if n < length:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
    powers.need(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(MIXED[data] * powers.up[:n], out=sums[1:])
    h = mix((sums[gram:] - sums[:-gram]) * powers.down[: n - gram + 1]) | np.uint64(1)
    least = slide(h, w, np.minimum)[: n - length + 1]
    inside = np.zeros(n + 1, np.int64)
    long = ends - starts >= length
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - length + 1, -1)
    least[np.cumsum(inside)[: len(least)] == 0] = 0  # strings that cross from one text to the next
    padded = np.zeros(n + w - 1, np.uint64)
    padded[w - 1 : w - 1 + len(least)] = least
    best = slide(padded, w, np.maximum)[: n - gram + 1]
    at = np.flatnonzero(best == h)  # it is the least of some string: the largest least value around it is its own
    doc = np.searchsorted(starts, at, "right") - 1
    left, right = np.maximum(starts[doc], at - (w - 1)), np.minimum(ends[doc], at + length)
    context = mix((sums[right] - sums[left]) * powers.down[left] ^ mix(((at - left) * 4096 + (right - at)).astype(np.uint64)))
    return h[at], context, doc, at - starts[doc]


def anchor_rows(docs: DataFrame, length: int, gram: int, only_hash: bool) -> DataFrame:
    def run(batches):
        for keys, data, starts, ends in batches_of(batches):
            h, c, doc, at = anchors(data, starts, ends, length, gram)
            for i in range(0, len(h), 50_000):
                s = slice(i, i + 50_000)
                cols = [pa.array(h[s].astype(np.int64))]
                if not only_hash:
                    cols += [pa.array(c[s].astype(np.int64)), keys.take(pa.array(doc[s])), pa.array(at[s].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, ["h", "c", "doc_id", "at"][: len(cols)])

    return docs.mapInArrow(run, "h long" if only_hash else "h long, c long, doc_id long, at int")


def packed(docs: DataFrame, *carry: str) -> DataFrame:
    """doc_id and its compressed text, so that a shuffle moves less; binary columns to carry go along."""
    names = ["doc_id", "size", "z", *carry]

    def run(batches):
        for b in batches:
            raw = [(x.as_py() or "").encode() for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in raw], pa.int32()), pa.array([pa.compress(x, "zstd", asbytes=True) for x in raw], pa.binary()), *b.columns[2:]], names)

    return docs.select("doc_id", "text", *carry).mapInArrow(run, "doc_id long, size int, z binary" + "".join(f", {c} binary" for c in carry))


def unpacked(batches):
    """Batches of packed texts as batches of doc_id and bytes."""
    for b in batches:
        raw = [pa.decompress(z, n, "zstd", asbytes=True) if n else b"" for n, z in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], ["doc_id", "text"])


def suffix_levels(t: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Suffix array of t (0 ends a piece) by prefix doubling, and the ranks at each length on the way."""
    n, key, size, levels = len(t), t.astype(np.uint64), 1, []
    while True:
        order = np.argsort(key)
        new = np.ones(n, bool)
        new[1:] = key[order[1:]] != key[order[:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        levels.append((size, rank.astype(np.int32)))
        if new.all() or size >= n:
            return order, levels
        after = np.zeros(n, np.uint64)
        after[: n - size] = rank[size:]
        key = rank.astype(np.uint64) << np.uint64(32) | after
        size *= 2


class RunIndex:
    """A run-length compressed Burrows-Wheeler index of t: a symbol and a length for each run of the transform, and samples at its ends.

    A sample is the suffix at a run's head, the suffix before it in order (the end of the run before), and the length that both share. The suffix array
    serves to build it only; what stays has the size of the number of runs, which is small if t repeats itself.
    """

    def __init__(self, t: np.ndarray):
        n = len(t)
        order, levels = suffix_levels(t)
        bwt = t[order - 1]
        head = np.ones(n, bool)
        head[1:] = bwt[1:] != bwt[:-1]
        whole = np.flatnonzero(order == 0)  # nothing stands before the whole text, so it is a run of its own
        head[whole] = head[np.minimum(whole + 1, n - 1)] = True
        heads = np.flatnonzero(head)
        self.symbols, self.lengths = bwt[heads], np.diff(np.append(heads, n))
        sample, before = order[heads], order[np.maximum(heads - 1, 0)]
        shared, p, q = np.zeros(len(sample), np.int64), sample.copy(), before.copy()
        for size, rank in reversed(levels):  # the longest steps first; the longest of all differ
            ok = (p < n) & (q < n)
            ok[ok] = rank[p[ok]] == rank[q[ok]]
            shared[ok], p[ok], q[ok] = shared[ok] + size, p[ok] + size, q[ok] + size
        shared[sample == order[0]] = 0
        by_place = np.argsort(sample)
        self.sample, self.before, self.shared = sample[by_place], before[by_place], shared[by_place]

    def matches(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics of suffixes of the text: the suffix before each in order, and the length that both share. From the last sample on, both
        suffixes move on by one symbol a step, and the shared length falls by one."""
        k = np.searchsorted(self.sample, places, "right") - 1
        step = places - self.sample[np.maximum(k, 0)]
        return np.where(k < 0, places, self.before[np.maximum(k, 0)] + step), np.where(k < 0, 0, self.shared[np.maximum(k, 0)] - step)


def equal_strings(index: RunIndex, size: int, places: np.ndarray, need: np.ndarray) -> np.ndarray:
    """For each place the number of another (or itself) such that places with equal strings of the needed lengths have equal numbers."""
    number = np.full(size + 1, -1, np.int64)
    number[places] = np.arange(len(places))
    source, shared = index.matches(places)
    other = number[np.clip(source, 0, size)]
    root = np.where((shared >= need) & (other >= 0), other, np.arange(len(places)))
    while True:
        up = root[root]
        if (up == root).all():
            return root
        root = up


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of stretches, one after the other, and the stretch of each."""
    which = np.repeat(np.arange(len(sizes)), sizes)
    return starts[which] + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes), which


def quarters(length: int, gram: int) -> list[tuple[int, int]]:
    """The starts of the strings around an anchor, relative to it, in four stretches. All strings of a stretch share its core."""
    cuts = np.linspace(-(length - gram), 1, 5).astype(int)
    return [(int(x), int(y) - 1) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]


def split_contexts(sizes: np.ndarray, left: np.ndarray, length: int, gram: int):
    """For each context and quarter with a string: context, quarter, first and last string start (in the context), core start and end."""
    out = []
    for k, (a, b) in enumerate(quarters(length, gram)):
        lo, hi = np.maximum(left + a, 0), np.minimum(left + b, sizes - length)
        i = np.flatnonzero(lo <= hi)
        out.append(np.stack([i, np.full(len(i), k), lo[i], hi[i], left[i] + b, left[i] + a + length], 1))
    return np.concatenate(out)


def earlier(contexts: list[bytes], left: np.ndarray, origin: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context, start and end of stretches whose strings also start at a smaller origin (origin: of a context's first byte; left: its anchor).

    Cores found once are done; equal stretches but the first are whole ones. The others are written as symbols (what is left of the
    core, the core as one symbol, what is right of it), and the run-length index of these finds equal strings.
    """
    sizes = np.array([len(c) for c in contexts])
    data = np.frombuffer(b"".join(contexts), np.uint8)
    base = np.cumsum(sizes) - sizes
    part = split_contexts(sizes, left, length, gram)
    i, _, lo, hi, c0, c1 = part.T
    core = mix(powers.spans(data, base[i] + c0, base[i] + c1) ^ mix((c1 - c0).astype(np.uint64)))
    whole = mix(powers.spans(data, base[i] + lo, base[i] + hi + length) ^ mix((c0 - lo).astype(np.uint64) * np.uint64(4096) + (hi + length - c1).astype(np.uint64)))
    at = origin[i] + lo
    order = np.lexsort((at, whole, core))
    new_core = np.ones(len(order), bool)
    new_core[1:] = core[order][1:] != core[order][:-1]
    new = new_core.copy()
    new[1:] |= whole[order][1:] != whole[order][:-1]
    again = order[~new & (at[order] > at[order][np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))])]
    group = np.cumsum(new_core) - 1
    several = np.bincount(group, weights=new)[group] > 1
    open_, symbol = order[new & several], group[new & several]
    ctx, start, end = [i[again]], [lo[again]], [hi[again] + length]
    if len(open_):
        i, lo, hi, c0, c1 = (v[open_] for v in (i, lo, hi, c0, c1))
        a, b = c0 - lo, hi + length - c1
        size = a + b + 2
        head = np.cumsum(size) - size + 1  # a separator before each piece
        t = np.zeros(size.sum() + 1, np.int64)
        to, _ = _ranges(head, a)
        t[to] = data[_ranges(base[i] + lo, a)[0]].astype(np.int64) + 1
        t[head + a] = 257 + np.unique(symbol, return_inverse=True)[1]
        to, _ = _ranges(head + a + 1, b)
        t[to] = data[_ranges(base[i] + c1, b)[0]].astype(np.int64) + 1
        places, piece = _ranges(head, hi - lo + 1)
        value = origin[i][piece] + lo[piece] + (places - head[piece])
        root = equal_strings(RunIndex(t), len(t), places, (length - (c1 - c0) + 1)[piece])
        least = np.full(len(places), np.iinfo(np.int64).max)
        np.minimum.at(least, root, value)
        marked = places[value > least[root]]  # in order already
        run = np.concatenate([[True], marked[1:] > marked[:-1] + 1]) if len(marked) else np.zeros(0, bool)
        x, y = marked[run], marked[np.append(run[1:], True)] if len(marked) else marked
        piece = np.searchsorted(head, x, "right") - 1
        ctx.append(i[piece])
        start.append(lo[piece] + x - head[piece])
        end.append(lo[piece] + y - head[piece] + length)
    return np.concatenate(ctx), np.concatenate(start), np.concatenate(end)


def _code(kind: int, a, b):
    """kind, start and end of a mark as one integer; texts are below 2^30 bytes."""
    return (F.lit(kind).cast("long") * (1 << 60)) + a.cast("long") * (1 << 30) + b.cast("long")


def index_marks(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """rows (h, doc_id, start, lead, context), sorted by h within partitions -> doc_id, code of removed stretches."""

    def solve(part):
        ids, starts, leads, texts = part
        keys, starts = np.array(ids, np.int64), np.array(starts, np.int64)
        _, doc = np.unique(keys, return_inverse=True)
        ctx, a, b = earlier(texts, np.array(leads, np.int64), doc.astype(np.int64) * (1 << 31) + starts, length, gram)
        codes = (2 << 60) + ((starts[ctx] + a) << 30) + starts[ctx] + b
        return pa.RecordBatch.from_arrays([pa.array(keys[ctx]), pa.array(codes)], ["doc_id", "code"])

    def run(batches):
        held, group, last = ([], [], [], []), ([], [], [], []), None
        for b in batches:
            for h, *row in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if h != last:
                    for u, v in zip(held, group, strict=True):
                        u.extend(v)
                    group, last = ([], [], [], []), h
                    if len(held[0]) >= CHUNK:
                        yield solve(held)
                        held = ([], [], [], [])
                for u, v in zip(group, row, strict=True):
                    u.append(v)
        for u, v in zip(held, group, strict=True):
            u.extend(v)
        if held[0]:
            yield solve(held)

    return rows.select("h", "doc_id", "start", "lead", "context").mapInArrow(run, "doc_id long, code long")


def quarters_of(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """The quarters of contexts: core and whole (digests), doc_id, at (of the first string), bytes."""

    def run(batches):
        for b in batches:
            out = ([], [], [], [], [])
            keys, starts, leads, texts = (b.column(i).to_pylist() for i in range(4))
            if not keys:
                continue
            d = lambda x: hashlib.blake2b(x, digest_size=16).digest()
            for i, k, lo, hi, c0, c1 in split_contexts(np.array([len(x) for x in texts]), np.array(leads), length, gram).tolist():
                x = texts[i]
                row = (d(b"%d:" % k + x[c0:c1]), d(b"%d:" % (c0 - lo) + x[lo : hi + length]), keys[i], starts[i] + lo, x[lo : hi + length])
                for col, v in zip(out, row, strict=True):
                    col.append(v)
            kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["core", "whole", "doc_id", "at", "bytes"])

    return rows.select("doc_id", "start", "lead", "context").mapInArrow(run, "core binary, whole binary, doc_id long, at int, bytes binary")


def strings_of(rows: DataFrame, length: int) -> DataFrame:
    """All strings of each stretch by digest: digest, doc_id, at."""

    def run(batches):
        for b in batches:
            d, k, a = [], [], []
            for key, s, x in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                d += [hashlib.blake2b(x[i : i + length], digest_size=16).digest() for i in range(len(x) - length + 1)]
                k += [key] * (len(x) - length + 1)
                a += range(s, s + len(x) - length + 1)
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.binary()), pa.array(k, pa.int64()), pa.array(a, pa.int32())], ["digest", "doc_id", "at"])

    return rows.select("doc_id", "at", "bytes").mapInArrow(run, "digest binary, doc_id long, at int")


def common_marks(rows: DataFrame, scratch: Scratch, length: int, gram: int) -> DataFrame:
    """doc_id, code of removed stretches, for contexts of anchors too common for one index: all by partial aggregation."""
    place = lambda: F.struct("doc_id", "at")
    part = scratch.keep(quarters_of(rows, length, gram))
    first = part.groupBy("core", "whole").agg(F.min(place()).alias("f"))
    again = part.join(first, ["core", "whole"])
    late = again.filter(place() > F.col("f")).select("doc_id", _code(2, F.col("at"), F.col("at") + F.length("bytes")).alias("code"))
    several = first.groupBy("core").agg(F.count("*").alias("n")).filter("n > 1").select("core")
    strings = strings_of(again.filter(place() == F.col("f")).join(several, "core"), length).distinct()
    one = strings.groupBy("digest").agg(F.min(place()).alias("f"))
    return late.unionAll(strings.join(one, "digest").filter(place() > F.col("f")).select("doc_id", _code(2, F.col("at"), F.col("at") + length).alias("code")))


def contexts_of(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """rows (doc_id, size, z, wanted array<struct<at,h,hot>>) -> h, doc_id, start, lead (place of the anchor in the context), context, hot."""
    w = length - gram

    def run(batches):
        for b in batches:
            out = ([], [], [], [], [], [])
            for key, size, z, wanted in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                raw = pa.decompress(z, size, "zstd", asbytes=True) if size else b""
                for x in wanted:
                    s = max(0, x["at"] - w)
                    for col, v in zip(out, (x["h"], key, s, x["at"] - s, raw[s : x["at"] + length], x["hot"]), strict=True):
                        col.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["h", "doc_id", "start", "lead", "context", "hot"])

    return docs.select("doc_id", "size", "z", "wanted").mapInArrow(run, "h long, doc_id long, start int, lead int, context binary, hot boolean")


def removed(raw: bytes, codes, length: int, gram: int) -> np.ndarray:
    """Which bytes of a text its marks remove. Kinds: 0 an anchor that occurs again, 1 one whose context is the first of its kind, 2 a stretch."""
    n = len(raw)
    delta = np.zeros(n + 1, np.int64)
    if codes is None or not len(codes):
        return np.zeros(n, bool)
    x = np.asarray(codes, np.int64)
    kind, a, b = x >> 60, (x >> 30) & (2**30 - 1), x & (2**30 - 1)
    again = np.setdiff1d(a[kind == 0], a[kind == 1])
    np.add.at(delta, np.concatenate([np.maximum(again - (length - gram), 0), a[kind == 2]]), 1)
    np.add.at(delta, np.concatenate([np.minimum(again + length, n), b[kind == 2]]), -1)
    return np.cumsum(delta)[:n] > 0


def ordered(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """doc_id and text, with doc_ids that name one text each; and, where they had to be numbered anew for that, what they were: node, doc_id, digest."""
    own = docs.select("doc_id", "text", row_key("text").alias("digest"))
    ids = scratch.keep(own.select("doc_id", "digest").distinct())
    several = ids.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 OR doc_id IS NULL")
    if several.isEmpty():
        scratch.drop(ids)
        return docs.select("doc_id", "text"), None
    order = [F.col("doc_id").asc_nulls_last(), F.col("digest").asc()]
    names = scratch.keep(ids.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("node", F.monotonically_increasing_id()))
    same = F.col("d.doc_id").eqNullSafe(F.col("n.doc_id")) & (F.col("d.digest") == F.col("n.digest"))
    return scratch.keep(own.alias("d").join(names.alias("n"), same).select(F.col("node").alias("doc_id"), "text")), names


def marks(docs: DataFrame, scratch: Scratch, length: int = LENGTH, gram: int = GRAM, most: int = MOST) -> DataFrame:
    """doc_id and codes: all marks of each text that has some."""
    spark = docs.sparkSession

    def keep(df):
        with arrow_rows(spark, 1000):
            out = scratch.keep(df)
        gc.collect()
        spark.sparkContext._jvm.System.gc()  # shuffle files of finished steps go
        return out

    again = keep(anchor_rows(docs, length, gram, True).groupBy("h").count().filter("count > 1").select("h"))
    seen = keep(anchor_rows(docs, length, gram, False).join(again, "h"))
    scratch.drop(again)
    firsts = keep(seen.groupBy("h", "c").agg(F.min(F.struct("doc_id", "at")).alias("f")).select("h", "c", "f.*"))
    several = firsts.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    wanted = firsts.join(several, "h").select("doc_id", F.struct("at", "h", (F.col("n") > most).alias("hot")).alias("x"))
    contexts = keep(contexts_of(packed(docs).dropDuplicates(["doc_id"]).join(wanted.groupBy("doc_id").agg(F.collect_list("x").alias("wanted")), "doc_id"), length, gram))
    indexed = index_marks(contexts.filter("NOT hot").repartition("h").sortWithinPartitions("h", "doc_id", "start"), length, gram)
    stretches = keep(indexed)
    if not contexts.filter("hot").isEmpty():
        stretches = keep(stretches.unionAll(common_marks(contexts.filter("hot"), scratch, length, gram)))
    scratch.drop(contexts)
    zero = F.lit(0)
    codes = seen.select("doc_id", _code(0, F.col("at"), zero).alias("code")).unionAll(firsts.select("doc_id", _code(1, F.col("at"), zero).alias("code"))).unionAll(stretches)
    return codes.groupBy("doc_id").agg(F.collect_list("code").alias("codes"))


def finish(docs: DataFrame, found: DataFrame, schema: str, row, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Applies row(raw bytes, removed mask) to every text."""
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string()}
    types = [kinds[x.split()[1]] for x in schema.split(", ")]

    def run(batches):
        for b in batches:
            out = []
            for key, size, z, codes in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                raw = pa.decompress(z, size, "zstd", asbytes=True) if size else b""
                out.append((key, *row(raw, removed(raw, codes, length, gram))))
            cols = list(zip(*out, strict=True)) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types, strict=True)], names)

    joined = packed(docs).join(found, "doc_id", "left")
    return joined.select("doc_id", "size", "z", "codes").mapInArrow(run, schema)


def digest(raw: bytes, gone: np.ndarray):
    spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes() if spans else raw
    return len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()


def kept_text(raw: bytes, gone: np.ndarray):
    """What is left as text; bytes of characters that lost a part go too."""
    return int(gone.sum()), (np.frombuffer(raw, np.uint8)[~gone].tobytes() if len(gone) else b"").decode("utf-8", "ignore")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return removed_digests(table(spark, sf_dir, "documents"))


def removed_digests(docs: DataFrame, most: int = MOST) -> DataFrame:
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "substring")
    with arrow_rows(spark, 1000):
        own, names = ordered(drop_inputs(docs, "doc_id", "text"), scratch)
        out = scratch.keep(finish(own, marks(own, scratch, most=most), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", digest))
        return out if names is None else scratch.keep(out.withColumnRenamed("doc_id", "node").join(names, "node").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with what is left of their texts; those that lose everything go."""
    two = drop_inputs(docs, "doc_id", "text")
    scratch = Scratch(spark, "substring")
    with arrow_rows(spark, 1000):
        own, names = ordered(two, scratch)
        left = finish(own, marks(own, scratch), "doc_id long, n_removed long, left string", kept_text).filter("n_removed > 0").dropDuplicates(["doc_id"])
        left = scratch.keep(left if names is None else left.withColumnRenamed("doc_id", "node").join(names, "node").drop("node"))
    left = left.select(F.struct(*left.columns).alias(fresh(docs, "_left")))
    left_ = left.columns[0]
    of = lambda c: F.col(f"{left_}.{c}")
    same = F.col("doc_id") == of("doc_id")
    if names is not None:
        same = F.col("doc_id").eqNullSafe(of("doc_id")) & (row_key("text") == of("digest"))
    joined = docs.join(left, same, "left").filter(F.col(left_).isNull() | (F.length(of("left")) > 0))
    text = F.coalesce(of("left"), F.col("text"))
    return joined.select(*[text.alias("text") if c == "text" else F.length(text).cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def oracle() -> str:
    """Every 100-byte string of every document by its digest, in DuckDB (bytes as two hexadecimal digits each)."""
    return """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, length(hex(encode(coalesce(text, '')))) // 2 AS n FROM documents),
s AS (SELECT doc_id, i, md5(h[2 * i + 1 : 2 * i + 200]) AS g FROM (SELECT doc_id, h, unnest(range(0, greatest(n - 99, 0))) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS r FROM s) WHERE r > 1),
p AS (SELECT doc_id, i, sum(CASE WHEN i > was + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS was FROM r)),
g AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM p GROUP BY doc_id, k),
o AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS was FROM g),
c AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(h[2 * was + 1 : 2 * a], '' ORDER BY a) || any_value(h)[2 * max(b) + 1 :] AS kept FROM o JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(from_hex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN c USING (doc_id)"""
