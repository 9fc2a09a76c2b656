"""Near-duplicates by DartMinHash on word shingles.

Elements are windows of five words (a shorter text is one element), weighted by how often they occur. Hashed darts
fall on (weight, rank) cells of each element, and those within the element's weight count; the earliest dart of each coordinate
makes the signature, so that two documents agree in a coordinate with the probability of their weighted Jaccard similarity.
Weight cells double in width, so an element costs the logarithm of its weight; only the cells of low rank
are looked at: about t ln t darts a document, however long it is.

Exact copies are one node from the start. Equal bands make a bucket; members are compared with its leader, exactly,
on all shingles, which joins most of what belongs together. Then the members of each bucket with several classes are compared with one another,
block by block: a pair is skipped only if it is in one class by then, or if element counts show it to be below the threshold. So every
pair with an equal band is in one class or has been compared, no more links come out than a block has members,
and a group of copies may hold any share of the rows. Classes are the connected components of the links.

Every row is judged by its own text: rows that repeat a doc_id with another text, and rows without one, are nodes like any other, and
each row returns. Null texts and texts without a word are classes of their own. A class is named by its least doc_id (null if no
row of it has one); ties in signatures go to the greater hash, of rows with equal doc_id and text all count as the same document.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytes_ import batches_of, mix, powers, words_of
from .common import Scratch, arrow_rows, drop_inputs, fresh, small, table
from .substring_dedup import packed, unpacked

WIDTH = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 4
BLOCK, BLOCK_ELEMENTS = 2048, 2_000_000  # members of a bucket, and elements of theirs, that meet in one task
SKETCH = 256  # parts of the hash range that elements are counted in: the sum of the lesser counts bounds what two texts share
#: Rank cells: six narrow ones up to 2, then doubling. A cell of width w holds a Poisson(w) number of darts of each element.
EDGES = [0.0, 1 / 16, 1 / 8, 1 / 4, 1 / 2, 1.0, *[2.0**k for k in range(1, 12)]]


@lru_cache(None)
def poisson(mean: float) -> np.ndarray:
    """Cumulative distribution, for drawing a number of darts from a uniform hash."""
    k = np.arange(int(mean + 12 * mean**0.5 + 16))
    logs = -mean + k * np.log(mean) - np.cumsum(np.log(np.maximum(k, 1)))
    return np.cumsum(np.exp(logs))


def unit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


def shingles(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Element hashes of all texts of a chunk, the text each belongs to and its weight there; sorted by text, then hash."""
    first, last, doc = words_of(data, starts, ends)
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = mix(powers.spans(data, first, last) ^ mix((last - first).astype(np.uint64)))
    n = np.bincount(doc, minlength=len(starts))
    begin = np.concatenate([[0], np.cumsum(n)[:-1]])
    place = np.arange(len(word)) - begin[doc]
    take = (place + width <= n[doc]) | (place == 0)
    at = np.flatnonzero(take)
    out = np.full(len(at), 0x9E3779B97F4A7C15, np.uint64)
    for k in range(width):
        inside = place[at] + k < n[doc[at]]
        nxt = word[np.minimum(at + k, len(word) - 1)]
        out = np.where(inside, mix(out * np.uint64(0x100000001B3) + nxt), out)
    owner = doc[at]
    order = np.lexsort((out, owner))
    o, h = owner[order], out[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    head = np.flatnonzero(new)
    return h[head], o[head], np.diff(np.append(head, len(h)))


def unrolled(h: np.ndarray, o: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The j-th occurrence of an element as one of its own, so that sets of them have the weighted Jaccard similarity."""
    times = (np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)).astype(np.uint64)
    h = np.repeat(h, weight)
    return np.where(times > 0, mix(h + times * np.uint64(0xD6E8FEB86659FD93)), h), np.repeat(o, weight)


def thrown(e: np.ndarray, o: np.ndarray, weight: np.ndarray, level: int, cell: int, low: float, high: float):
    """Darts of elements in one cell of the plane, as (text, dart, rank): weights from 2^(level - 1) to 2^level (level 0: up to 1), ranks from low to high."""
    floor, wide = (0.0, 1.0) if level == 0 else (2.0 ** (level - 1), 2.0 ** (level - 1))
    pieces = max(1, int(np.ceil((high - low) * wide / 64)))  # keeps the mean of one draw at 64 or less
    step = (high - low) / pieces
    cdf = poisson(step * wide)
    for piece in range(pieces):
        seed = mix(e + np.uint64((cell * 0x9E3779B97F4A7C15 + piece * 0xC2B2AE3D27D4EB4F + level * 0x165667B19E3779F9) & (2**64 - 1)))
        u = unit(seed)
        some = np.flatnonzero(u >= cdf[0])
        count = np.searchsorted(cdf, u[some], "right")
        at = np.repeat(some, count)
        if not len(at):
            continue
        which = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
        dart = mix(seed[at] + (which.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
        rank = low + step * (piece + unit(mix(dart ^ np.uint64(0xA0761D6478BD642F))))
        if level:
            hit = floor + wide * unit(mix(dart ^ np.uint64(0x8EBC6AF09C88C6E3))) < weight[at]
            at, dart, rank = at[hit], dart[hit], rank[hit]
        yield o[at], dart, rank


def signatures(elements: np.ndarray, owner: np.ndarray, weight: np.ndarray, docs: int, t: int) -> np.ndarray:
    """docs x t matrix of dart identities; rows of texts without elements are 0."""
    sig = np.zeros(docs * t, np.uint64)
    left = np.bincount(owner, minlength=docs) > 0
    e, o, w = elements, owner, weight
    cell = 0
    while len(e):
        low, high = (EDGES[cell], EDGES[cell + 1]) if cell + 1 < len(EDGES) else (EDGES[-1] * 2.0 ** (cell + 1 - len(EDGES)), EDGES[-1] * 2.0 ** (cell + 2 - len(EDGES)))
        found, level = [], 0
        i = np.arange(len(e))
        while len(i):
            found += thrown(e[i], o[i], w[i], level, cell, low, high)
            i = i[w[i] > 2.0**level]
            level += 1
        if found:
            at, dart, rank = (np.concatenate(x) for x in zip(*found, strict=True))
            flat = at * t + (dart % np.uint64(t)).astype(np.int64)
            free = sig[flat] == 0
            flat, dart, rank = flat[free], dart[free], rank[free]
            order = np.lexsort((dart, -rank))
            sig[flat[order]] = dart[order] | np.uint64(1)
        left &= ~(sig.reshape(docs, t) != 0).all(1)
        go = left[o]
        e, o, w = e[go], o[go], w[go]
        cell += 1
    return sig.reshape(docs, t)


def bands_of(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.zeros((len(sig), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(sig), b + 1, np.uint64)
        for r in range(rows):
            h = mix(h * np.uint64(0x100000001B3) + sig[:, b * rows + r])
        out[:, b] = h
    return out


def digest_of(text: Column) -> Column:
    """What ``sketch`` calls copy, by Spark."""
    return F.substring(F.unhex(F.sha2(text.cast("binary"), 256)), 1, 16)


def sketch(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, width: int = WIDTH) -> DataFrame:
    """doc_id, copy (16 bytes of the text's SHA-256) and bands (null for texts without words)."""

    def run(batches):
        for keys, data, starts, ends in batches_of(batches):
            e, o, w = shingles(data, starts, ends, width)
            some = np.bincount(o, minlength=len(starts)) > 0
            b = bands_of(signatures(e, o, w, len(starts), bands * rows), bands, rows).astype(np.int64)
            raw = data.tobytes()
            copy = [hashlib.sha256(raw[i:j]).digest()[:16] for i, j in zip(starts, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([keys, pa.array(copy, pa.binary()), pa.array([x.tolist() if s else None for x, s in zip(b, some, strict=True)], pa.list_(pa.int64()))], ["doc_id", "copy", "bands"])

    return drop_inputs(docs, "doc_id", "text").mapInArrow(run, "doc_id long, copy binary, bands array<long>")


def vectors(texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """packed texts (node, size, z) -> a (the node), and the number and sorted hashes of its unrolled elements, these as one binary value."""

    def run(batches):
        for keys, data, starts, ends in batches_of(unpacked(batches)):
            e, o = unrolled(*shingles(data, starts, ends, width))
            order = np.lexsort((e, o))
            e, cut = e[order], np.concatenate([[0], np.cumsum(np.bincount(o, minlength=len(starts)))])
            yield pa.RecordBatch.from_arrays([keys, pa.array(np.diff(cut)), pa.array([e[cut[i] : cut[i + 1]].tobytes() for i in range(len(starts))], pa.binary())], ["a", "n", "v"])

    return texts.select("node", "size", "z").mapInArrow(run, "a long, n long, v binary")


def similar(pairs: DataFrame, least: float) -> DataFrame:
    """pairs (a, b, va, vb) -> a, b, ok: weighted Jaccard similarity of at least ``least``."""

    def run(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                if min(len(p), len(q)) < least * max(len(p), len(q)):
                    ok.append(False)
                    continue
                both = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(bool(both >= least * (len(p) + len(q) - both)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], ["a", "b", "ok"])

    return pairs.select("a", "b", "va", "vb").mapInArrow(run, "a long, b long, ok boolean")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """links (a, b) -> a, class: the least id that is connected with it. Labels spread over links, then jump to their label's label."""
    both = scratch.keep(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = scratch.keep(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("label")))
    while True:
        near = both.join(labels.select(F.col("a").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        spread = scratch.keep(labels.join(near, "a").select("a", F.least("label", "near").alias("label"), F.col("label").alias("was")))
        jump = spread.select(F.col("a").alias("label"), F.col("label").alias("next"))
        new = scratch.keep(spread.join(jump, "label").select("a", F.least("label", "next").alias("label"), "was"))
        changed = not new.filter("label <> was").isEmpty()
        scratch.drop(spread, labels)
        labels = new
        if not changed:
            return labels.select("a", F.col("label").alias("class"))


def spanning(ids: np.ndarray, classes: np.ndarray, sides: np.ndarray | None, vs: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links between similar texts of different classes, one for each pair of classes that it joins. With sides, only pairs across them."""
    n = np.array([len(v) for v in vs])
    counts = np.stack([np.bincount((v >> np.uint64(56)).astype(np.int64), minlength=SKETCH) for v in vs]).astype(np.uint32)
    classes, out = classes.copy(), []
    for x in range(1, len(ids)):
        y = np.flatnonzero((classes[:x] != classes[x]) & (np.minimum(n[:x], n[x]) >= least * np.maximum(n[:x], n[x])))
        if sides is not None:
            y = y[sides[y] != sides[x]]
        if not len(y):
            continue
        both = np.minimum(counts[y], counts[x]).sum(1, dtype=np.int64)
        for z in y[both >= least * (n[y] + n[x] - both)]:
            if classes[z] != classes[x]:
                same = len(np.intersect1d(vs[x], vs[z], assume_unique=True))
                if same >= least * (n[x] + n[z] - same):
                    out.append((int(ids[x]), int(ids[z])))
                    classes[classes == classes[z]] = classes[x]
    return out


def unresolved(exploded: DataFrame, label: DataFrame, vec: DataFrame, least: float) -> DataFrame:
    """a, b: links that join the classes of each bucket as all its pairs would. Large buckets are dealt by pairs of blocks."""
    known = exploded.join(label, "a", "left").withColumn("class", F.coalesce("class", "a"))
    sizes = known.join(vec.select("a", "n"), "a").groupBy("bucket").agg(F.count("*").alias("size"), F.sum("n").alias("n"), F.min("class").alias("one"), F.max("class").alias("other")).filter("size > 2 AND one <> other")
    parts = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("n") / BLOCK_ELEMENTS)).cast("int")
    rows = known.join(sizes.select("bucket", parts.alias("parts")), "bucket").withColumn("r", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int"))
    rows = rows.join(vec, "a").withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("bucket", F.least("r", "o").alias("i"), F.greatest("r", "o").alias("j"), "r", "a", "class", "v")

    def run(t: pa.Table) -> pa.Table:
        across = t.column("i")[0].as_py() != t.column("j")[0].as_py()
        r, ids, classes = (t.column(c).to_numpy() for c in ("r", "a", "class"))
        order = np.argsort(ids)
        vs = [np.frombuffer(v.as_buffer(), np.uint64) for v in t.column("v")]
        links = spanning(ids[order], classes[order], r[order] if across else None, [vs[k] for k in order], least)
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return rows.groupBy("bucket", "i", "j").applyInArrow(run, "a long, b long")


def linked(exploded: DataFrame, vec_of, scratch: Scratch, similarity: float) -> DataFrame:
    """exploded (a, bucket), vec_of(nodes) -> a, class of the nodes that are linked with another."""
    spark = exploded.sparkSession
    shared = exploded.groupBy("bucket").agg(F.min("a").alias("b"), F.max("a").alias("z")).filter("b <> z")
    pairs = scratch.keep(exploded.join(shared.select("bucket", "b"), "bucket").filter("a <> b").select("a", "b").distinct())
    vec = vec_of(pairs.select("a").union(pairs.select("b")).distinct())
    with arrow_rows(spark, 1000):
        links = scratch.keep(similar(pairs.join(vec.select("a", F.col("v").alias("va")), "a").join(vec.select(F.col("a").alias("b"), F.col("v").alias("vb")), "b"), similarity).filter("ok").select("a", "b"))
    label = components(links, scratch)
    more = scratch.keep(unresolved(exploded, label, vec, similarity))
    if not more.isEmpty():
        label = components(scratch.keep(links.union(more).distinct()), scratch)
    scratch.drop(vec, pairs)
    return label


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, width: int = WIDTH) -> DataFrame:
    """doc_id, copy (digest of the text), class_id and kept (it is the document that stays of its class) of every row."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    docs = drop_inputs(docs, "doc_id", "text")
    with arrow_rows(spark, 1000):
        sk = scratch.keep(sketch(docs, bands, rows, width))
    # One node for each different text; its id is fixed by being written.
    nodes = sk.filter("bands IS NOT NULL").groupBy("copy").agg(F.min("doc_id").alias("first"), F.first("bands").alias("bands"))
    nodes = scratch.keep(nodes.withColumn("node", F.monotonically_increasing_id()))

    def vec_of(needed):
        """Vectors of nodes, from the text of each one's first document."""
        one = nodes.select("node", F.col("copy").alias("c"), "first").join(needed.withColumnRenamed("a", "node").hint("merge"), "node", "left_semi")
        texts = packed(docs.select("doc_id", "text", digest_of(F.col("text")).alias("copy")), "copy")
        found = texts.join(one.hint("merge"), F.col("doc_id").eqNullSafe(F.col("first")) & (F.col("copy") == F.col("c")))
        with arrow_rows(spark, 1000):
            return scratch.keep(vectors(found, width).dropDuplicates(["a"]))

    exploded = scratch.keep(nodes.select(F.col("node").alias("a"), F.explode("bands").alias("bucket")))
    label = linked(exploded, vec_of, scratch, similarity)
    scratch.drop(exploded)
    # The least doc_id names a class; the row that stays has it (and of several texts of that doc_id, the least digest).
    of = nodes.join(label.withColumnRenamed("a", "node"), "node", "left").select("copy", "first", F.coalesce("class", "node").alias("class"))
    head = of.groupBy("class").agg(F.min(F.struct(F.col("first").isNull().alias("none"), "first", "copy")).alias("h"))
    named = scratch.keep(of.join(head, "class").select("copy", F.col("h.first").alias("class_id"), F.col("h.copy").alias("head")))
    scratch.drop(nodes)
    out = sk.select("doc_id", "copy", F.col("bands").isNull().alias("alone")).join(named, "copy", "left")
    kept = F.col("alone") | F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("copy") == F.col("head"))
    return out.select("doc_id", "copy", F.when(F.col("alone"), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), kept.alias("kept"))


def op10_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id of every document."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays; of rows that agree in doc_id and text, one."""
    key = lambda copy: F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.hex(copy))
    name = fresh(docs, "_key")
    gone = near_duplicates(docs).filter("NOT kept").select(key(F.col("copy")).alias(name)).distinct()
    keyed = docs.withColumn(name, key(digest_of(F.col("text"))))
    return keyed.join(gone, name, "left_anti").dropDuplicates([name]).select(*[F.col(f"`{c}`") for c in docs.columns])


def oracle() -> str:
    """Classes of all pairs' exact similarities, in DuckDB; no bands."""
    return """WITH RECURSIVE w AS (SELECT min(doc_id) AS id, list_filter(regexp_split_to_array(text, '[ \\t-\\r]+'), lambda v: v <> '') AS ws, text FROM documents WHERE regexp_matches(text, '[^ \\t-\\r]') GROUP BY text),
e AS (SELECT id, array_to_string(ws[i : i + 4], ' ') AS g FROM (SELECT id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w)),
n AS (SELECT id, g, count(*) AS n FROM e GROUP BY ALL), size AS (SELECT id, sum(n) AS n FROM n GROUP BY id),
pair AS (SELECT a.id AS a, b.id AS b, sum(least(a.n, b.n)) AS k FROM n a JOIN n b ON a.g = b.g AND a.id < b.id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN size x ON x.id = a JOIN size y ON y.id = b WHERE 5 * k >= 4 * (x.n + y.n - k)),
step AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(a, b) AS (SELECT id, id FROM w UNION SELECT r.a, s.b FROM reach r JOIN step s ON r.b = s.a),
class AS (SELECT a AS id, min(b) AS class_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id FROM documents d LEFT JOIN (SELECT text, class_id FROM w JOIN class USING (id)) c ON d.text = c.text"""


__all__ = ["components", "near_duplicates", "op10_dart_minhash", "oracle", "signatures", "small", "stage"]
