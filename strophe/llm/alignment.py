"""Cross-tokenizer alignment: groups of tokens of two tokenizers that cover the same bytes, and the id pairs linked in most documents.

Both tokenizers cut a text at the places where their tokens end together. Neither lets a token reach over a space that follows another character (checked
on the second one's pieces when it is loaded), so each different word, with the space before it, is encoded and aligned once in a worker, and texts
are sequences of words. A text counts only if the bytes of either's tokens are its own.

Id pairs are counted in dense matrices: ids of the first tokenizer are dealt to ``STRIPES`` stripes, and the pairs that a task has seen (with the number of
its documents that hold each, summed in the task) go to their stripe by one shuffle. A stripe is one block of its ids by all ids of the second
tokenizer, filled by np.add.at; the maxima of its rows give each id's best. Links are packed by chunk of documents and by lane (a few stripes
together); they meet the counts of their lane in one task, which reads the counts first and streams the links past them; a lane with many links is
dealt to several tasks, each with the lane's counts. What a chunk's lanes give is summed by document. Memory: a block, a lane's counts, one chunk; all
bounded by the vocabularies and the size of a chunk, none by the corpus. No id, pair or document is left out.

A null or empty text, and one whose tokens' bytes differ from it, has no tokens (zeros, ''). Every row is a document of its own for the counts, also rows
that repeat or have a null doc_id. A very long text is a chunk of its own, encoded whole. Equal counts are all best. Columns beyond doc_id and text
play no part. An empty table gives none.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, drop_inputs, table
from .sentencepiece_tokens import BYTE, MARK, NORMAL, USER, parse_model, read_model

STRIPES = 512
LANES = 32  # that links are dealt to; a stripe's lane is its number modulo this
CHUNK = 2_000_000  # characters
LANE_BYTES = 64_000_000  # of packed links for a task
BASE, LINKS, COUNTS = 0, 1, 2
CUT = re.compile(r"(?<=\S)(?= )")
#: Fixed value: how byte-level texts are cut before their merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG = 200  # characters from which a word is encoded by itself
CHECK = 64  # one word in so many is encoded by both encoders of the first model
MANY = 4096  # links of a group that are made one by one
UNEVEN = re.compile(r" (?<=\s )")  # a space behind white space


def read_byte_model(path: str | None = None) -> bytes:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, "rb") as f:
        return f.read()


def byte_alphabet() -> dict[str, int]:
    """The byte of each character of byte-level tokens: printable bytes are themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of integers, none negative, each in the narrowest type, compressed together."""
    out = [struct.pack("<B", len(arrays))]
    for a in arrays:
        kind = np.min_scalar_type(int(a.max())) if len(a) else np.dtype(np.uint8)
        out += [struct.pack("<BQ", kind.itemsize, len(a)), a.astype(kind).tobytes()]
    return zstandard.ZstdCompressor(3).compress(b"".join(out))


def unpack(data: bytes) -> list[np.ndarray]:
    b, out, at = zstandard.ZstdDecompressor().decompress(data), [], 1
    for _ in range(b[0]):
        size, n = struct.unpack_from("<BQ", b, at)
        out.append(np.frombuffer(b, f"<u{size}", n, at + 9).astype(np.int64))
        at += 9 + size * n
    return out


def steps(sorted_: np.ndarray) -> np.ndarray:
    return np.diff(sorted_, prepend=0)


class Aligner:
    """Words to aligned tokens of both models, many words at a time; up to ``most`` words are kept, with their parts numbered.

    All tokens of a batch of words stand in two arrays, so that ends, groups, links and the groups' texts come from array operations.
    """

    def __init__(self, first: bytes, second: bytes, most: int = 400_000):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        self.a = Tokenizer.from_str(first.decode())
        self.a.encode_special_tokens = True
        alphabet, vocab = byte_alphabet(), self.a.get_vocab(with_added_tokens=False)
        self.a_text = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a_text[i] = bytes([alphabet[c] for c in token])
        self.b = sentencepiece.SentencePieceProcessor(model_proto=second)
        m = parse_model(second)
        if m["collapse"] or m["charsmap"] or not (m["escape"] and m["prefix"]) or any(MARK in p.lstrip(MARK) for p, _, k in m["pieces"] if k in (NORMAL, USER)):
            raise ValueError("pieces of the second model reach over words")
        self.b_text = [bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARK, " ").encode() for p, _, k in m["pieces"]]
        self.sizes = tuple(np.array([len(t) for t in v], np.int64) for v in (self.a_text, self.b_text))
        # The same vocabulary and ranks for a quicker encoder of short plain words; a share of them is encoded by both.
        self.quick = tiktoken.Encoding("first", pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate(self.a_text) if t}, special_tokens={})
        self.marker, self.newline = self.b.piece_to_id(MARK), self.a_text.index(b"\n")
        self.width, self.most = len(self.b_text), most
        shown = [str(i).encode() for i in range(max(len(self.a_text), self.width))]
        self.digits = np.array([list(x.ljust(len(shown[-1]))) for x in shown], np.uint8)
        self.n_digits = np.array([len(x) for x in shown])
        self.clear()

    def clear(self) -> None:
        self.number, self.shown = {}, []  # of each word: its number; its groups as text, with a semicolon behind each, or None if its bytes differ
        self.totals = np.zeros((0, 4), np.int64)  # of each word: tokens of both models, groups, links
        self.n_codes, self.parts = np.zeros(0, np.int64), []  # of each word: how many links; a * width + b, and how often

    def words(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Different words (without the space that each begins with), the number of every word among them, and how many words each text has."""
        plain = [not (x[0] == " " or x[-1] == " " or UNEVEN.search(x)) for x in texts]
        cut = pc.split_pattern(pa.array([x if p else "" for x, p in zip(texts, plain, strict=True)], pa.large_string()), " ")
        if not all(plain):
            odd = iter([[w[1:] for w in CUT.split(" " + x)] for x, p in zip(texts, plain, strict=True) if not p])
            parts, at = [], 0
            for k in [k for k, p in enumerate(plain) if not p]:
                parts += [cut.slice(at, k - at).flatten(), pa.array(next(odd), pa.large_string())]
                at = k + 1
                plain[k] = len(parts[-1])
            flat = pa.concat_arrays([*parts, cut.slice(at).flatten()])
            n = np.where(np.array([p is not True for p in plain]), np.array(plain, np.int64), pc.list_value_length(cut).to_numpy())
        else:
            flat, n = cut.flatten(), pc.list_value_length(cut).to_numpy()
        coded = flat.dictionary_encode()
        return coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64), n.astype(np.int64)

    def encode_first(self, words: list[str], lines: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and how many each word has; the first ``lines`` words are short and without white space, and are encoded as one text of lines."""
        ids = np.array(self.quick.encode_ordinary("\n".join([" " + w for w in words[:lines]])), np.int64)
        n = np.diff(np.append(np.flatnonzero(ids == self.newline), len(ids)), prepend=-1) - 1 if lines else np.zeros(0, np.int64)
        rest = [self.quick.encode_ordinary(" " + w) if len(w) < LONG else self.a.encode(" " + w, add_special_tokens=False).ids for w in words[lines:]]
        n = np.append(n, [len(x) for x in rest]).astype(np.int64)
        ids = np.concatenate([ids[ids != self.newline], np.fromiter(chain.from_iterable(rest), np.int64)])
        starts = np.cumsum(n) - n
        for k, c in enumerate(self.a.encode_batch_fast([" " + w for w in words[::CHECK]], add_special_tokens=False)):
            if c.ids != ids[starts[k * CHECK] : starts[k * CHECK] + n[k * CHECK]].tolist():
                raise ValueError(f"the two encoders of the first model differ in {words[k * CHECK]!r}")
        return ids, n

    def encode_second(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        each = [x if w else [self.marker] for w, x in zip(words, self.b.encode(words, num_threads=1), strict=True)]
        n = np.array([len(x) for x in each], np.int64)
        return np.fromiter(chain.from_iterable(each), np.int64, n.sum()), n

    def learn(self, words: list[str]) -> None:
        plain, odd = [], []
        for w in words:
            (plain if len(w) < LONG and len(w.split()) == 1 and w.split()[0] == w else odd).append(w)
        for i in range(0, len(plain), 20_000):
            self.align(plain[i : i + 20_000], len(plain))
        for i in range(0, len(odd), 1_000):
            self.align(odd[i : i + 1_000], 0)

    def align(self, words: list[str], lines: int) -> None:
        (a, na), (b, nb) = self.encode_first(words, min(lines, len(words))), self.encode_second(words)
        text = [(" " + w).encode() for w in words]
        good = np.ones(len(words), bool)
        sizes, starts = np.array([len(x) for x in text], np.int64), (np.cumsum(na) - na, np.cumsum(nb) - nb)
        for ids, n, start, table, size in ((a, na, starts[0], self.a_text, self.sizes[0]), (b, nb, starts[1], self.b_text, self.sizes[1])):
            own = np.bincount(np.repeat(np.arange(len(words)), n), size[ids], len(words))
            if b"".join(map(table.__getitem__, ids.tolist())) != b"".join(text) or (own != sizes).any():
                good &= [b"".join([table[k] for k in ids[s : s + m]]) == x for s, m, x in zip(start, n, text, strict=True)]
        word_a, word_b = np.repeat(np.arange(len(words)), na), np.repeat(np.arange(len(words)), nb)
        a, b, word_a, word_b = a[good[word_a]], b[good[word_b]], word_a[good[word_a]], word_b[good[word_b]]
        ends_a, ends_b = np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b])
        both = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(both, ends_a), np.searchsorted(both, ends_b)
        in_a, in_b = np.bincount(group_a, minlength=len(both)), np.bincount(group_b, minlength=len(both))
        from_a, from_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        word = word_a[from_a] if len(both) else np.zeros(0, np.int64)
        per_word = lambda values, of: np.bincount(of, values, len(words)).astype(np.int64)
        totals = np.stack([na * good, nb * good, per_word(None, word), np.zeros(len(words), np.int64)], 1)
        # Links: every token of one side with every one of the other, but in a group of many by its different tokens.
        links = in_a * in_b
        totals[:, 3] = per_word(links, word)
        some = links <= MANY
        left = np.flatnonzero(some[group_a])
        m = in_b[group_a[left]]
        at = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(from_b[group_a[left]], m)
        codes, of = np.repeat(a[left], m) * self.width + b[at], np.repeat(word_a[left], m)
        times = np.ones(len(codes), np.int64)
        for g in np.flatnonzero(~some):
            x, n = np.unique(a[from_a[g] : from_a[g] + in_a[g]], return_counts=True)
            y, k = np.unique(b[from_b[g] : from_b[g] + in_b[g]], return_counts=True)
            codes = np.append(codes, (x[:, None] * self.width + y).ravel())
            times, of = np.append(times, (n[:, None] * k).ravel()), np.append(of, np.full(len(x) * len(y), word[g]))
        order = np.argsort(of, kind="stable")
        # Groups as text: both sides' tokens in order of their groups, each with the mark behind it.
        place_a, place_b = np.arange(len(a)) + from_b[group_a], np.arange(len(b)) + (from_a + in_a)[group_b]
        ids, marks, owner = (np.zeros(len(a) + len(b), np.int64) for _ in range(3))
        last_a, last_b = np.append(np.diff(group_a), 1) > 0, np.append(np.diff(group_b), 1) > 0
        ids[place_a], marks[place_a], owner[place_a] = a, np.where(last_a, ord("|"), ord(",")), word_a
        ids[place_b], marks[place_b], owner[place_b] = b, np.where(last_b, ord(";"), ord(",")), word_b
        cells = np.column_stack([self.digits[ids], marks.astype(np.uint8)])
        filled = np.column_stack([np.arange(self.digits.shape[1]) < self.n_digits[ids][:, None], np.ones(len(ids), bool)])
        shown, stops = cells[filled].tobytes(), np.cumsum(per_word(filled.sum(1), owner)).tolist()
        for w, start, stop, fine in zip(words, [0, *stops], stops, good.tolist(), strict=False):
            self.number[w] = len(self.shown)
            self.shown.append(shown[start:stop] if fine else None)
        self.totals = np.concatenate([self.totals, totals])
        self.n_codes = np.append(self.n_codes, per_word(None, of))
        self.parts.append((codes[order], times[order]))

    def chunk(self, texts: list[str | None]):
        """Totals (texts by 4), digests of the groups, and the links: codes, texts' numbers and times, sorted by code and text."""
        totals, digests = np.zeros((len(texts), 4), np.int64), [b""] * len(texts)
        owners, nothing = [d for d, x in enumerate(texts) if x], (totals, digests, *[np.zeros(0, np.int64)] * 3)
        if not owners:
            return nothing
        words, at, lengths = self.words([texts[d] for d in owners])
        new = [w for w in words if w not in self.number]
        if len(new) + len(self.number) > self.most:
            self.clear()
            new = words
        self.learn(new)
        numbers = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        shown = pa.array(map(self.shown.__getitem__, numbers.tolist()), pa.large_binary())
        # Groups of all words in a row: a text's are a slice. A text of which a word has none is left out.
        taken = shown.take(pa.array(at))
        data, starts = taken.buffers()[2], np.cumsum(lengths) - lengths
        cuts = np.frombuffer(taken.buffers()[1], np.int64, len(at) + 1)[np.append(starts, len(at))].tolist()
        good = np.logical_and.reduceat(taken.is_valid().to_numpy(False), starts)
        for d, fine, start, stop in zip(owners, good.tolist(), cuts, cuts[1:], strict=False):
            if fine:
                digests[d] = hashlib.sha256(data[start : stop - 1]).digest()  # but for the last semicolon
        owners, at, lengths = np.array(owners, np.int64)[good], at[np.repeat(good, lengths)], lengths[good]
        if not len(owners):
            return nothing
        key, n = np.unique(np.repeat(owners * len(words), lengths) + at, return_counts=True)
        owner, word = key // len(words), numbers[key % len(words)]
        totals[owners] = np.add.reduceat(self.totals[word] * n[:, None], np.flatnonzero(np.diff(owner, prepend=-1)))
        self.parts = [tuple(map(np.concatenate, zip(*self.parts, strict=True)))]
        codes, times = self.parts[0]
        starts, m = np.cumsum(self.n_codes) - self.n_codes, self.n_codes[word]
        inner = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(starts[word], m)
        key = codes[inner] * len(texts) + np.repeat(owner, m)
        order = np.argsort(key, kind="stable")
        key, t = key[order], (times[inner] * np.repeat(n, m))[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        return totals, digests, key[first] // len(texts), key[first] % len(texts), np.add.reduceat(t, first)


@lru_cache(1)
def aligner(first: bytes, second: bytes) -> Aligner:
    """One for each Python worker."""
    return Aligner(first, second)


PACKED = "key long, chunk long, size long, payload binary, kind int"
PACKED_ARROW = pa.schema([("key", pa.int64()), ("chunk", pa.int64()), ("size", pa.int64()), ("payload", pa.binary()), ("kind", pa.int32())])


def _packer(first: bytes, second: bytes, stripes: int, lanes: int, chunk_chars: int):
    def run(batches):
        align, part, made = aligner(first, second), TaskContext.get().partitionId(), 0
        seen = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]  # codes and numbers of documents, to be summed

        def rows(columns):
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*columns, strict=True), PACKED_ARROW, strict=True)], schema=PACKED_ARROW)

        def summed():
            codes, at = np.unique(np.concatenate([c for c, _ in seen]), return_inverse=True)
            n = np.zeros(len(codes), np.int64)
            np.add.at(n, at, np.concatenate([n for _, n in seen]))
            return codes, n

        def packed(keys, texts):
            nonlocal made, seen
            chunk, made = part << 32 | made, made + 1
            totals, digests, codes, docs, times = align.chunk(texts)
            there = np.array([k is not None for k in keys], np.int64)
            ids = np.array([k or 0 for k in keys], np.int64).view(np.uint64) if keys else np.zeros(0, np.uint64)
            base = pack(there, ids, *totals.T) + b"".join(digests)
            out = [(chunk, chunk, len(base), struct.pack("<Q", len(base) - 32 * sum(map(bool, digests))) + base, BASE)]
            lane = codes // align.width % stripes % lanes
            for k in np.unique(lane):
                mine = np.flatnonzero(lane == k)
                own = np.flatnonzero(np.diff(codes[mine], prepend=-1))
                data = pack(steps(codes[mine][own]), np.diff(own, append=len(mine)), docs[mine], times[mine])
                out.append((int(k), chunk, len(data), data, LINKS))
            own = np.flatnonzero(np.diff(codes, prepend=-1))
            seen.append((codes[own], np.diff(own, append=len(codes))))
            if sum(len(c) for c, _ in seen) > 3_000_000:
                seen = [summed()]
            return rows(out)

        keys, texts, size = [], [], 0
        for batch in batches:
            for k, x in zip(batch.column(0), batch.column(1), strict=True):
                keys.append(k.as_py())
                texts.append(x.as_py())
                size += len(texts[-1] or "") + 100
                if size >= chunk_chars:
                    yield packed(keys, texts)
                    keys, texts, size = [], [], 0
        if keys:
            yield packed(keys, texts)
        codes, n = summed()
        stripe, out = codes // align.width % stripes, []
        for k in np.unique(stripe):
            mine = stripe == k
            data = pack(steps(codes[mine]), n[mine])
            out.append((int(k), 0, len(data), data, COUNTS))
        if out:
            yield rows(out)

    return run


def _blocks(width: int, ids: int, stripes: int, lanes: int):
    """Counts of one stripe after the other, which come sorted: a dense block each, then its entries with their rows' maxima marked."""
    schema = pa.schema([("lane", pa.int64()), ("payload", pa.binary())])

    def run(batches):
        block, now = np.zeros((-(-ids // stripes), width), np.int64), None

        def done():
            best = block.max(axis=1)
            row, b = np.nonzero(block)
            n = block[row, b]
            out = pack(steps((row * stripes + now) * width + b), n, (n == best[row]).astype(np.int64))
            block[row, b] = 0
            return pa.RecordBatch.from_arrays([pa.array([now % lanes], pa.int64()), pa.array([out], pa.binary())], schema=schema)

        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if now is not None and key != now:
                    yield done()
                now = key
                codes, n = unpack(data.as_py())
                codes = np.cumsum(codes)
                np.add.at(block, (codes // width // stripes, codes % width), n)
        if now is not None:
            yield done()

    return run


def _scores(batches):
    """Of each lane the counts come first (chunk -1), then its links: each chunk's documents with their best links and sums of counts."""
    schema = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("payload", pa.binary())])
    now, counts, ready = None, [], None
    for batch in batches:
        out = []
        for lane, salt, chunk, data in zip(*[batch.column(i).to_pylist() for i in range(3)], batch.column(3), strict=True):
            if (lane, salt) != now:
                now, counts, ready = (lane, salt), [], None
            if chunk < 0:
                counts.append(unpack(data.as_py()))
                continue
            if ready is None:
                codes, n, best = np.concatenate([np.cumsum(c) for c, _, _ in counts]), np.concatenate([n for _, n, _ in counts]), np.concatenate([b for _, _, b in counts])
                order = np.argsort(codes)
                ready, counts = (codes[order], n[order], best[order]), []
            codes, runs, docs, times = unpack(data.as_py())
            at = np.repeat(np.searchsorted(ready[0], np.cumsum(codes)), runs)
            own, of = np.unique(docs, return_inverse=True)
            sums = np.zeros((2, len(own)), np.int64)
            np.add.at(sums[0], of, times * ready[2][at])
            np.add.at(sums[1], of, times * ready[1][at])
            out.append((chunk, LINKS, pack(steps(own), *sums)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


RESULT = pa.schema([("doc_id", pa.int64()), *[(n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")], ("groups_sha256", pa.string())])


def _sums(batches):
    """Of each chunk its documents come first, then what its lanes give."""
    now = None

    def done():
        there, ids, totals, sums, digests = now[1:]
        keys = pa.array(ids.view(np.int64), pa.int64(), mask=there == 0)
        return pa.RecordBatch.from_arrays([keys, *[pa.array(t, pa.int64()) for t in (*totals, *sums)], pa.array(digests, pa.string())], schema=RESULT)

    for batch in batches:
        for chunk, kind, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            data = data.as_py()
            if kind == BASE:
                if now is not None:
                    yield done()
                n = 8 + struct.unpack_from("<Q", data)[0]
                there, ids, *totals = unpack(data[8:n])
                shown = iter([data[i : i + 32].hex() for i in range(n, len(data), 32)])
                now = chunk, there, ids.astype(np.uint64), totals, np.zeros((2, len(ids)), np.int64), [next(shown) if t else "" for t in totals[0]]
            else:
                docs, best, counts = unpack(data)
                docs = np.cumsum(docs)
                now[4][0][docs] += best
                now[4][1][docs] += counts
    if now is not None:
        yield done()


def align(docs: DataFrame, first: bytes, second: bytes, stripes: int = STRIPES, lanes: int = LANES, chunk_chars: int = CHUNK, lane_bytes: int = LANE_BYTES) -> tuple[DataFrame, DataFrame]:
    """Rows of documents (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), and the packed counts of id pairs (for ``links``)."""
    spark = docs.sparkSession
    scratch, parts = Scratch(spark, "alignment"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = drop_inputs(docs, "doc_id", "text").selectExpr("CAST(doc_id AS bigint) AS doc_id", "text")
    packed = scratch.keep(rows.mapInArrow(_packer(first, second, stripes, lanes, chunk_chars), PACKED), by=("kind",))
    one = Aligner(first, second, 0)
    counts = packed.filter(F.col("kind") == COUNTS).select("key", "payload").repartition(parts, "key").sortWithinPartitions("key")
    counts = scratch.keep(counts.mapInArrow(_blocks(one.width, len(one.a_text), stripes, lanes), "lane long, payload binary"))
    links = packed.filter(F.col("kind") == LINKS)
    salts = [1] * lanes
    for r in links.groupBy("key").agg(F.sum("size").alias("n")).collect():  # as many rows as lanes
        salts[r["key"]] = -(-r["n"] // lane_bytes)
    of_lane = lambda c: F.element_at(F.array(*map(F.lit, salts)), c.cast("int") + 1)
    known = counts.select("lane", F.explode(F.sequence(F.lit(0).cast("long"), of_lane(F.col("lane")).cast("long") - 1)).alias("salt"), F.lit(-1).cast("long").alias("chunk"), "payload")
    asked = links.select(F.col("key").alias("lane"), F.pmod(F.xxhash64("chunk"), of_lane(F.col("key")).cast("long")).alias("salt"), "chunk", "payload")
    met = known.unionByName(asked).repartition(parts, "lane", "salt").sortWithinPartitions("lane", "salt", "chunk")
    given = met.mapInArrow(_scores, "chunk long, kind int, payload binary")
    own = packed.filter(F.col("kind") == BASE).select("chunk", "kind", "payload")
    out = own.unionByName(given).repartition(parts, "chunk").sortWithinPartitions("chunk", "kind")
    return out.mapInArrow(_sums, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"), counts


def pairs(counts: DataFrame, width: int) -> DataFrame:
    """a, b, n_docs and best of all id pairs, from the packed counts of ``align``."""

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                codes, n, best = unpack(data.as_py())
                codes = np.cumsum(codes)
                yield pa.RecordBatch.from_arrays([pa.array(codes // width), pa.array(codes % width), pa.array(n), pa.array(best == 1)], ["a", "b", "n_docs", "best"])

    return counts.select("payload").mapInArrow(run, "a long, b long, n_docs long, best boolean")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"), read_byte_model(), read_model())[0]
