"""SentencePiece encoding and decoding with the tokenizers library.

The model protobuf is read by hand, and its normaliser, metaspace marker, unigram scores or merge ranks and byte
fallback are rebuilt; whole texts are encoded in batches by several threads. Where no piece crosses words, each different word is encoded once. Ids are
decoded by a table of the pieces' bytes. The sentencepiece library encodes, and the rebuilt tokenizer decodes, a
fixed share of the texts (one in ``check_every``, by hash of doc_id) beside it, and any difference raises an error that names the doc_id: no table is written then. Its text shows
which rule of the model is not rebuilt; encode with sentencepiece until it is, as ids that differ would go unseen in the other texts.

A null text has no ids (null); an empty one has none ([]). Repeated rows (also of one doc_id with several texts), null doc_ids and extra columns don't matter.
A very long text is encoded whole, as a batch of its own. Of equal merges the leftmost goes first, as in sentencepiece.
The driver reads the model once (its path is a parameter) and sends half a MB to each task.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import zlib
from array import array
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import drop_inputs, table

NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # fixed values of the model format
MARK = "▁"
WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _varint(b: bytes, i: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        c = b[i]
        i, out, shift = i + 1, out | (c & 127) << shift, shift + 7
        if c < 128:
            return out, i


def fields(b: bytes):
    """(number, value) of each field of a protobuf message."""
    i = 0
    while i < len(b):
        tag, i = _varint(b, i)
        kind = tag & 7
        if kind == 0:
            value, i = _varint(b, i)
        else:
            n, i = (8, i) if kind == 1 else (4, i) if kind == 5 else _varint(b, i)
            value, i = b[i : i + n], i + n
        yield tag >> 3, value


def parse_model(b: bytes) -> dict:
    """pieces (text, score, kind), unigram or bpe, and the normaliser's settings."""
    out = {"pieces": [], "kind": 1, "prefix": True, "collapse": True, "escape": True, "charsmap": b"", "name": ""}
    for k, v in fields(b):
        if k == 1:
            d = dict(fields(v))
            out["pieces"].append((d[1].decode(), struct.unpack("<f", d[2])[0] if 2 in d else 0.0, d.get(3, NORMAL)))
        elif k == 2:
            out["kind"] = dict(fields(v)).get(3, 1)
        elif k == 3:
            d = dict(fields(v))
            out |= {"prefix": bool(d.get(3, 1)), "collapse": bool(d.get(4, 1)), "escape": bool(d.get(5, 1)), "charsmap": d.get(2, b""), "name": d.get(1, b"").decode()}
    return out


def merges_of(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """Pairs of pieces whose join is a piece, the best-scored join first; a piece's own splits in order of their parts' ranks."""
    rank = {p: (-s, i) for i, (p, s, k) in enumerate(pieces) if k in (NORMAL, USER)}
    out = []
    for p in rank:
        splits = [(p[:i], p[i:]) for i in range(1, len(p)) if p[:i] in rank and p[i:] in rank]
        out += [(rank[p], rank[a], rank[b], a, b) for a, b in splits]
    return [(a, b) for *_, a, b in sorted(out)]


def build(b: bytes, cache: int = 10_000):
    """A tokenizers.Tokenizer with the model's behaviour; BPE remembers up to ``cache`` words."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    m = parse_model(b)
    pieces = m["pieces"]
    unk = next(i for i, (_, _, k) in enumerate(pieces) if k == UNKNOWN)
    fallback = any(k == BYTE for *_, k in pieces)
    if m["kind"] == 1:
        model = models.Unigram([(p, s) for p, s, _ in pieces], unk, fallback)
    elif m["kind"] == 2:
        model = models.BPE({p: i for i, (p, _, _) in enumerate(pieces)}, merges_of(pieces), unk_token=pieces[unk][0], fuse_unk=True, byte_fallback=fallback, cache_capacity=cache)
    else:
        raise ValueError("only unigram and BPE models")
    t = Tokenizer(model)
    steps = [normalizers.Precompiled(m["charsmap"])] if m["charsmap"] else []
    if m["collapse"]:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
    if m["prefix"]:
        steps.append(normalizers.Prepend(MARK if m["escape"] else " "))
    if m["escape"]:
        steps.append(normalizers.Replace(" ", MARK))
    t.normalizer = normalizers.Sequence(steps)
    if m["kind"] == 2 and not any(MARK in p.lstrip(MARK) for p, _, k in pieces if k == NORMAL):
        # No piece crosses from a letter to a marker, so no merge does: words can be encoded, and remembered, one by one.
        t.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    parts = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    t.decoder = decoders.Sequence([*parts, decoders.Strip(" ", 1, 0)] if m["prefix"] else parts)
    return t


class Codec:
    """Whole texts to ids and back. Words are encoded once, in batches by two threads, and kept up to ``most`` words."""

    def __init__(self, model: bytes, most: int = 100_000):
        os.environ.setdefault("RAYON_NUM_THREADS", "2")  # a task's share of the cores
        self.whole, m = build(model, 0), parse_model(model)  # no word is encoded twice, so nothing need be remembered twice
        self.split, self.normalizer = self.whole.pre_tokenizer is not None, self.whole.normalizer
        if self.split:
            self.whole.normalizer = self.whole.pre_tokenizer = None
        self.words, self.most, self.plain = {True: {}, False: {}}, most, not (m["charsmap"] or m["collapse"]) and m["escape"] and m["prefix"]
        self.text = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else p.replace(MARK, " ").encode() for p, _, k in m["pieces"]]
        self.prefix = m["prefix"]

    def normal(self, x: str) -> str:
        return MARK + x.replace(" ", MARK) if self.plain and x else self.normalizer.normalize_str(x) if x else ""

    def cut(self, x: str) -> tuple[list[str], bool]:
        """The words of a text, and whether each has exactly one marker before it (which is left out then)."""
        if self.plain and x and MARK not in x and "  " not in x and x[0] != " " and x[-1] != " ":
            return x.split(" "), True
        return WORDS.findall(self.normal(x)), False

    def encode(self, texts: list[str]) -> list[array]:
        if not self.split:  # pieces may cross words: no shortcut
            return [array("i", c.ids) for c in self.whole.encode_batch_fast(texts, add_special_tokens=False)]
        cut = [self.cut(x) for x in texts]
        for marked, known in self.words.items():
            used = set().union(*(words for words, k in cut if k == marked))
            missing = list(used.difference(known))
            if len(known) + len(missing) > self.most:
                known.clear()
                missing = list(used)
            for i in range(0, len(missing), 20_000):
                some = missing[i : i + 20_000]
                codes = self.whole.encode_batch_fast([MARK + w for w in some] if marked else some, add_special_tokens=False)
                known.update(zip(some, (array("i", c.ids).tobytes() for c in codes), strict=True))
        return [array("i", b"".join(map(self.words[k].__getitem__, words))) for words, k in cut]

    def rebuilt(self, ids) -> str:
        """What the rebuilt tokenizer decodes."""
        return self.whole.decode(list(ids), skip_special_tokens=False)

    def decode(self, ids) -> str:
        x = b"".join([self.text[i] for i in ids]).decode("utf-8", "replace")
        return x[1:] if self.prefix and x[:1] == " " else x


@lru_cache(2)
def codec(model: bytes) -> Codec:
    """One for each Python worker."""
    return Codec(model)


def _coded(docs: DataFrame, model: bytes, schema: str, kinds: list[pa.DataType], row, check_every: int, batch_chars: int) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        import sentencepiece

        c, judge = codec(model), sentencepiece.SentencePieceProcessor(model_proto=model)

        def part(keys, texts):
            rows = []
            for k, x, ids in zip(keys, texts, c.encode([x or "" for x in texts]), strict=True):
                if x is None:
                    rows.append((k, *[None] * (len(names) - 1)))
                    continue
                back = c.decode(ids)
                if zlib.crc32(str(k).encode()) % check_every == 0 and (judge.encode(x) != list(ids) or c.rebuilt(ids) != back):
                    raise ValueError(f"doc_id {k}: the rebuilt tokenizer differs from sentencepiece")
                rows.append((k, *row(x, ids, back)))
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            keys, texts, size = [], [], 0
            for k, x in zip(batch.column(0), batch.column(1), strict=True):
                keys.append(k.as_py())
                texts.append(x.as_py())
                size += len(texts[-1] or "")
                if size >= batch_chars:
                    yield part(keys, texts)
                    keys, texts, size = [], [], 0
            if keys:
                yield part(keys, texts)

    return drop_inputs(docs, "doc_id", "text").mapInArrow(run, schema)


def encode(docs: DataFrame, model: bytes, check_every: int = 64, batch_chars: int = 500_000) -> DataFrame:
    """doc_id, ids array<int>, decoded string; batches of about ``batch_chars`` characters bound the memory."""
    return _coded(docs, model, "doc_id long, ids array<int>, decoded string", [pa.int64(), pa.list_(pa.int32()), pa.string()], lambda x, ids, back: (list(ids), back), check_every, batch_chars)


def digest(docs: DataFrame, model: bytes, check_every: int = 64, batch_chars: int = 500_000) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids as little-endian 32-bit integers), round_trip (decoding gives the text back)."""

    def row(x, ids, back):
        return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), back == x.replace(MARK, " ")

    return _coded(docs, model, "doc_id long, n_tokens long, ids_sha256 string, round_trip boolean", [pa.int64(), pa.int64(), pa.string(), pa.bool_()], row, check_every, batch_chars)


def read_model(path: str | None = None) -> bytes:
    with open(path or model_path(), "rb") as f:
        return f.read()


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"), read_model())


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, round_trip of the documents that are left."""
    return digest(docs, read_model())


__all__ = ["Codec", "build", "digest", "encode", "merges_of", "op6_sentencepiece", "parse_model", "read_model", "stage"]
