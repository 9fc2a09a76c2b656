"""Byte-level ids, style tokens and training sequences as column expressions."""

from __future__ import annotations

from itertools import chain

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import let
from .enums import EMOTIONS, LEVELS, METERS, RHYME_SCHEMES
from .text import clean_sentence

#: Fixed values of the two byte vocabularies: special ids, first byte id, first extra id and number of extra ids.
BYTE4 = {"bos": 0, "eos": 1, "unk": 2, "pad": 3, "offset": 4, "extra": 260, "extras": 125}
BYTE3 = {"pad": 0, "eos": 1, "unk": 2, "offset": 3, "extra": 259, "extras": 125}


def byte_ids(x: Column, offset: int = 4, prefix_space: bool = False) -> Column:
    """Each UTF-8 byte as an id; empty text, no ids. With prefix_space, a text that doesn't begin with white space gets a space before it."""
    if prefix_space:
        x = F.when((x == "") | x.rlike(r"(?U)^\s"), x).otherwise(F.concat(F.lit(" "), x))
    pairs = F.regexp_extract_all(F.hex(F.encode(x, "UTF-8")), F.lit(".."), F.lit(0))
    return F.transform(pairs, lambda b: F.conv(b, 16, 10).cast("int") + offset)


def other_offset(ids: Column, was: int, offset: int) -> Column:
    """Byte ids of one vocabulary as those of another."""
    return F.transform(ids, lambda i: i - was + offset)


def with_specials(a: Column, b: Column | None = None, bos: int | None = 0, eos: int | None = 1) -> Column:
    """bos + a [+ bos + b] + eos."""
    one = lambda v: [] if v is None else [F.array(F.lit(v))]
    return F.concat(*one(bos), a, *([] if b is None else [*one(bos), b]), *one(eos))


#: The special tokens of the first vocabulary.
SPECIALS4 = {0: "<s>", 1: "</s>", 2: "<unk>", 3: "<pad>"}


def decode_ids(offset: int = 4, extra: int = 260, shown: dict[int, str] | None = None):
    """A pandas UDF: ids back to text; bytes that make no character are dropped. Special and extra ids are skipped, but those to be shown give their text."""
    shown = shown or {}

    @F.pandas_udf("string")
    def decode(ids: pd.Series) -> pd.Series:
        one = lambda i: shown[i].encode() if i in shown else bytes([i - offset]) if offset <= i < min(offset + 256, extra) else b""
        return ids.map(lambda v: None if v is None else b"".join(one(int(i)) for i in v).decode("utf-8", "ignore"))

    return decode


#: Style tokens: levels, then meters, then schemes.
STYLE = {name: i for i, name in enumerate(chain(LEVELS, METERS, RHYME_SCHEMES))}
EMOTION = {name: i for i, name in enumerate(EMOTIONS)}


def style_id(name: Column, table: dict[str, int] = STYLE, extras: int = 125) -> Column:
    if len(table) > extras:
        raise ValueError("not enough extra tokens for the styles")
    return F.try_element_at(F.create_map(*[F.lit(v) for kv in table.items() for v in kv]), name)


def style_token(name: Column, table: dict[str, int] = STYLE) -> Column:
    return F.concat(F.lit("<extra_id_"), style_id(name, table).cast("string"), F.lit(">"))


def style_name(token: Column, table: dict[str, int] = STYLE) -> Column:
    back = F.create_map(*[F.lit(v) for k, i in table.items() for v in (f"<extra_id_{i}>", k)])
    return F.try_element_at(back, token)


def clean_verses(verses: Column) -> Column:
    """Verses as they are trained on: cleaned, without lone equals signs, by line."""
    return F.array_join(F.transform(verses, lambda v: clean_sentence(v, "=")), "\n")


def style_prompt(rhyme: Column, meter: Column, level: Column) -> Column:
    return F.concat(style_token(rhyme), style_token(meter), style_token(level))


def emotion_prompt(emotions: Column) -> Column:
    """Tokens of a verse's emotions, in alphabetical order."""
    return F.array_join(F.transform(F.sort_array(emotions), lambda e: style_token(e, EMOTION)), "")


def training_text(prompt: Column, verses: Column, bos: str = "<s>", eos: str = "</s>", clean: bool = False) -> Column:
    """bos, the tokens of a prompt, then the clean verses, eos: for a decoder alone. clean: the verses are clean already."""
    return F.concat(F.lit(bos), prompt, F.array_join(verses, "\n") if clean else clean_verses(verses), F.lit(eos))


def training_pair(prompt: Column, verses: Column, eos: str = "</s>") -> Column:
    """The same for an encoder and a decoder: inputs and labels."""
    return F.struct(prompt.alias("inputs"), F.concat(clean_verses(verses), F.lit(eos)).alias("labels"))


def parsed_text(x: Column, bos: str = "<s>", eos: str = "</s>") -> Column:
    """rhyme, meter, level and quatrain of a training text."""
    token = r"(<extra_id_\d+>)"
    head = f"^{bos}{token}{token}{token}"
    # What follows the tokens always fits, so they are found without a look at it.
    part = lambda i: F.regexp_extract(x, head, i) if i < 4 else F.regexp_extract(x, f"(?s){head}(.*?)(?:{eos}.*)?$", i)
    return F.struct(style_name(part(1)).alias("rhyme"), style_name(part(2)).alias("meter"), style_name(part(3)).alias("level"), part(4).alias("quatrain"))


def leading_emotions(x: Column, bos: str = "<s>") -> Column:
    """Emotions at the start of a text, up to its first other token."""
    head = F.regexp_extract(x, rf"^{bos}((?:<extra_id_[0-{len(EMOTIONS) - 1}]>)+)", 1)
    return F.transform(F.regexp_extract_all(head, F.lit(r"<extra_id_\d+>"), F.lit(0)), lambda t: style_name(t, EMOTION))


def blocks(ids: Column, n: int) -> Column:
    """Stretches of n ids; a shorter rest is dropped. The ids are made once, however many stretches there are."""

    def cut(v):
        count = F.floor(F.size(v) / n).cast("int")
        return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(v, i * n + 1, n))).otherwise(F.array().cast("array<array<int>>"))

    return let(ids, cut)


def classifier_input(x: Column, labels: Column, names: list[str] = EMOTIONS, most: int = 512, offset: int = 4, specials=(0, 1)) -> Column:
    """What a sequence classifier trains on: cleaned text as bos, at most ``most`` - 2 byte ids and eos; and the labels as one vector of 0 and 1."""
    ids = with_specials(F.slice(byte_ids(clean_sentence(x), offset), 1, most - len(specials)), bos=specials[0], eos=specials[1])
    return F.struct(ids.alias("input_ids"), one_hot(labels, names).alias("labels"))


def one_hot(labels: Column, names: list[str] = EMOTIONS) -> Column:
    return F.array(*[F.array_contains(labels, n).cast("double") for n in names])
