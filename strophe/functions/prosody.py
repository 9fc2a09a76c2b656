"""Metrical patterns, meters, rhyme schemes and alliteration as column expressions."""

from __future__ import annotations

from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import let
from .enums import ALL_METERS, HIGH, MEDIUM, METER_SYNONYMS, METERS, RARE_METERS, SCHEME_BY_MASK

#: Verse forms and the stress patterns (I stressed, o unstressed) that they match from the start, the first match wins.
VERSE_FORMS = """
iambic.septa.plus ^oIoIoIoIoIoIoIo?
hexameter ^Ioo?Ioo?Ioo?Ioo?IooIo$
alexandrine.iambic.hexa ^oIoIoIoIoIoIo?$
iambic.penta ^oIoIoIoIoIo?$
iambic.penta.spondeus ^IIoIoIoIoIo?$
iambic.tetra ^.IoIoIoIo?$
iambic.tri ^.IoIoIo?$
iambic.di ^.IoIo?$
trochaic.septa.plus ^IoIoIoIoIoIoIo?
trochaic.hexa ^IoIoIoIoIoIo?$
trochaic.penta ^IoIoIoIoIo?$
trochaic.tetra ^IoIoIoIo?$
trochaic.tri ^IoIoIo?$
trochaic.di ^IoIo?$
asklepiade ^IoIooIIooIoI$
glykoneus ^IoIooIoI$
pherekrateus ^IoIooIo$
iambelegus ^oIoIoIoIIooIooI$
elegiambus ^IooIooIo?oIoIoIoo?$
diphilius ^IooIooI..IooI..$
prosodiakos ^.IooIooII?$
sapphicusmaior ^IoIIIooIIooIoI.$
sapphicusminor ^IoI.IooIoI.$
dactylic.penta ^IooIooIooIooIo?o?$
dactylic.tetra ^IooIooIooIo?o?$
dactylic.tri ^IooIooIo?o?$
amphibrach.penta.plus ^oIooIooIooIooIo?
amphibrach.tetra ^oIooIooIooIo?$
amphibrach.tetra.plus ^oIooIooIooIo
amphibrach.tri ^oIooIooIo?$
amphibrach.tri.plus ^oIooIooIo
amphibrach.relaxed ^o?IooIo$
dactylic.penta.plus ^IooIooIooIooIooIoo
dactylic.tetra.plus ^IooIooIooIoo
dactylic.tri.plus ^IooIooIoo
dactylic.di.plus ^IooIoo
dactylic.di ^IooIoo$
anapaest.tetra.plus ^ooIooIooIooI
anapaest.tri.plus ^ooIooIooI
anapaest.di.plus ^ooIooI
arte_major ^oIooIooIooIo$
arte_major.half ^oIooIo$
adoneus ^IooI.$
adoneus.spond ^IooII$
iambic.septa.invert ^IooIoIoIoIoIoIo?$
iambic.hexa.invert ^IooIoIoIoIoIo?$
iambic.penta.invert ^IooIoIoIoIo?$
iambic.tetra.invert ^IooIoIoIo?$
iambic.tri.invert ^IooIoIo?$
iambic.invert ^IooIoI
trochaic.relaxed ^I.*IooI.+
iambic.relaxed ^o.*IooI.+
iambic.chol.strict ^oIoIoIoIoIooI$
iambic.relaxed.chol ^o?.*IooI$
amphibrach.single ^oIo$
amphibrach.iambic.mix ^oI.*oIooIoo?I
amphibrach.trochaic.mix ^Io.*oIooIoo?I
anapaest.init ^ooI
dactylic.init ^o?Ioo
amphibrach.di.mix ^oIooIo
zehnsilber ^...I.....I$
spondeus ^II$
iambic.single ^oI$
trochaic.single ^Io$
single.down ^o$
single.up ^I$
"""
FORMS = [tuple(x.split()) for x in VERSE_FORMS.split("\n") if x]
GREEK = frozenset("asklepiade glykoneus pherekrateus iambelegus elegiambus diphilius prosodiakos sapphicusmaior sapphicusminor adoneus adoneus.spond".split())
#: Names of stress counts in relaxed and inverted forms.
COUNTS = ["zero", "single", "di", "tri", "tetra", "penta", "hexa", "septa.plus"]


def count_inserted(form: str) -> tuple[str, str] | None:
    """Where the name of the stress count goes: before relaxed, and before invert of the plain inverted iamb."""
    for word in ("relaxed", "invert"):
        if f".{word}" in form and (word == "relaxed" or form == "iambic.invert"):
            return tuple(form.split(f".{word}", 1)[:1]) + (f".{word}" + form.split(f".{word}", 1)[1],)
    return None


def stresses(pattern: Column) -> Column:
    """A pattern of + - s w ^ and | as I and o."""
    return F.translate(F.replace(pattern, F.lit("|"), F.lit("")), "s+w^-", "IIooo")


def versification(pattern: Column, greek: bool = True, parts: int | None = None) -> Column:
    """The form of a pattern of stresses: one CASE in order, no UDF; null stays null. parts: only so many of its dotted parts (1: the foot, 2: with its length)."""
    if parts:
        return F.substring_index(versification(pattern, greek), ".", parts)
    n = F.length(pattern) - F.length(F.replace(pattern, F.lit("I"), F.lit("")))
    name = F.element_at(F.array(*map(F.lit, COUNTS)), F.least(n, F.lit(len(COUNTS) - 1)) + 1)
    out = F
    for form, rule in FORMS:
        if form in GREEK and not greek:
            continue
        split = count_inserted(form)
        label = F.concat(F.lit(split[0] + "."), name, F.lit(split[1])) if split else F.lit(form)
        out = out.when(pattern.rlike(rule), label)
    return F.when(pattern.isNotNull(), out.otherwise("other"))


def versification_sql(p: str) -> str:
    """The same for DuckDB."""
    n = f"least(length({p}) - length(replace({p}, 'I', '')), {len(COUNTS) - 1})"
    name = f"([{', '.join(repr(c) for c in COUNTS)}])[CAST({n} AS INT) + 1]"
    rows = []
    for form, rule in FORMS:
        parts = count_inserted(form)
        rows.append(f"WHEN regexp_matches({p}, '{rule}') THEN " + (f"'{parts[0]}.' || {name} || '{parts[1]}'" if parts else f"'{form}'"))
    return "CASE WHEN " + p + " IS NULL THEN NULL " + " ".join(rows) + " ELSE 'other' END"


def foot_and_metre(form: Column) -> tuple[Column, Column]:
    """Before and after the first dot; a form without one is both."""
    foot = F.substring_index(form, ".", 1)
    return foot, F.when(F.contains(form, F.lit(".")), F.substring(form, F.length(foot) + 2, F.length(form))).otherwise(form)


def meter_label(name: Column, group_rare: bool = True) -> Column:
    """The meter of a foot or synonym; rare ones are other. Unknown names raise, unless rare ones are kept (then nothing is checked)."""
    synonyms = F.create_map(*[F.lit(v) for kv in METER_SYNONYMS.items() for v in kv])
    meter = F.coalesce(F.try_element_at(synonyms, name), name)
    if not group_rare:
        return meter
    return F.when(meter.isin(RARE_METERS), "other").when(meter.isin(METERS), meter).otherwise(F.raise_error(F.concat(F.lit("unknown meter: "), F.coalesce(name, F.lit("null")))).cast("string"))


def known_meter(name: Column) -> Column:
    return name.isin([*ALL_METERS, *METER_SYNONYMS])


def canonical_scheme(letters: Column) -> Column:
    """Letters renamed A, B, … by first appearance (an array or a string)."""
    return F.array_join(F.transform(letters, lambda x: F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.array_position(F.array_distinct(letters), x).cast("int"), F.lit(1))), "")


def scheme_of_mask(mask: Column) -> Column:
    """The rhyme scheme of six pair bits; null where the quatrain is dropped."""
    table = F.array(*[F.lit(None if s == "--" else s).cast("string") for s in SCHEME_BY_MASK])
    return F.element_at(table, mask.cast("int") + 1)


def repeated_scheme(base: Column, n: Column) -> Column:
    """A starred scheme (array of letters) repeated over n verses; each repetition uses the next letters."""
    kinds = F.size(F.array_distinct(base))
    at = lambda i: F.chr(F.ascii(F.element_at(base, (i % F.size(base) + 1).cast("int"))) + F.floor(i / F.size(base)) * kinds)
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), at), "")).otherwise("")


def alliteration(phones: Column) -> Column:
    """Equal pairs weighted by nearness, over all pairs; 0 for fewer than two phones."""
    return let(phones, _alliteration)


def _alliteration(phones: Column) -> Column:
    n = F.size(phones)
    # pairs of lag d: each weighs 1/d, and there are n - d of them
    lags = F.sequence(F.lit(1), n - 1)
    equal = lambda d: F.aggregate(F.zip_with(F.slice(phones, F.lit(1), n - d), F.slice(phones, d + 1, n - d), lambda a, b: (a == b).cast("int")), F.lit(0), lambda s, x: s + x)
    top = F.aggregate(lags, F.lit(0.0), lambda s, d: s + equal(d) / d.cast("double"))
    bottom = F.aggregate(lags, F.lit(0.0), lambda s, d: s + (n - d) / d.cast("double"))
    return F.when(n >= 2, top / bottom).otherwise(0.0)


@lru_cache(256)
def _lags(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    i, j = np.triu_indices(n, 1)
    return i, j, j - i


def equal_by_lag(codes: np.ndarray) -> np.ndarray:
    """How many places hold the same as the place that stands a lag of 1, 2, ... n - 1 behind them."""
    n = len(codes)
    if n <= 128:
        i, j, lag = _lags(n)
        return np.bincount(lag[codes[i] == codes[j]], minlength=n)[1:]
    out = np.zeros(n, np.int64)
    order = np.argsort(codes, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(codes[order])) + 1):
        if len(at) <= 512:
            i, j = np.triu_indices(len(at), 1)
            out += np.bincount(at[j] - at[i], minlength=n)
        else:  # counts from a Fourier transform are whole numbers, far from a half
            mark = np.zeros(2 * n)
            mark[at] = 1
            out += np.rint(np.fft.irfft(np.abs(np.fft.rfft(mark)) ** 2, 2 * n)[:n]).astype(np.int64)
    return out[1:]


def _alliterating(phones: str) -> float:
    one = phones.split("\0")
    n = len(one)
    if n < 2:
        return 0.0
    codes = np.frombuffer(phones.encode("utf-32-le"), "<u4")[::2] if len(phones) == 2 * n - 1 and all(one) else np.unique(one, return_inverse=True)[1]
    lags = np.arange(1.0, n)
    return float(np.cumsum(equal_by_lag(codes) / lags)[-1] / np.cumsum((n - lags) / lags)[-1])


@lru_cache(1024)
def _all_by_lag(n: int) -> float:
    lags = np.arange(1.0, n)
    return float(np.cumsum((n - lags) / lags)[-1])


def _alliterating_alike(lines: list[str], n: int) -> np.ndarray:
    """The same of lines of n phones of one letter each, lag by lag for all of them."""
    codes = np.ascontiguousarray(np.frombuffer("\0".join([*lines, ""]).encode("utf-32-le"), "<u4").reshape(len(lines), 2 * n)[:, ::2].T)
    top = np.zeros(len(lines))
    for d in range(1, n):
        top += np.count_nonzero(codes[d:] == codes[:-d], axis=0) / float(d)
    return top / _all_by_lag(n)


def _alliterating_all(lines: list[str], most: int = 1_000_000) -> list[float]:
    """Of many lines; those of as many phones, of one letter each, together (up to ``most`` phones at a time)."""
    out, alike = [0.0] * len(lines), {}
    for i, x in enumerate(lines):
        n = x.count("\0") + 1
        if 2 <= n <= 256 and len(x) == 2 * n - 1 and "\0\0" not in x and x[0] != "\0" != x[-1]:
            alike.setdefault(n, []).append(i)
        else:
            out[i] = _alliterating(x)
    for n, at in alike.items():
        for k in range(0, len(at), step := max(1, most // n)):
            for i, s in zip(at[k : k + step], _alliterating_alike([lines[i] for i in at[k : k + step]], n).tolist(), strict=True):
                out[i] = s
    return out


def alliterations(phones: Column) -> Column:
    """``alliteration`` of each array of phones in an array: the same sums in the same order, by numpy, in a time that grows little faster than the phones."""

    @F.pandas_udf("array<double>")
    def scored(rows: pd.Series) -> pd.Series:
        found = iter(_alliterating_all([x for r in rows if r is not None for x in r if x is not None]))
        return pd.Series([None if r is None else [None if x is None else next(found) for x in r] for r in rows], dtype=object)

    return scored(F.transform(phones, lambda p: F.array_join(p, "\0")))


def alliteration_level(score: Column, medium: float = MEDIUM, high: float = HIGH) -> Column:
    return F.when(score < medium, "low").when(score < high, "medium").otherwise("high")


def harmonic_mean(values: Column) -> Column:
    """Of an array; 0 if any value is 0."""
    inverse = F.aggregate(values, F.lit(0.0), lambda s, x: s + F.when(x == 0, 0.0).otherwise(1.0 / F.when(x == 0, 1.0).otherwise(x)))
    return F.when(F.array_min(values) == 0, 0.0).otherwise(F.size(values) / inverse)


def mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)


def stressed_phones(ipa: Column) -> Column:
    """Of each pronounced word its first letter and the letters after stress marks; a mark at the start counts once."""
    one = lambda w: F.regexp_extract_all(F.regexp_replace(w, r"[/ ]", ""), F.lit(r"(?:^[ˈˌ]?|[ˈˌ])(\p{L})"), F.lit(1))
    return F.flatten(F.transform(ipa, one))


__all__ = ["FORMS", "reduce", "versification", "versification_sql"]
