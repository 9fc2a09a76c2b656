"""Vectorised work on the UTF-8 bytes of Arrow string columns: chunks, words and rolling hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

M1, M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes about half of the output bits."""
    h = (h ^ (h >> np.uint64(33))) * M1
    h = (h ^ (h >> np.uint64(33))) * M2
    return h ^ (h >> np.uint64(33))


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, grown as needed: hashes of any span from prefix sums."""

    BASE = 0x9E3779B97F4A7C15 | 1

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def need(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            inverse = pow(self.BASE, -1, 2**64)
            a, b = np.full(n, self.BASE, np.uint64), np.full(n, inverse, np.uint64)
            a[0] = b[0] = 1
            self.up, self.down = np.multiply.accumulate(a), np.multiply.accumulate(b)

    def spans(self, data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """A hash of data[first:last] for each pair: equal bytes give equal hashes, wherever they stand."""
        self.need(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(MIXED[data] * self.up[: len(data)], out=sums[1:])
        return (sums[last] - sums[first]) * self.down[first]


MIXED = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
powers = Powers()

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


#: Bytes that end a word of letters: all of ASCII but letters and digits.
NO_LETTER = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def words_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each word; words end at white space and at the end of their text."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    letter = ~space[data]
    edge = np.zeros(len(data), bool)  # a text begins here
    edge[starts[starts < ends]] = True
    begin = letter & (edge | ~np.concatenate([[False], letter[:-1]]))
    first = np.flatnonzero(begin)
    stop = letter & np.concatenate([~letter[1:] | edge[1:], [True]])
    last = np.flatnonzero(stop) + 1
    doc = np.searchsorted(starts, first, "right") - 1
    return first, last, doc


def batches_of(batches, most: int = 1_000_000):
    """(doc_id array, bytes, starts, ends) in chunks of about ``most`` bytes; a longer text is a chunk of its own. Null texts are empty."""
    for batch in batches:
        keys, texts = batch.column(0), batch.column(1)
        if not len(texts):
            continue
        kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
            part = offsets[i : j + 1] - offsets[i]
            # each text's bytes, then nothing between: a null text has no bytes
            yield keys.slice(i, j - i), data[offsets[i] : offsets[j]], part[:-1], part[1:]
            i = j
