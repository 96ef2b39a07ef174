"""Words, fingerprints and slices of Arrow text columns, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once inside a task; only a single longer text exceeds it.
SLICE_BYTES = 4 << 20
#: Space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
#: Everything in ASCII but digits and letters.
MARKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTE_VALUES = np.random.default_rng(20240601).integers(1, 2**64, 256, dtype=np.uint64)
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 2**64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the splitmix64 finaliser)."""
    h = h.astype(np.uint64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the offset of each text; null counts as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold at most ``limit`` bytes, or one text."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1)
        yield a, b
        a = b


class Fingerprints:
    """Polynomial fingerprints of any range of a sequence, from running sums modulo 2**64."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        power = np.full(n, BASE, np.uint64)
        self.inverse = np.full(n + 1, INVERSE, np.uint64)
        if n:
            power[0] = 1
        self.inverse[0] = 1
        np.cumprod(power, out=power)
        np.cumprod(self.inverse, out=self.inverse)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * power, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))

    def grams(self, n: int) -> np.ndarray:
        """Of every range of ``n`` items."""
        m = max(0, len(self.sums) - n)
        return mix((self.sums[n:n + m] - self.sums[:m]) * self.inverse[:m] + np.uint64(n))


def word_spans(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the number of words before each text and in all."""
    solid = ~between[data]
    first, last = solid.copy(), solid.copy()
    if len(data):
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        inner = offsets[1:-1]
        heads = inner[inner < len(data)]
        first[heads] = solid[heads]
        tails = inner[inner > 0] - 1
        last[tails] = solid[tails]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_values(data: np.ndarray, offsets: np.ndarray, lower: bool = False, between: np.ndarray = WHITE):
    """Fingerprint of every word; its start and end; the number of words before each text and in all."""
    if lower:
        data = LOWER[data]
    starts, ends, begin = word_spans(data, offsets, between)
    return Fingerprints(BYTE_VALUES[data]).of(starts, ends), starts, ends, begin


def group_starts(*keys: np.ndarray) -> np.ndarray:
    """Positions where a run of equal keys begins, in sorted arrays."""
    n = len(keys[0])
    if not n:
        return np.zeros(0, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def by_bucket(buckets: np.ndarray, records: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """The records of each bucket as bytes."""
    if not len(records):
        return
    order = np.argsort(buckets, kind="stable")
    buckets, records = buckets[order], records[order]
    at = group_starts(buckets)
    for a, b in zip(at, np.append(at[1:], len(buckets)), strict=True):
        yield int(buckets[a]), records[a:b].tobytes()


def unpack(column: pa.Array, dtype: np.dtype) -> np.ndarray:
    """All records in a column of packed records."""
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x), dtype)


def pack_by(doc: np.ndarray, row: np.ndarray, values: np.ndarray):
    """One entry for each (doc, row): the two keys and its packed values."""
    order = np.lexsort((row, doc))
    doc, row, values = doc[order], row[order], values[order]
    at = group_starts(doc, row)
    ends = np.append(at[1:], len(doc))
    return doc[at], row[at], [values[a:b].tobytes() for a, b in zip(at, ends, strict=True)]
