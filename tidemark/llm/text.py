"""Texts of an Arrow batch as flat numpy arrays.

The operators work on whole batches of texts at once: one byte buffer, the
byte offsets of the documents in it, the byte range of every word, and 64-bit
fingerprints of any byte or word range in constant time (polynomial prefix
sums modulo 2**64, finished with a bit mixer). A fingerprint depends on
content only, so equal ranges have equal names in every task.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Text bytes worked on at once; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20

#: words [^\x20\x09-\x0D]+
WORD = np.ones(256, dtype=bool)
WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of text whose A-Z are lowered
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: A-Z to a-z
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xAF251AF3B0F025B5)
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finisher."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """First n powers of the seed's odd base, and of its inverse."""
    have = _tables.get(seed)
    if have is None or len(have[0]) < n:
        size = max(n, SLICE_BYTES + 1024)
        made = []
        for base in (_BASES[seed], pow(_BASES[seed], -1, 1 << 64)):
            step = np.full(size, base, dtype=U64)
            step[0] = 1
            made.append(np.multiply.accumulate(step))
        have = (made[0], made[1])
        if size <= 4 * SLICE_BYTES:  # a table for one very long text isn't kept
            _tables[seed] = have
    return have


class Prints:
    """Fingerprints of the ranges [start, end) of a sequence."""

    def __init__(self, values: np.ndarray, seed: int = 0) -> None:
        n = len(values)
        power, self._inverse = _powers(n + 1, seed)
        self._sums = np.zeros(n + 1, dtype=U64)
        terms = values.astype(U64)
        terms += U64(1)
        terms *= power[:n]
        np.cumsum(terms, out=self._sums[1:])
        self._salt = U64(_BASES[(seed + 1) % 3])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Content and length decide the result; empty ranges have one name."""
        raw = (self._sums[end] - self._sums[start]) * self._inverse[start]
        return mix(raw + (end - start).astype(U64) * self._salt)

    def fixed(self, length: int) -> np.ndarray:
        """Of every range of this length, by its start."""
        n = len(self._sums) - 1 - length
        if n < 0:
            return np.empty(0, dtype=U64)
        raw = (self._sums[length:] - self._sums[: n + 1]) * self._inverse[: n + 1]
        return mix(raw + U64(length * int(self._salt) & (1 << 64) - 1))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the n + 1 offsets between them (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset: column.offset + len(column) + 1]
    if data is None or off[-1] == off[0]:
        return np.empty(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[off[0]: off[-1]], off - off[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text",
           limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches' rows in pieces of at most so many text bytes, one row at least."""
    for batch in batches:
        _, off = flat(batch.column(batch.schema.get_field_index(text)))
        at, n = 0, batch.num_rows
        while at < n:
            to = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def words(buf: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the n + 1 word offsets of the documents."""
    if not len(buf):
        none = np.empty(0, dtype=np.int64)
        return none, none, np.zeros(len(off), dtype=np.int64)
    inside = table[buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = off[1:-1]
    edge = edge[(edge > 0) & (edge < len(buf))]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    start = np.flatnonzero(first)
    end = np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, off).astype(np.int64)


def word_prints(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    return Prints(buf, seed).of(start, end)


def owner(off: np.ndarray) -> np.ndarray:
    """For each element, the index of the document it belongs to."""
    return np.repeat(np.arange(len(off) - 1), np.diff(off))


def per_document(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of values over each document's range of elements."""
    sums = np.zeros(len(values) + 1, dtype=np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[off[1:]] - sums[off[:-1]]


def shingles(names: np.ndarray, off: np.ndarray, size: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of each document's runs of ``size`` words, and their offsets."""
    every = Prints(names, seed).fixed(size)
    count = np.maximum(np.diff(off) - size + 1, 0)
    out = np.zeros(len(off), dtype=np.int64)
    np.cumsum(count, out=out[1:])
    pick = np.repeat(off[:-1] - out[:-1], count) + np.arange(out[-1])
    return every[pick] if len(every) else np.empty(0, dtype=U64), out
