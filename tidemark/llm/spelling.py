"""Spelling variants by pivotal grams.

Words that differ by one inserted, deleted or replaced code point are near. One
edit touches at most two of a word's bigrams, so of any three bigrams one
survives, and of two that do not overlap one survives. Bigrams are ordered by
rarity in the vocabulary. A word's prefix is its three rarest bigrams (and any
equal to the third); its pivots are the two prefix bigrams without overlap whose
lists are shortest together, chosen by dynamic programming. Of two near words,
the one whose prefix ends earlier in the order has a pivot in the other's
prefix, untouched. The edit is then on one side of it: up to the pivot's end, or
from its beginning on, the words agree, which also fixes the place at which it
is met for each length that the other word may have. (Where few letters agree so,
one half of the rest is asked to agree too: the edit is in the other.) So
pivots, written once for each side and length, are joined with the prefix grams
by equality of what agrees, place and length, in both directions at once.
Candidates whose letters
differ in more than two (as 64-bit sets) are passed over, the others verified by
their edit distance.

Plan: one narrow pass counts words (folded in each task, then by Spark's partial
aggregation, so a word in a third of all rows sends one row a fold). The
vocabulary, which all that follows works on, is written once. Bigram counts
are a table of at most ``len(alphabet) ** 2`` rows, about 8,100: its size is
bounded by the alphabet, and it is the only thing sent to the tasks. Forms are
followed by pointer doubling; a form has at least twice its word's count, so
a chain of n words needs a corpus of 2 ** n and a few rounds end it.

Edge cases: a null text has no words; a null id reads as an empty one in the
hash; a run whose hash takes a code point counts under what is left; ties of
counts go to the smaller word in code-point order; repeated rows count each; a
run of any length is a word; an empty table gives an empty result; long texts
are read whole; other columns are not read.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .store import written

#: code points of a word, and its occurrences, at least
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: a form occurs at least so many times as often as the word
RATIO = 2
#: one run in so many, by its hash, loses a code point
DAMAGE = 97
#: edits that one link allows, code points of a gram
EDITS, GRAM = 1, 2
PREFIX, PIVOTS = GRAM * EDITS + 1, EDITS + 1
#: letters that agree up to which half of the rest is asked to
FEW = 4
#: distinct words that a task folds before it sends them
FOLD = 200_000
#: bytes of a run that is hashed along with the others, and letters of a word whose parts are
SHORT = 64

_ASCII = np.zeros(256, dtype=bool)
_ASCII[0x41:0x5B] = _ASCII[0x61:0x7B] = True
_CRC = np.zeros(256, dtype=np.uint32)
for _i in range(256):
    _c = _i
    for _ in range(8):
        _c = (_c >> 1) ^ (0xEDB88320 if _c & 1 else 0)
    _CRC[_i] = _c


def letters(buf: np.ndarray) -> np.ndarray:
    """Which bytes belong to A-Z, a-z and U+00C0 to U+00FF (bytes C3 80 to C3 BF)."""
    inside = _ASCII[buf]
    if len(buf) > 1:
        latin = np.flatnonzero((buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] < 0xC0))
        inside[latin] = inside[latin + 1] = True
    return inside


def crcs(buf: np.ndarray, start: np.ndarray, end: np.ndarray, state: np.ndarray) -> np.ndarray:
    """crc32 of each range, going on from the crc32 in ``state``: all ranges byte by byte at once."""
    crc = state.astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    at, active = start.copy(), np.arange(len(start))
    long = end - start > SHORT
    active = active[~long]
    while len(active):
        crc[active] = _CRC[(crc[active] ^ buf[at[active]]) & np.uint32(0xFF)] ^ (crc[active] >> np.uint32(8))
        at[active] += 1
        active = active[at[active] < end[active]]
    crc ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(long):
        crc[i] = zlib.crc32(buf[start[i]:end[i]].tobytes(), int(state[i]))
    return crc


def found(ids: pa.Array, texts: pa.Array) -> pa.StructArray:
    """Counts of the batch's words (values, counts)."""
    buf, off = tx.flat(texts)
    inside = letters(buf)
    low = tx.LOWER[buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = off[:-1]
    edge = edge[edge < len(buf)]
    first[edge] = inside[edge]
    start = np.flatnonzero(first)
    # the runs' bytes side by side: a run ends where the next begins
    place = np.flatnonzero(inside)
    packed = low[place]
    begin = np.searchsorted(place, start)
    bounds = np.append(begin, len(place))
    heads = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids.to_pylist()], dtype=np.uint32)
    own = np.searchsorted(off, start, side="right") - 1
    crc = crcs(packed, bounds[:-1], bounds[1:], heads[own]) if len(start) else np.empty(0, dtype=np.uint32)
    runs = pa.StringArray.from_buffers(len(start), pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(packed.tobytes()))
    hit = crc % np.uint32(DAMAGE) == 0
    hurt = [w[:h % len(w)] + w[h % len(w) + 1:] for w, h in zip(runs.filter(pa.array(hit)).to_pylist(), crc[hit].tolist())]
    runs = pa.concat_arrays([runs.filter(pa.array(~hit)), pa.array(hurt, pa.string())])
    return pc.value_counts(runs.filter(pc.greater_equal(pc.utf8_length(runs), LEAST_LENGTH)))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, int] = {}

    def packed() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
        held.clear()
        return batch

    for part in tx.slices(batches):
        counts = found(part.column(0), part.column(1))
        for word, n in zip(counts.field("values").to_pylist(), counts.field("counts").to_pylist()):
            held[word] = held.get(word, 0) + n
        if len(held) >= FOLD:
            yield packed()
    if held:
        yield packed()


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the words that occur often enough."""
    rows = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").alias("text"))
    counted = rows.mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= LEAST_COUNT)


def pivots(grams: list[tuple[int, int]]) -> list[int]:
    """Of prefix grams (place, weight) in order of place, the indexes of the ``PIVOTS`` that do not overlap and weigh least."""
    best: list[list[tuple[int, tuple[int, ...]] | None]] = [[(0, ())] + [None] * PIVOTS]
    before = 0  # grams that end before the current one begins
    for i, (place, weight) in enumerate(grams):
        while grams[before][0] + GRAM <= place:
            before += 1
        row = list(best[i])
        for k in range(1, PIVOTS + 1):
            have = best[before][k - 1]
            if have is not None and (row[k] is None or have[0] + weight < row[k][0]):
                row[k] = (have[0] + weight, (*have[1], i))
        best.append(row)
    return list(best[-1][PIVOTS][1])


def _letter_set(word: str) -> int:
    """64 bits, one for each letter (some share one): an edit changes two at most."""
    bits = 0
    for c in set(word):
        bits |= 1 << (ord(c) & 63)
    return bits - (1 << 64) if bits >> 63 else bits


class _Sides:
    """Keys by which the word ``a`` that a pivot is taken from meets ``b``. The edit is after the pivot, and all up to
    the pivot's end agrees, or before it, and all from its beginning on does. What agrees is the key; where it has
    few letters, half of the rest agrees besides, the half that the edit isn't in. Keys only propose: what meets is
    verified."""

    def __init__(self, word: str) -> None:
        self.word = word
        self.prints: tx.Prints | None = None

    def _part(self, start: int, end: int, size: int) -> str:
        if size <= SHORT:
            return self.word[start:end]
        if self.prints is None:  # a long word's parts are named in constant time
            self.prints = tx.Prints(np.frombuffer(self.word.encode("utf-32-le"), dtype=np.uint32))
        return str(self.prints.of(np.array([start]), np.array([end]))[0])

    def keys(self, place: int, b: int, lengths: tuple[int, ...]) -> Iterator[int]:
        """For a gram of this word: b is the length of the word to be met, lengths are those that a may have."""
        word, size = self.word, len(self.word)
        n, k = place + GRAM, size - place  # letters up to the gram's end, and from its beginning on
        if n > FEW:
            yield _key(f"{b}<{self._part(0, n, b)}")
        if k > FEW:
            yield _key(f"{b}>{self._part(place, size, b)}")
        for a in lengths:
            if n <= FEW:
                half = (a - n) // 2
                yield _key(f"{b},{a}<1{word[:n + half]}")
                yield _key(f"{b},{a}<2{word[:n]}<{word[size - (a - n - half):]}")
            if k <= FEW:
                half = (a - k) // 2
                yield _key(f"{b},{a}>1{word[:half]}>{word[place:]}")
                yield _key(f"{b},{a}>2{word[size - (a - half):]}")


def _key(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def _indexed(weights: dict[str, int]):
    """Rows of the gram index: ``pivot`` rows for each side and length at which a near word may hold the gram, and prefix rows."""
    schema = "key long, pivot boolean, word string, n long, letters long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                size = len(word)
                grams = [word[i:i + GRAM] for i in range(size - GRAM + 1)]
                ranked = sorted((weights[g], g) for g in grams)
                last = ranked[min(PREFIX, len(ranked)) - 1]
                prefix = [(i, weights[g]) for i, g in enumerate(grams) if (weights[g], g) <= last]
                chosen = [prefix[k][0] for k in pivots(prefix)]
                sides, held = _Sides(word), _letter_set(word)
                lengths = tuple(a for a in (size - 1, size, size + 1) if a >= LEAST_LENGTH)
                out += [(key, False, word, n, held) for key in {k for i, _ in prefix for k in sides.keys(i, size, lengths)}]
                out += [(key, True, word, n, held) for key in {k for i in chosen for b in lengths for k in sides.keys(i, b, (size,))}]
                if len(out) > 100_000:
                    yield packed(out)
                    out = []
            if out:
                yield packed(out)

    def packed(out: list) -> pa.RecordBatch:
        types = (pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["key", "pivot", "word", "n", "letters"])

    return run, schema


def near_words(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b), once for each unordered pair of near words of (word, n)."""
    grams = words.select(F.explode(F.expr(f"transform(sequence(1, length(word) - {GRAM - 1}), i -> substring(word, i, {GRAM}))")).alias("gram"))
    # bounded by the alphabet of 90 letters
    weights = {r.gram: r.n for r in grams.groupBy("gram").agg(F.count("*").alias("n")).collect()}
    run, schema = _indexed(weights)
    index = written(words.select("word", "n").mapInArrow(run, schema), "grams")
    left = index.where("pivot").select("key", F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("letters").alias("l_a"))
    right = index.where("not pivot").select("key", F.col("word").alias("b"), F.col("n").alias("n_b"), F.col("letters").alias("l_b"))
    alike = F.bit_count(F.col("l_a").bitwiseXOR(F.col("l_b"))) <= 2 * EDITS
    close = left.join(right, "key").where(alike).where("a != b").where(F.levenshtein("a", "b", EDITS) == EDITS)
    swap = F.col("a") > F.col("b")
    ordered = close.select(*(F.when(swap, F.col(x)).otherwise(F.col(y)).alias(z)
                             for x, y, z in (("b", "a", "a"), ("n_b", "n_a", "n_a"), ("a", "b", "b"), ("n_a", "n_b", "n_b"))))
    return ordered.distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words of (word, form) with a form, by pointer doubling."""
    now = written(forms.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = written(now.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = jumped.select("word", "root")
        if jumped.where("moved").isEmpty():
            return now


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the corpus."""
    words = written(vocabulary(docs, id_col, text_col), "words")
    links = written(near_words(words), "links")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("n_b").alias("n_a"), F.col("a").alias("b"), F.col("n_a").alias("n_b")))
    best = both.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("less"), F.col("b").alias("w"))).alias("m"))
    is_form = -F.col("m.less") >= RATIO * F.col("n")
    formed = written(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("m.w")).alias("form"),
        F.when(is_form, -F.col("m.less")).alias("form_n")), "forms")
    return (formed.join(roots(formed), "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
