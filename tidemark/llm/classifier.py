"""Quality classifier: histogram gradient-boosted trees over document statistics.

A text's statistics (lengths, shares of symbols, digits, capitals, repeated
lines, windows and words, entropies; see ``STATISTICS``) are put on a grid of
``GRID`` values each. Every labelled row outside the held-out part teaches, none
is sampled: bins are exact quantiles of the grid values' counts, and trees grow
level by level from histograms of gradients over (node, statistic, bin). The
trees are perfect binary trees in arrays, and a whole batch walks down all of
them at once in numpy.

Plan: texts are read once, in a narrow pass that leaves 2 bytes a statistic. The
learning rows are those bytes joined with the labels, written once. A level is
one job over them: a task adds up its histogram (of bounded size, whatever its
rows), Spark sums the cells, and at most ``2 ** (DEPTH - 1) * statistics * BINS``
sums reach the driver, which picks splits. Gradients are whole numbers (24 binary
places), so their sums, and with them the model, do not depend on how rows
are dealt out or on a task's being run again.

Labels come from rows whose crc32(doc_id) mod 3 is not 1; labels, language, source
and id are no statistics.

Edge cases: a null text counts as empty, and an empty text has statistics too;
null labels and labels of unknown documents teach nothing; a document labelled
twice counts once, by its larger label; repeated documents teach and are scored
one by one; with one class the score is that class, without labels 0; a null id
is not held out; an empty table gives an empty result; long texts are read whole;
other columns are not read.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .store import written

#: values that a statistic can take, and bins that trees split between
GRID, BINS = 4096, 64
TREES, DEPTH = 20, 3
#: share of each tree's answer that is taken, weight against large leaves, rows of a leaf at least
RATE, RIDGE, LEAST = 0.3, 1.0, 10
#: binary places of a gradient
PLACES = 24
#: words in a window of the repetition statistic
WINDOW = 8

#: name, value that fills the grid, whether small values get more of it
STATISTICS = (
    ("log_words", 12.0, False), ("word_length", 20.0, False), ("word_length_spread", 20.0, True), ("line_words", 200.0, True),
    ("symbols", 2.0, True), ("punctuation", 0.5, True), ("digits", 0.5, True), ("capitals", 1.0, True), ("shouted", 1.0, True),
    ("exclamations", 2.0, True), ("spaces", 0.5, True), ("wide_bytes", 1.0, True), ("repeated_lines", 1.0, True),
    ("repeated_windows", 1.0, True), ("distinct_words", 1.0, False), ("commonest_word", 1.0, True), ("doubled_words", 1.0, True),
    ("short_words", 1.0, False), ("words_without_letters", 1.0, True), ("sentence_ends", 1.0, False), ("byte_entropy", 6.0, False),
    ("commonest_byte", 1.0, True),
)
WIDTH = len(STATISTICS)


def _set(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    for a, b in ranges:
        out[a:b] = True
    return out


_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_PUNCTUATION, _DIGIT, _UPPER = _set((0x21, 0x30), (0x3A, 0x41), (0x5B, 0x61), (0x7B, 0x7F)), _set((0x30, 0x3A)), _set((0x41, 0x5B))
_LETTER, _SPACE, _WIDE = _set((0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)), _set((0x09, 0x0E), (0x20, 0x21)), _set((0x80, 0x100))
_POINT = ~_set((0x80, 0xC0))


def _groups(names: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Equal names of one document: sort order, each sorted element's group, the groups' sizes and documents."""
    key = tx.mix(names + tx.mix(own.astype(tx.U64)))
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    new = np.ones(len(ranked), dtype=bool)
    new[1:] = ranked[1:] != ranked[:-1]
    first = np.flatnonzero(new)
    return order, np.cumsum(new) - 1, np.diff(np.append(first, len(ranked))), own[order][first]


def statistics(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The columns of STATISTICS, a row for each document."""
    n = len(off) - 1
    start, end, at = tx.words(buf, off, tx.WORD)
    own = tx.owner(at)
    words = np.maximum(np.diff(at), 1).astype(np.float64)
    size = np.maximum(np.diff(off), 1).astype(np.float64)

    def sums(table: np.ndarray) -> np.ndarray:
        out = np.zeros(len(buf) + 1, dtype=np.int64)
        np.cumsum(table[buf], out=out[1:])
        return out

    def share(table: np.ndarray) -> np.ndarray:
        s = sums(table)
        return (s[off[1:]] - s[off[:-1]]).astype(np.float64)

    def mean(values: np.ndarray) -> np.ndarray:
        return tx.per_document(values.astype(np.float64), at) / words

    points, letters, upper = sums(_POINT), sums(_LETTER), sums(_UPPER)
    length = (points[end] - points[start]).astype(np.float64)
    average = mean(length)
    spread = np.sqrt(np.maximum(mean(length * length) - average * average, 0))
    names = tx.word_prints(buf, start, end)
    _, _, sizes, of = _groups(names, own)
    distinct = np.bincount(of, minlength=n)
    common = np.zeros(n)
    np.maximum.at(common, of, sizes)
    doubled = np.zeros(len(names), dtype=bool)
    doubled[1:] = (names[1:] == names[:-1]) & (own[1:] == own[:-1])

    # lines that hold a word
    breaks = np.flatnonzero(buf == 0x0A)
    first = np.sort(np.concatenate([off[:-1], breaks + 1]), kind="stable")
    last = np.append(first[1:], len(buf))
    filled = np.searchsorted(start, first) < np.searchsorted(start, last)
    first, last = first[filled], last[filled]
    line = np.searchsorted(off, first, side="right") - 1
    last = np.where(buf[last - 1] == 0x0A, last - 1, last) if len(last) else last
    lines = np.maximum(np.bincount(line, minlength=n), 1)
    _, _, _, line_of = _groups(tx.Prints(buf).of(first, last), line)
    repeated = (np.bincount(line, minlength=n) - np.bincount(line_of, minlength=n)) / lines
    final = end[np.maximum(np.searchsorted(start, last) - 1, 0)] - 1 if len(last) else last
    closed = np.bincount(line, weights=np.isin(buf[final], list(b".!?")).astype(np.float64), minlength=n) / lines

    # words in windows that occur twice or more in their document
    grams, gat = tx.shingles(names, at, WINDOW)
    order, group, sizes, _ = _groups(grams, tx.owner(gat))
    twice = np.zeros(len(grams), dtype=bool)
    twice[order] = sizes[group] > 1 if len(group) else False
    where = np.flatnonzero(twice)
    place = where + (at[:-1] - gat[:-1])[tx.owner(gat)[where]]
    cover = np.cumsum(np.bincount(place, minlength=len(start) + 1) - np.bincount(place + WINDOW, minlength=len(start) + 1))[:-1] > 0

    bytes_ = np.bincount(np.repeat(np.arange(n), np.diff(off)) * 256 + buf, minlength=n * 256).reshape(n, 256)
    p = bytes_ / size[:, None]
    entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(axis=1)
    letter_share = np.maximum(share(_LETTER), 1)
    return np.stack([
        np.log1p(np.diff(at)), average, spread, np.diff(at) / lines, share(_SYMBOL) / words, share(_PUNCTUATION) / size, share(_DIGIT) / size,
        share(_UPPER) / letter_share, mean((upper[end] - upper[start] >= 2) & (upper[end] - upper[start] == letters[end] - letters[start])),
        share(_set((0x21, 0x22))) / words, share(_SPACE) / size, share(_WIDE) / size, repeated, mean(cover), distinct / words, common / words,
        mean(doubled), mean(length <= 3), mean(letters[end] == letters[start]), closed, entropy, bytes_.max(axis=1, initial=0) / size], axis=1)


def gridded(values: np.ndarray) -> np.ndarray:
    """Statistics as whole numbers below GRID."""
    scale = np.array([s for _, s, _ in STATISTICS])
    root = np.array([r for _, _, r in STATISTICS])
    x = np.clip(values / scale, 0, 1)
    return np.minimum(np.where(root, np.sqrt(x), x) * GRID, GRID - 1).astype("<u2")


def unpacked(column: pa.Array) -> np.ndarray:
    """A column of packed grid values as rows."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u2").reshape(len(column), WIDTH)


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, grid): each document's statistics in 2 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tx.slices(batches):
            grid = gridded(statistics(*tx.flat(part.column(1))))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r.tobytes() for r in grid], pa.binary())], names=["doc_id", "grid"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "doc_id long, grid binary")


@dataclass
class Trees:
    """Perfect binary trees in arrays: node i of a level has the children 2i + 1 and 2i + 2."""

    lut: np.ndarray  #: (WIDTH, GRID) bin of each grid value
    base: float  #: log odds of all rows
    feature: np.ndarray  #: (trees, 2 ** DEPTH - 1) statistic of a split
    threshold: np.ndarray  #: its last bin that goes left; BINS: all do
    leaf: np.ndarray  #: (trees, 2 ** DEPTH)

    def bins(self, grid: np.ndarray) -> np.ndarray:
        return self.lut[np.arange(WIDTH), grid]

    def nodes(self, bins: np.ndarray, trees: slice, levels: int) -> np.ndarray:
        """Where each row stands in each of the trees after so many levels."""
        feature, threshold = self.feature[trees], self.threshold[trees]
        node = np.zeros((len(bins), len(feature)), dtype=np.int64)
        tree, row = np.arange(len(feature)), np.arange(len(bins))[:, None]
        for _ in range(levels):
            node = 2 * node + 1 + (bins[row, feature[tree, node]] > threshold[tree, node])
        return node

    def raw(self, bins: np.ndarray, trees: int | None = None) -> np.ndarray:
        """Log odds by the first so many trees."""
        node = self.nodes(bins, slice(0, trees), DEPTH) - (2 ** DEPTH - 1)
        return self.base + self.leaf[np.arange(node.shape[1]), node].sum(axis=1)

    def score(self, grid: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(self.bins(grid))))


def quantile_bins(counts: np.ndarray) -> np.ndarray:
    """(WIDTH, GRID) counts of the values -> bin of each value: at most BINS bins of about equal numbers of rows."""
    before = np.cumsum(counts, axis=1) - counts
    rows = np.maximum(counts.sum(axis=1, keepdims=True), 1)
    bin_ = np.minimum(before * BINS // rows, BINS - 1)
    return np.maximum.accumulate(np.where(counts > 0, bin_, 0), axis=1).astype(np.uint8)


def _summed(rows: DataFrame, cells: int, per_task, names: tuple[str, ...]) -> np.ndarray:
    """Sums of the tasks' tables (names x cells), of which only cells that hold something are sent."""
    schema = ", ".join(["cell int", *(f"{n} long" for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names), cells), dtype=np.int64)
        for batch in batches:
            total += per_task(batch)
        some = np.flatnonzero(total.any(axis=0))
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array(t[some]) for t in total)], names=["cell", *names])

    got = rows.mapInArrow(run, schema).groupBy("cell").agg(*(F.sum(n).alias(n) for n in names)).toArrow()
    out = np.zeros((len(names), cells), dtype=np.int64)
    at = got.column("cell").to_numpy()
    for i, n in enumerate(names):
        out[i, at] = got.column(n).to_numpy()
    return out


def _histograms(rows: DataFrame, model: Trees, tree: int, level: int) -> np.ndarray:
    """(3, nodes, WIDTH, BINS) of gradients, curvatures and rows at the current level of the tree."""
    nodes = 2 ** level
    cells = nodes * WIDTH * BINS

    def per_task(batch: pa.RecordBatch) -> np.ndarray:
        bins = model.bins(unpacked(batch.column(1)))
        label = batch.column(0).to_numpy()
        p = 1 / (1 + np.exp(-model.raw(bins, tree)))
        whole = [np.rint(v * (1 << PLACES)) for v in (p - label, p * (1 - p))]
        node = model.nodes(bins, slice(tree, tree + 1), level)[:, 0] - (nodes - 1)
        cell = ((node[:, None] * WIDTH + np.arange(WIDTH)) * BINS + bins).ravel()
        out = [np.bincount(cell, weights=np.repeat(v, WIDTH), minlength=cells).astype(np.int64) for v in whole]
        return np.stack([*out, np.bincount(cell, minlength=cells)])

    return _summed(rows, cells, per_task, ("g", "h", "n")).reshape(3, nodes, WIDTH, BINS)


def _split(hist: np.ndarray) -> tuple[int, int, tuple[float, float]]:
    """Best (statistic, threshold) of a node's (3, WIDTH, BINS) histogram, and the answers left and right of it."""
    one = float(1 << PLACES)
    left = np.cumsum(hist, axis=2)
    total = left[:, :1, -1:]
    right = total - left
    answer = lambda s: -(s[0] / one) / (s[1] / one + RIDGE)
    worth = lambda s: (s[0] / one) ** 2 / (s[1] / one + RIDGE)
    gain = np.where((left[2] >= LEAST) & (right[2] >= LEAST), worth(left) + worth(right) - worth(total), 0.0)
    at = int(gain.argmax())
    f, t = divmod(at, BINS)
    if gain[f, t] <= 1e-9:
        whole = float(answer(total[:, 0, 0]))
        return 0, BINS, (whole, whole)
    return f, t, (float(answer(left[:, f, t])), float(answer(right[:, f, t])))


def labelled(grids: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """(label, grid) of all rows that teach."""
    given = (labels.where(F.col(f"`{id_col}`").isNotNull() & F.col(f"`{label_col}`").isin(0, 1))
             .select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label"))
             .groupBy("doc_id").agg(F.max("label").alias("label")).where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1))
    return grids.join(given, "doc_id").select("label", "grid")


def fit(rows: DataFrame) -> Trees | float:
    """Trees from rows (label, grid); the mean label where there are not two classes."""
    by_class = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    bad, good = by_class.get(0, 0), by_class.get(1, 0)
    if not (bad and good):
        return float(good > 0)

    def values(batch: pa.RecordBatch) -> np.ndarray:
        grid = unpacked(batch.column(1)).astype(np.int64) + np.arange(WIDTH) * GRID
        return np.bincount(grid.ravel(), minlength=WIDTH * GRID)[None, :]

    lut = quantile_bins(_summed(rows, WIDTH * GRID, values, ("n",)).reshape(WIDTH, GRID))
    model = Trees(lut, float(np.log(good / bad)), np.zeros((TREES, 2 ** DEPTH - 1), dtype=np.int64),
                  np.full((TREES, 2 ** DEPTH - 1), BINS, dtype=np.int64), np.zeros((TREES, 2 ** DEPTH)))
    for tree in range(TREES):
        for level in range(DEPTH):
            hist = _histograms(rows, model, tree, level)
            for node in range(2 ** level):
                at = 2 ** level - 1 + node
                model.feature[tree, at], model.threshold[tree, at], answers = _split(hist[:, node])
                if level == DEPTH - 1:
                    model.leaf[tree, 2 * node: 2 * node + 2] = np.multiply(answers, RATE)
    return model


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document."""
    grids = written(measured(docs, id_col, text_col), "statistics")
    model = fit(written(labelled(grids, labels, id_col, label_col), "learning"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grid = unpacked(batch.column(1))
            score = model.score(grid) if isinstance(model, Trees) else np.full(len(grid), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["doc_id", "score"])

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return grids.mapInArrow(run, "doc_id long, score double").select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
