"""Benchmark decontamination: size-partitioned MinHash containment search.

Finds test items (short) inside documents (long): pairs whose document holds at
least ``threshold`` of the item's distinct word 5-shingles. Words are runs of
letters and digits, A-Z lowered, so punctuation and case do not hide a copy.

The items are partitioned by size into classes (u/2, u] with u a power of two.
For a class, a document's shingles are read in windows of 2u, u apart, so any
stretch of up to u shingles lies in one window whole and the window is at most
about four times the item: containment then implies a Jaccard similarity of
about 0.19 or more, which ``HASHES`` one-value MinHash bands find with
probability over 0.9999 whatever the document's length. A band's value names a
shingle, so candidates share one at least; each is verified by the exact
containment of its shingles in the whole document. Items that must be there
whole at the threshold (up to four shingles at 0.8) need no chance: one of their
shingles is looked up among all of a document's. An item of one to four words
is one shingle of that many words.

Plan: no shuffle of documents at all. The items are read in blocks of about
``BLOCK_SHINGLES`` shingles (one, for ordinary benchmarks), each block's index
is sent to the tasks, and one narrow pass over all documents looks up the
window minima and verifies. More items mean more blocks, not a larger index: a
block's result is written and its index dropped before the next one is built.

Edge cases: null and empty texts have no words and match nothing; documents of
fewer than five words can hold items of as few; rows repeated in the documents give a pair each,
an item repeated with the same id and text counts once; null ids are kept;
long texts are read whole; an empty table on either side gives no pairs;
other columns are not read.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .store import written

SHINGLE = 5
THRESHOLD = 0.8
#: MinHash functions; one makes a band
HASHES = 48
#: the least size class
LEAST = 8
#: item shingles in a block, about
BLOCK_SHINGLES = 1_000_000

_FACTORS = tx.mix(np.arange(1, HASHES + 1, dtype=tx.U64) * tx.U64(0x9E3779B97F4A7C15)) | tx.U64(1)


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    buf, off = tx.flat(column)
    buf = tx.LOWER[buf]
    start, end, at = tx.words(buf, off, tx.ALNUM)
    return tx.word_prints(buf, start, end), at


def size_class(n: int) -> int:
    return max(LEAST, 1 << (n - 1).bit_length())


def listed(values: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values, and for each where its items begin and end."""
    distinct, group = np.unique(values, return_inverse=True)
    order = np.argsort(group, kind="stable")
    return distinct, np.searchsorted(group[order], np.arange(len(distinct) + 1)), items[order]


def looked_up(names: np.ndarray, own: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(document, item) pairs of the names found in the table."""
    values, begin, members = table
    place = np.minimum(np.searchsorted(values, names), len(values) - 1)
    hit = np.flatnonzero(values[place] == names)
    lo, hi = begin[place[hit]], begin[place[hit] + 1]
    n = hi - lo
    return np.repeat(own[hit], n), members[np.repeat(hi - np.cumsum(n), n) + np.arange(n.sum())]


class Index:
    """A block of items: their shingles (of ``sizes`` words), and by class and hash the sorted minima with their
    items; items that must be found whole by one shingle, by their shingles' size."""

    def __init__(self, ids: list[int | None], sizes: list[int], sets: list[np.ndarray], threshold: float) -> None:
        self.ids, self.sizes, self.sets = ids, np.array(sizes), sets
        whole = np.array([len(s) <= LEAST and threshold * len(s) > len(s) - 1 for s in sets], dtype=bool)
        self.whole = {int(k): listed(np.array([sets[i][0] for i in own], dtype=tx.U64), own)
                      for k in sorted(set(self.sizes[whole])) for own in [np.flatnonzero(whole & (self.sizes == k))]}
        self.classes: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        sizes = [0 if w else size_class(len(s)) for s, w in zip(sets, whole)]
        for u in sorted(set(sizes) - {0}):
            own = np.array([i for i, c in enumerate(sizes) if c == u])
            bands = []
            for a in _FACTORS:
                bands.append(listed(np.array([(sets[i] * a).min() for i in own], dtype=tx.U64), own))
            self.classes[u] = bands

    def candidates(self, read: dict[int, tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """(document, item) pairs that share a band in some window, or the shingle that an item is looked up by."""
        docs, items = [], []
        for k, table in self.whole.items():
            names, off = read[k]
            for found, to in zip(looked_up(names, tx.owner(off), table), (docs, items)):
                to.append(found)
        names, off = read[SHINGLE]
        for k, factor in enumerate(_FACTORS if self.classes else ()):
            level, at = names * factor, off
            size = 1
            for u, bands in self.classes.items():
                level, at = blocks(level, at, u // size)
                size = u
                own = tx.owner(at)
                window = level.copy()
                if len(level) > 1:  # with the next block of the same document
                    pair = np.minimum(level[:-1], level[1:])
                    window[:-1] = np.where(own[:-1] == own[1:], pair, level[:-1])
                for found, to in zip(looked_up(window, own, bands[k]), (docs, items)):
                    to.append(found)
        if not docs:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        both = np.unique((np.concatenate(docs).astype(np.int64) << 32) | np.concatenate(items).astype(np.int64))
        return both >> 32, both & 0xFFFFFFFF


def blocks(level: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Minima of each document's consecutive groups of ``size`` values, and their offsets."""
    count = -(-np.diff(off) // size)
    at = np.zeros(len(off), dtype=np.int64)
    np.cumsum(count, out=at[1:])
    if not at[-1]:
        return np.empty(0, dtype=tx.U64), at
    first = np.repeat(off[:-1] - at[:-1] * size, count) + np.arange(at[-1]) * size
    return np.minimum.reduceat(level, first), at


SCHEMA = "doc_id long, item_id long, n_shingles long, n_shared long, containment double"


def verified(column: pa.Array, index: Index, threshold: float) -> Iterator[tuple[int, int, int]]:
    """(row, item, shared shingles) of the texts that contain an item of the block."""
    words, at = words_of(column)
    read = {k: tx.shingles(words, at, k) for k in {SHINGLE, *index.whole}}
    doc, item = index.candidates(read)
    bounds = np.flatnonzero(np.diff(doc, prepend=-1))
    for lo, hi in zip(bounds, [*bounds[1:], len(doc)]):
        d = int(doc[lo])
        sets = {}
        for i in item[lo:hi]:
            own, k = index.sets[i], int(index.sizes[i])
            if k not in sets:
                names, off = read[k]
                sets[k] = np.unique(names[off[d]: off[d + 1]])
            whole = sets[k]
            place = np.minimum(np.searchsorted(whole, own), len(whole) - 1)
            n = int((whole[place] == own).sum())
            if n >= threshold * len(own):
                yield d, int(i), n


def search(docs: DataFrame, index: Index, threshold: float) -> DataFrame:
    """docs (doc_id, text): verified pairs with the items of one block."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for part in tx.slices(batches):
            ids = part.column(0)
            rows = [(ids[d].as_py(), index.ids[i], len(index.sets[i]), n, n / len(index.sets[i]))
                    for d, i, n in verified(part.column(1), index, threshold)]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), type=t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()))],
                    names=["doc_id", "item_id", "n_shingles", "n_shared", "containment"])

    return docs.mapInArrow(run, SCHEMA)


def reject(docs: DataFrame, index: Index, threshold: float, text_col: str) -> DataFrame:
    """The rows of docs, all columns, that contain no item of the block."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for part in tx.slices(batches, text_col):
            keep = np.ones(part.num_rows, dtype=bool)
            text = part.column(part.schema.get_field_index(text_col))
            keep[[d for d, _, _ in verified(text, index, threshold)]] = False
            yield part.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def _item_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each item's distinct shingles and the number of words in one: all its words if it has fewer than five."""
    for part in tx.slices(batches):
        words, at = words_of(part.column(1))
        count = np.diff(at)
        read = {k: tx.shingles(words, at, k) for k in range(1, SHINGLE + 1)}
        sizes = np.minimum(count, SHINGLE)
        sets = [np.unique(names[off[d]: off[d + 1]]).view(np.int64).tolist() if k else []
                for d, k in enumerate(sizes) for names, off in [read[max(int(k), 1)]]]
        yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(sizes, type=pa.int32()), pa.array(sets, type=pa.list_(pa.int64()))],
                                         names=["item_id", "words", "names"])


def indexes(items: DataFrame, threshold: float, item_col: str = "item_id", text_col: str = "text") -> Iterator[tuple[Index, bool]]:
    """The items' index, block by block, and whether it is the only one."""
    sets = (items.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("text")).dropDuplicates()
            .mapInArrow(_item_sets, "item_id long, words int, names array<long>").where(F.size("names") > 0))
    total = sets.agg(F.sum(F.size("names"))).first()[0] or 0
    n = max(1, -(-total // BLOCK_SHINGLES))
    for block in range(n):
        rows = sets.where(F.pmod(F.xxhash64("item_id", "names"), F.lit(n)) == block).collect()  # one block of items
        yield Index([r.item_id for r in rows], [r.words for r in rows], [np.array(r.names, dtype=np.int64).view(tx.U64) for r in rows], threshold), n == 1


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id",
                 text_col: str = "text", **names: str) -> DataFrame:
    """Pairs (doc_id, item_id) whose document contains the item."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    parts = []
    for index, only in indexes(items, threshold, **names):
        found = search(texts, index, threshold)
        parts.append(found if only else written(found, "pairs"))
    return reduce(DataFrame.unionByName, parts)


def decontaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, text_col: str = "text", **names: str) -> DataFrame:
    """The rows of docs, all columns, that contain no item."""
    for index, only in indexes(items, threshold, **names):
        kept = reject(docs, index, threshold, text_col)
        docs = kept if only else written(kept, "kept")
    return docs


#: words as in words_of, and the distinct shingles of one row, for DuckDB; k: words of a shingle
_SQL_WORDS = r"""select {id}, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from {table}"""
_SQL_SHINGLES = """select {id}, k, unnest(list_distinct(list_transform(generate_series(1, len(w) - k + 1), lambda i: array_to_string(w[i:i + k - 1], ' ')))) as s
    from {rows} where len(w) >= k"""
SQL = f"""
with i as (select *, least(len(w), 5) as k from ({_SQL_WORDS.format(id="item_id", table="benchmark")}) where len(w) > 0),
     t as (select * from ({_SQL_WORDS.format(id="doc_id", table="documents")}), (select distinct k from i)),
     d as ({_SQL_SHINGLES.format(id="doc_id", rows="t")}),
     b as ({_SQL_SHINGLES.format(id="item_id", rows="i")}),
     n as (select item_id, count(*) as n_shingles from b group by item_id),
     m as (select doc_id, item_id, count(*) as n_shared from d join b using (k, s) group by doc_id, item_id)
select doc_id, item_id, n_shingles, n_shared, n_shared::double / n_shingles as containment
from m join n using (item_id) where n_shared >= 0.8 * n_shingles"""
