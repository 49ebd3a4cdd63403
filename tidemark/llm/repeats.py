"""Windows of one length that occur more than once in a corpus, exactly.

Used by the substring operators; a chooser from ``anchors`` cuts every document
into runs of windows. Three jobs, each ending in a table in the shared folder:

1. Runs are shuffled by their anchor's key. Runs with equal ``whole`` cover the
   same units: all their windows are repeats at once. Runs that share only the
   key differ somewhere, at the edges of repeats: a representative of each
   ``whole`` is marked for a look at its single windows.
2. The marked runs' windows (a few per cent of all) are read from the texts
   again, named by two independent 64-bit fingerprints, and shuffled by them.
3. The covered windows are joined with the texts, and the operator's ``finish``
   makes its result.

Skew: each task folds equal runs before the shuffle and tells the repeats among
its own rows apart at once, so a run that a third of all documents share sends
one row a task. A key with many different wholes in one task is spread by them;
its rows are then looked at window by window, and one marker row tells the rest
of the key's rows that there are more. No group is gathered by a task beyond
Spark's own spilling windows, and nothing reaches the driver.

Identity: a null id counts as the least one. Rows that repeat an id and its text
are one document at one place; rows with one id and different texts are
different documents, ordered by a hash of the text. A document is known by its
id and 87 bits of two hashes of its text (``print``, and the upper bits of
``place``), so any number of rows may share an id.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import text as tx
from .anchors import Runs
from .store import written

#: rows that a task folds together before it sends them
FOLD = 500_000
#: different wholes of one key among them from which the key is spread
SPREAD = 64
#: bits of a place that hold a window's start; the rest holds a second hash of the text
START_BITS = 40
_LOW = (1 << START_BITS) - 1
TOLD, MARKER, SPREAD_FLAG = 1, 2, 4

ROWS = "key long, whole long, id long, print long, place long, count int, n long, flags int"


class Folder:
    """Collects rows (key, whole, id, print, place, count) and folds equal (key, whole)."""

    def __init__(self) -> None:
        self.held: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append(columns)
        self.size += len(columns[0])
        if self.size >= FOLD:
            yield self.flush()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            yield self.flush()

    def flush(self) -> pa.RecordBatch:
        key, whole, ids, prints, place, count = (np.concatenate(c) for c in zip(*self.held))
        self.held, self.size = [], 0
        order = np.lexsort((place, prints, ids, whole, key))
        key, whole, ids, prints, place, count = (c[order] for c in (key, whole, ids, prints, place, count))
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (whole[1:] != whole[:-1])
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(key)))
        own = np.repeat(first, n)  # the first of each row's group
        # others at another place than the first are repeats of it; the same place again is the same window
        told = (~new) & ((ids != ids[own]) | (prints != prints[own]) | (place != place[own]))
        flags = np.where(told, TOLD, 0)
        sent = new | told
        many = np.zeros(len(key), dtype=np.int64)
        many[first] = n
        # keys with many different wholes
        kinds, at, wholes = np.unique(key[first], return_index=True, return_counts=True)
        hot = kinds[wholes >= SPREAD]
        spread = new & np.isin(key, hot)
        flags[spread] = SPREAD_FLAG
        key = np.where(spread, tx.mix(key ^ tx.mix(whole)), key)
        key = np.where(told, tx.mix(ids.astype(tx.U64) ^ tx.mix(prints.astype(tx.U64) + tx.mix(place.astype(tx.U64) + tx.U64(1)))), key)  # goes anywhere
        zeros = np.zeros(len(hot), dtype=np.int64)
        columns = [np.append(key[sent], hot).view(np.int64), np.append(whole[sent], hot).view(np.int64), np.append(ids[sent], zeros),
                   np.append(prints[sent], zeros), np.append(place[sent], zeros), np.append(count[sent], zeros).astype(np.int32), np.append(many[sent], zeros),
                   np.append(flags[sent], zeros + MARKER).astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[f.split()[0] for f in ROWS.split(", ")])


def resolved(rows: DataFrame, first_stays: bool) -> DataFrame:
    """Folded rows -> (id, print, place, count, covered, mixed): rows whose windows are repeats, and rows to look into."""
    real = F.col("flags") != MARKER
    inside = W.partitionBy("key", "whole").orderBy("flags", "id", "print", "place")
    every = W.partitionBy("key")
    here = F.struct("id", "print", "place")
    # the window by key alone comes first: its shuffle serves the finer ones too
    judged = (rows.withColumn("marked", F.max((F.col("flags") >= MARKER).cast("int")).over(every))
              .withColumn("rank", F.row_number().over(inside)).withColumn("first", F.first(here).over(inside))
              .withColumn("n", F.sum("n").over(W.partitionBy("key", "whole")))
              .withColumn("wholes", F.sum(((F.col("rank") == 1) & real).cast("int")).over(every)))
    told = F.col("flags") == TOLD
    later = here != F.col("first")
    covered = told | (later if first_stays else F.col("n") > 1)
    mixed = ~told & ~later & ((F.col("wholes") > 1) | (F.col("marked") == 1))
    return (judged.where(real).select("id", "print", "place", "count", covered.alias("covered"), mixed.alias("mixed"))
            .where("covered or mixed"))


def identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, id, print, tag, text): id without nulls, print and tag two hashes of the text, tag a place's part."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"),
                       F.xxhash64(text_col).alias("print"), F.hash(text_col).bitwiseAND(F.lit((1 << 63 - START_BITS) - 1)).cast("long").alias("tag"),
                       F.col(text_col).alias("text"))


def with_rows(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """Each text's row with the starts and counts of its rows (null: none)."""
    lists = (rows.select("id", "print", F.shiftright("place", START_BITS).alias("tag"), F.col("place").bitwiseAND(F.lit(_LOW)).alias("start"), "count")
             .groupBy("id", "print", "tag").agg(F.collect_list("start").alias("starts"), F.collect_list("count").alias("counts")))
    return texts.join(lists, ["id", "print", "tag"], "left")


def listed(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start in it, count) of all entries of the batch's lists."""
    starts, counts = (part.column(part.schema.get_field_index(c)) for c in ("starts", "counts"))
    n = pc.fill_null(pc.list_value_length(starts), 0).to_numpy().astype(np.int64)
    return (np.repeat(np.arange(part.num_rows), n), starts.flatten().to_numpy().astype(np.int64), counts.flatten().to_numpy().astype(np.int64))


def repeated(docs: DataFrame, units: Callable, chooser: object, first_stays: bool, id_col: str, text_col: str) -> DataFrame:
    """Each document (doc_id, text) with ``starts`` and ``counts`` of its covered windows.

    units: Arrow texts -> (flat unit values, offsets). first_stays: the first occurrence, by id and place, is no repeat.
    """
    texts = identified(docs, id_col, text_col)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = Folder()
        for part in tx.slices(batches):
            values, off = units(part.column(3))
            ids, prints, tags = (part.column(i).to_numpy() for i in range(3))
            r: Runs = chooser.runs(values, off)[0]
            place = (tags[r.doc] << START_BITS) | (r.start - off[r.doc])
            yield from folder.add(r.key, r.whole, ids[r.doc], prints[r.doc], place, r.count)
        yield from folder.rest()

    runs = written(resolved(texts.select("id", "print", "tag", "text").mapInArrow(ask, ROWS), first_stays), "runs")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = Folder()
        for part in tx.slices(batches):
            values, off = units(part.column(3))
            ids, prints, tags = (part.column(i).to_numpy() for i in range(3))
            doc, start, count = listed(part)
            first = np.cumsum(count) - count
            doc = np.repeat(doc, count)
            start = np.repeat(start - first, count) + np.arange(int(count.sum()))
            flat = start + off[doc]
            names, others = (tx.Prints(values, seed).of(flat, flat + chooser.length) for seed in (0, 1))
            yield from folder.add(names, others, ids[doc], prints[doc], (tags[doc] << START_BITS) | start, np.ones(len(doc), dtype=np.int64))
        yield from folder.rest()

    marked = with_rows(texts.select("id", "print", "tag", "text"), runs.where("mixed")).where("starts is not null")
    windows = written(resolved(marked.select("id", "print", "tag", "text", "starts", "counts").mapInArrow(look, ROWS), first_stays).where("covered"), "windows")
    covered = runs.where("covered").select("id", "print", "place", "count").unionByName(windows.select("id", "print", "place", "count"))
    return with_rows(texts, covered).select("doc_id", "text", "starts", "counts")


def coverage(doc: np.ndarray, start: np.ndarray, count: np.ndarray, off: np.ndarray, length: int) -> np.ndarray:
    """Which units of the flat sequence lie in a covered window."""
    first = start + off[doc]
    n = int(off[-1]) + 1
    steps = np.bincount(first, minlength=n) - np.bincount(first + count - 1 + length, minlength=n)
    return np.cumsum(steps)[:-1] > 0
