"""Bucket-pointer refinement: which byte strings of one length occur more than once.

Every position of every text starts in the bucket of its ``gram`` bytes. A
bucket of one position holds no repeat, and the position drops out. A round
doubles the length: a position's new bucket is that of its own bucket and of the
bucket ``size`` bytes further on, as the round before left it; a position whose
later one has dropped out drops out with it. The last round takes an offset
shorter than the size, so that the strings have just the length asked for.

A round is two shuffles of what is left: by text, where a task walks each
text's positions in order and looks up the later buckets, and by bucket, to count
(counts are aggregated before the shuffle; a hot bucket's rows are only joined
with its count, which the planner splits). Buckets are named by 64-bit hashes of
their parts' names, the same in every task. Texts are known by a row number
written with them, so rows may share ids.

This takes a row for each byte of the corpus in the first round: see the README
for what it costs, and why ``suffix`` finds the same strings by sampled places.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .store import written

POSITIONS = "row long, at int, bucket long"


def _batch(row: np.ndarray, at: np.ndarray, bucket: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(row), pa.array(at.astype(np.int32)), pa.array(bucket.view(np.int64))], names=["row", "at", "bucket"])


def buckets(texts: DataFrame, gram: int) -> DataFrame:
    """(row, at, bucket) of every position that has ``gram`` bytes from it on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tx.slices(batches):
            buf, off = tx.flat(part.column(1))
            names, at = tx.shingles(buf, off, gram)
            own = tx.owner(at)
            yield _batch(part.column(0).to_numpy()[own], np.arange(len(names)) - at[own], names)

    return texts.select("row", "text").mapInArrow(run, POSITIONS)


def shared(positions: DataFrame, name: str) -> DataFrame:
    """The positions whose bucket holds another one."""
    twice = positions.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    return written(positions.join(twice, "bucket", "left_semi").select("row", "at", "bucket"), name)


def refined(positions: DataFrame, offset: int) -> DataFrame:
    """Each position's bucket joined with the one ``offset`` bytes further on in its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, tx.U64))  # the last text, which may go on
        for b in batches:
            new = (b.column(0).to_numpy(), b.column(1).to_numpy().astype(np.int64), b.column(2).to_numpy().view(tx.U64))
            row, at, bucket = (np.concatenate(p) for p in zip(rest, new))
            if not len(row):
                continue
            cut = int(np.searchsorted(row, row[-1]))
            # within a long text positions can go as soon as those ``offset`` further on are here
            done = cut + int(np.searchsorted(at[cut:], at[-1] - offset, side="right"))
            yield _joined(row, at, bucket, done, offset)
            rest = (row[done:], at[done:], bucket[done:])
        yield _joined(*rest, len(rest[0]), offset)

    ordered = positions.repartition("row").sortWithinPartitions("row", "at")
    return ordered.mapInArrow(run, POSITIONS)


def _joined(row: np.ndarray, at: np.ndarray, bucket: np.ndarray, done: int, offset: int) -> pa.RecordBatch:
    # texts are numbered in the batch, so that (text, place) is one sorted number
    text = np.cumsum(np.diff(row, prepend=row[:1]) != 0)
    place = (text << 40) | at
    later = np.searchsorted(place, place[:done] + offset)
    found = later < len(place)
    found[found] = place[later[found]] == place[:done][found] + offset
    mine, other = np.flatnonzero(found), later[found]
    return _batch(row[mine], at[mine], tx.mix(bucket[mine] + tx.mix(bucket[other] + tx.U64(offset))))


def repeated_starts(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """texts (row, text) -> (row, at) of the strings of ``length`` bytes that also start elsewhere."""
    size = min(gram, length)
    left = shared(buckets(texts, size), "buckets")
    while size < length:
        offset = min(size, length - size)
        left = shared(refined(left, offset), "buckets")
        size += offset
    return left.select("row", "at")
