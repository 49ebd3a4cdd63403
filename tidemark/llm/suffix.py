"""Removal of repeated bytes.

Every text is its UTF-8 bytes. A byte is removed if a 400-byte string over it,
judged on the input, starts anywhere else too; matches stay inside documents,
overlaps count. Two ways find the strings, with the same result:

* ``refinement`` (``refine``): bucket-pointer refinement over all positions.
* ``anchors``, the query's: places are sampled by content (of the first
  ``SPREAD`` places of a window, the one whose q-gram hashes least) and grouped by
  the fingerprint of the bytes that every window of the anchor holds, then by that
  of all the bytes its windows reach. Places that stay together have all their
  windows in common; groups that part are compared once more, window by window
  (``repeats``). It is no bucket-pointer refinement, and stands in for it because
  a row for each byte is beyond the disk that the query may take; the README has
  the figures of both.

Edge cases: null and empty texts have no bytes; texts shorter than the window
keep all; runs of one byte repeat themselves at every place; rows that repeat
are copies of each other, whatever their ids; see ``repeats`` for null ids; an
empty table gives an empty result; long texts are read whole; other columns are
not read. What is kept may end inside a character, so it is bytes.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .anchors import ByteAnchors
from .refine import repeated_starts
from .repeats import coverage, listed, repeated
from .store import written

WINDOW = 400
#: places of a window among which its anchor is chosen
SPREAD = 96
#: bytes of the initial buckets
GRAM = 32


def remove_repeated_bytes(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
                          with_text: bool = False, method: str = "anchors") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) and, if asked for, the kept bytes as ``kept``."""

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tx.slices(batches):
            buf, off = tx.flat(part.column(1))
            doc, start, count = listed(part)
            gone = coverage(doc, start, count, off, window)
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            edge = off[:-1][off[:-1] < len(gone)]
            begins[edge] = gone[edge]
            kept = [buf[i:j][~gone[i:j]].tobytes() for i, j in zip(off[:-1], off[1:])]
            columns = [part.column(0), pa.array(np.diff(off)), pa.array(tx.per_document(gone.astype(np.int64), off)),
                       pa.array(tx.per_document(begins.astype(np.int64), off)), pa.array([hashlib.sha256(k).hexdigest() for k in kept])]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(kept, type=pa.binary())] if with_text else []), names=names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    names = [f.split()[0] for f in schema.split(", ")]
    if method == "refinement":
        texts = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
                        .withColumn("row", F.monotonically_increasing_id()), "texts")
        starts = (repeated_starts(texts, window, min(GRAM, window)).groupBy("row").agg(F.collect_list(F.col("at").cast("long")).alias("starts"))
                  .withColumn("counts", F.transform("starts", lambda _: F.lit(1))))
        return texts.join(starts, "row", "left").select("doc_id", "text", "starts", "counts").mapInArrow(finish, schema)
    chooser = ByteAnchors(window, min(SPREAD, max(1, window // 4)), min(GRAM, max(1, window // 4)))
    return repeated(docs, tx.flat, chooser, False, id_col, text_col).mapInArrow(finish, schema)
