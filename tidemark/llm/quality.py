"""Quality rules: hashed n-gram log-likelihood ratio.

Every document is read as its UTF-8 bytes' 3-grams, hashed into ``2 ** BITS``
buckets. Two multinomials over the buckets are compared: one of the trusted
target (documents labelled good), one of the whole raw corpus. A document's
score is the mean, over its n-grams, of log p_target - log p_raw; documents
below a fixed threshold, or failing the base rules, are rejected.

Plan: one narrow pass counts n-grams (per task, a histogram of fixed width is
pre-aggregated, so the shuffle has at most ``2 ** BITS`` rows a task whatever
the text), one narrow pass scores. What reaches the driver and is sent to the
tasks is one array of ``2 ** BITS`` numbers. The trusted target is a bounded
sample of labelled rows (``MAX_TRUSTED``); the raw counts cover all rows.

Edge cases: a null text counts as empty; an empty text has score 0 and fails
the base rules; a text of fewer than three bytes has score 0; repeated rows
are judged one by one; an empty table gives an empty result, an empty label
table a score of 0 for all; columns other than the id and the text are not
read, so their names cannot clash.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx

#: n-gram buckets, as a power of two
BITS = 16
#: labelled good rows that define the trusted target, at most
MAX_TRUSTED = 50_000
#: mean log-likelihood ratio (nats per n-gram) below which a document is rejected
THRESHOLD = -0.25
#: counts added to each bucket
SMOOTHING = 1.0
#: words in a window of the repetition rule
WINDOW = 8

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_POINT = np.ones(256, dtype=bool)  # bytes that begin a code point
_POINT[0x80:0xC0] = False


def _grams(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each 3-gram, and the documents' offsets into them."""
    count = np.maximum(np.diff(off) - 2, 0)
    out = np.zeros(len(off), dtype=np.int64)
    np.cumsum(count, out=out[1:])
    if not out[-1]:
        return np.empty(0, dtype=np.int64), out
    wide = buf.astype(np.uint32)
    every = (wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]
    every = (every * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    inside = np.ones(len(every), dtype=bool)  # starts whose 3-gram stays in its document
    last = off[1:]
    for back in (1, 2):
        at = last - back
        at = at[(at >= off[:-1]) & (at < len(every))]
        inside[at] = False
    return every[inside].astype(np.int64), out


def _histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw = np.zeros(1 << BITS, dtype=np.int64)
    target = np.zeros(1 << BITS, dtype=np.int64)
    for part in tx.slices(batches):
        buf, off = tx.flat(part.column(0))
        grams, at = _grams(buf, off)
        raw += np.bincount(grams, minlength=1 << BITS)
        trusted = np.asarray(part.column(1).fill_null(False).to_numpy(zero_copy_only=False), dtype=bool)
        if trusted.any():
            target += np.bincount(grams[np.repeat(trusted, np.diff(at))], minlength=1 << BITS)
    some = np.flatnonzero(raw)
    if len(some):
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(raw[some]), pa.array(target[some])],
                                         names=["bucket", "raw", "target"])


def log_ratios(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               label_col: str = "quality") -> np.ndarray:
    """log p_target - log p_raw of each bucket; zeros if no row is trusted."""
    trusted = (labels.where((F.col(label_col) == 1) & F.col(id_col).isNotNull())
               .select(F.col(id_col).alias("tid")).distinct()
               .orderBy(F.xxhash64("tid"), "tid").limit(MAX_TRUSTED).withColumn("trusted", F.lit(True)))
    joined = (docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("tid"))
              .join(F.broadcast(trusted), "tid", "left").select("text", "trusted"))
    counted = (joined.mapInArrow(_histograms, "bucket int, raw long, target long")
               .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")))
    raw = np.full(1 << BITS, SMOOTHING)
    target = np.full(1 << BITS, SMOOTHING)
    for row in counted.collect():  # 2 ** BITS rows at most
        raw[row.bucket] += row.raw
        target[row.bucket] += row.target
    if target.sum() == SMOOTHING * len(target):
        return np.zeros(1 << BITS)
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def _distinct(names: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort order of (document, name), and where in it a new pair begins."""
    key = tx.mix(names + tx.mix(own.astype(tx.U64)))
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    new = np.ones(len(ranked), dtype=bool)
    new[1:] = ranked[1:] != ranked[:-1]
    return order, new


def measures(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The base counts of each document."""
    n = len(off) - 1
    start, end, at = tx.words(buf, off, tx.WORD)
    points = np.zeros(len(buf) + 1, dtype=np.int64)
    np.cumsum(_POINT[buf], out=points[1:])
    symbols = np.zeros(len(buf) + 1, dtype=np.int64)
    np.cumsum(_SYMBOL[buf], out=symbols[1:])

    # lines: cut at \n and at the documents' edges
    breaks = np.flatnonzero(buf == 0x0A)
    first = np.sort(np.concatenate([off[:-1], breaks + 1]), kind="stable")
    own = np.searchsorted(off, first, side="right") - 1
    # a start made by a final \n belongs to the document of that \n, and has no words
    last = np.append(first[1:], len(buf))
    has = np.searchsorted(start, first) < np.searchsorted(start, last)
    first, last, own = first[has], last[has], own[has]
    last = np.where((last > first) & (buf[last - 1] == 0x0A), last - 1, last)
    order, new = _distinct(tx.Prints(buf).of(first, last), own)
    distinct = np.bincount(own[order][new], minlength=n)
    dup = np.bincount(own, minlength=n) - distinct

    # words in windows that occur twice or more in their document
    grams, gat = tx.shingles(tx.word_prints(buf, start, end), at, WINDOW)
    order, new = _distinct(grams, tx.owner(gat))
    group = np.cumsum(new) - 1
    twice = np.zeros(len(grams), dtype=bool)
    twice[order] = (np.bincount(group) > 1)[group] if len(group) else False
    where = np.flatnonzero(twice)
    place = where + (at[:-1] - gat[:-1])[tx.owner(gat)[where]]  # window's first word
    cover = np.bincount(place, minlength=len(start) + 1) - np.bincount(place + WINDOW, minlength=len(start) + 1)
    covered = (np.cumsum(cover)[:-1] > 0).astype(np.int64)
    return {
        "n_words": np.diff(at),
        "word_chars": tx.per_document(points[end] - points[start], at),
        "n_symbols": symbols[off[1:]] - symbols[off[:-1]],
        "n_dup_lines": dup,
        "n_repeat_words": tx.per_document(covered, at),
    }


SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, score double, kept boolean")


def judge(docs: DataFrame, ratios: np.ndarray, id_col: str = "doc_id", text_col: str = "text",
          threshold: float = THRESHOLD) -> DataFrame:
    """A row for each document: base counts, score and verdict."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tx.slices(batches):
            buf, off = tx.flat(part.column(1))
            m = measures(buf, off)
            grams, at = _grams(buf, off)
            score = tx.per_document(ratios[grams], at) / np.maximum(np.diff(at), 1)
            failed = (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])
            yield pa.RecordBatch.from_arrays(
                [part.column(0).cast(pa.int64()), *(pa.array(v.astype(np.int64)) for v in m.values()), pa.array(failed),
                 pa.array(score), pa.array(~failed & (score >= threshold))],
                names=["doc_id", *m, "base_failed", "score", "kept"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def quality_rules(docs: DataFrame, labels: DataFrame, **names: str) -> DataFrame:
    return judge(docs, log_ratios(docs, labels, **names),
                 **{k: v for k, v in names.items() if k in ("id_col", "text_col")})
