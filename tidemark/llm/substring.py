"""Substring dedup by recompression.

Words are named by fingerprints, and rounds of recompression name runs of one
symbol and then pairs of symbols: names are computed from the parts' names, so
a round needs no dictionary and equal substrings get equal interior symbols in
every document. Each 20-word window chooses the symbol of the highest level
that lies in it with all it depends on (``anchors.WordAnchors``); windows that
share the symbol and its surroundings are candidates, and are verified whole
(``repeats``). A word is removed if a window over it, by the words of the
input, also starts earlier in the corpus.

Edge cases: null and empty texts have no words, nothing is removed from texts
of fewer than 20 words; runs of one word and overlapping repeats count; rows
that repeat an id and a text are one document (neither is earlier) and get a
row each; see ``repeats`` for null and repeated ids; an empty table gives an
empty result; long texts are read whole; other columns are not read.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import text as tx
from .anchors import WordAnchors
from .repeats import coverage, listed, repeated

WINDOW = 20
#: rounds of recompression: the highest symbols hold 4 words and more, and still fit most windows with their surroundings
ROUNDS = 2


def word_units(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    buf, off = tx.flat(column)
    start, end, at = tx.words(buf, off, tx.WORD)
    return tx.word_prints(buf, start, end), at


def remove_repeated_words(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
                          with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) and, if asked for, the kept words as ``kept``."""

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tx.slices(batches):
            texts = part.column(1).fill_null("").to_pylist()
            split = [t.encode().split() for t in texts]  # at the six ASCII spaces, as the words' pattern
            off = np.cumsum([0, *map(len, split)])
            doc, start, count = listed(part)
            gone = coverage(doc, start, count, off, window)
            removed = tx.per_document(gone.astype(np.int64), off)
            kept = [b" ".join(compress(w, ~gone[off[d]: off[d + 1]]) if removed[d] else w) for d, w in enumerate(split)]
            columns = [part.column(0), pa.array(np.diff(off)), pa.array(removed), pa.array([hashlib.sha256(k).hexdigest() for k in kept])]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array([k.decode() for k in kept])] if with_text else []), names=names)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if with_text else "")
    names = [f.split()[0] for f in schema.split(", ")]
    return repeated(docs, word_units, WordAnchors(window, ROUNDS), True, id_col, text_col).mapInArrow(finish, schema)


#: for DuckDB: windows as word lists, the first occurrence by (doc_id, place)
SQL = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
     g as (select doc_id, unnest(generate_series(1, len(w) - 19)) as i, w from w where len(w) >= 20),
     h as (select doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) as h from g),
     f as (select h, min((doc_id, i)) as f from h group by h),
     r as (select doc_id, i from h join f using (h) where (h.doc_id, h.i) > f.f),
     c as (select distinct doc_id, unnest(generate_series(i, i + 19)) as i from r),
     e as (select doc_id, unnest(generate_series(1, len(w))) as i, unnest(w) as x from w where len(w) > 0),
     k as (select e.doc_id, count(c.i) as n_removed, string_agg(case when c.i is null then e.x end, ' ' order by e.i) as kept
           from e left join c on e.doc_id = c.doc_id and e.i = c.i group by e.doc_id)
select w.doc_id, cast(len(w.w) as bigint) as n_words, coalesce(k.n_removed, 0) as n_removed, sha256(coalesce(k.kept, '')) as kept_sha256
from w left join k using (doc_id)"""
