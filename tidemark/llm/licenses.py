"""License scans: positional rare-token index over licence templates.

Words are runs of letters and digits (A-Z lowered). Base labels come from four
phrases, wherever their words stand consecutively. The method adds labels of
its own: every template is indexed by the positions of its ``RARE`` words of
the highest IDF, the IDF being counted over all documents. A document's
occurrences of indexed words vote for (template, start) by relative position;
a start with ``AGREE`` votes (or all of a shorter index) is a candidate, and is
verified by the template's mandatory key phrases inside the aligned stretch.
The score is the largest IDF-weighted share of a verified template's words
that the stretch has in place, 0 without any.

Plan: one narrow pass counts document frequencies of the templates' few
hundred words (pre-aggregated per task), one narrow pass scans. Nothing else is
shuffled; what the driver sees is the frequency table of the template words.

Edge cases: null and empty texts have no words, no labels and score 0; ids may
be null or repeat, each row is judged alone; long texts are scanned whole; an
empty table gives an empty result; other columns are not read.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx

#: indexed words of a template
RARE = 4
#: indexed words that must agree on a start
AGREE = 2
#: words around the aligned stretch in which key phrases may stand
MARGIN = 3

# Base phrases and their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

# Label, mandatory key phrases, template.
TEMPLATES = (
    ("apache-2.0", ("apache license", "2 0"), "licensed under the apache license version 2 0"),
    ("apache-2.0", ("apache license", "version 2 0"),
     "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license "
     "you may obtain a copy of the license at"),
    ("gpl-3.0", ("gnu general public license", "version 3"), "licensed under the gnu general public license version 3"),
    ("gpl-2.0", ("gnu general public license", "version 2"), "licensed under the gnu general public license version 2"),
    ("gpl-3.0", ("gnu general public license", "version 3"),
     "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license "
     "as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-2.0", ("gnu general public license", "version 2"),
     "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license "
     "as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("lgpl", ("gnu lesser general public license",), "licensed under the gnu lesser general public license"),
    ("agpl-3.0", ("gnu affero general public license",), "licensed under the gnu affero general public license version 3"),
    ("mit", ("mit license",), "released under the mit license"),
    ("mit", ("permission is hereby granted free of charge",),
     "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation "
     "files to deal in the software without restriction"),
    ("bsd", ("redistribution and use in source and binary forms",),
     "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
     "conditions are met"),
    ("isc", ("is hereby granted",), "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2.0", ("mozilla public license",), "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-4.0", ("cc by 4 0",), "licensed under cc by 4 0"),
    ("cc-by-nc-4.0", ("cc by nc 4 0",), "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0", ("cc by sa 4 0",), "licensed under cc by sa 4 0"),
    ("cc-by-4.0", ("creative commons attribution 4 0",), "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc0-1.0", ("cc0 1 0",), "released under cc0 1 0 universal"),
    ("unlicense", ("released into the public domain",), "this is free and unencumbered software released into the public domain"),
)


def names_of(words: str) -> np.ndarray:
    buf = np.frombuffer(words.encode(), dtype=np.uint8)
    start, end, _ = tx.words(buf, np.array([0, len(buf)]), tx.ALNUM)
    return tx.word_prints(buf, start, end)


def vocabulary() -> list[str]:
    return sorted({w for *_, t in TEMPLATES for w in t.split()})


def idf(docs: DataFrame, text_col: str = "text") -> dict[str, float]:
    """log((1 + documents) / (1 + documents with the word)) of each template word, over all documents."""
    words = vocabulary()
    known = names_of(" ".join(words))
    order = np.argsort(known)
    known = known[order]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, found = 0, np.zeros(len(known), dtype=np.int64)
        for part in tx.slices(batches):
            names, _, at = scan_words(part.column(0))
            place = np.minimum(np.searchsorted(known, names), len(known) - 1)
            hit = np.flatnonzero(known[place] == names)
            pairs = np.unique(tx.owner(at)[hit] * len(known) + place[hit])
            found += np.bincount(pairs % len(known), minlength=len(known))
            total += part.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([-1, *order.tolist()], type=pa.int32()), pa.array([total, *found.tolist()], type=pa.int64())],
                                         names=["word", "n"])

    got = {r.word: r.n for r in docs.select(F.col(text_col).alias("text")).mapInArrow(count, "word int, n long")
           .groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return {w: math.log((1 + got.get(-1, 0)) / (1 + got.get(i, 0))) for i, w in enumerate(words)}


def scan_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    buf, off = tx.flat(column)
    buf = tx.LOWER[buf]
    start, end, at = tx.words(buf, off, tx.ALNUM)
    return tx.word_prints(buf, start, end), start, at


def rare_positions(template: str, weights: dict[str, float]) -> list[int]:
    """Where the template's words of the highest IDF stand first."""
    words = template.split()
    best = sorted(set(words), key=lambda w: (-weights[w], words.index(w)))[:RARE]
    return sorted(words.index(w) for w in best)


class Index:
    """Postings (template, position) of the indexed words, by word."""

    def __init__(self, weights: dict[str, float]) -> None:
        self.words = [names_of(t) for *_, t in TEMPLATES]
        self.weights = [np.array([weights[w] for w in t.split()]) for *_, t in TEMPLATES]
        self.phrases = [[names_of(p) for p in must] for _, must, _ in TEMPLATES]
        places = [rare_positions(t, weights) for *_, t in TEMPLATES]
        self.need = np.array([min(AGREE, len(p)) for p in places])
        posts = sorted((int(self.words[t][q]), t, q) for t, own in enumerate(places) for q in own)
        self.known, begin = np.unique(np.array([p[0] for p in posts], dtype=tx.U64), return_index=True)
        self.begin = np.append(begin, len(posts))
        self.template = np.array([p[1] for p in posts])
        self.position = np.array([p[2] for p in posts])

    def verified(self, names: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """(document, template, score) of each verified start."""
        place = np.minimum(np.searchsorted(self.known, names), len(self.known) - 1)
        hit = np.flatnonzero(self.known[place] == names)
        lo, hi = self.begin[place[hit]], self.begin[place[hit] + 1]
        n = hi - lo
        post = np.repeat(hi - np.cumsum(n), n) + np.arange(n.sum())
        where = np.repeat(hit, n)
        start = where - self.position[post]
        doc = np.searchsorted(at, where, side="right") - 1
        kinds = len(TEMPLATES)
        # a start may lie before the document: shift, so that keys stay positive; the document is part of the key
        key = ((start + 10_000) * kinds + self.template[post]) * (len(at)) + doc
        keys, votes = np.unique(key, return_counts=True)
        for k, v in zip(keys.tolist(), votes.tolist()):
            d, k = k % len(at), k // len(at)
            t, s = k % kinds, k // kinds - 10_000
            if v >= self.need[t] and (score := self.score(names, int(at[d]), int(at[d + 1]), t, s)) is not None:
                yield d, t, score

    def score(self, names: np.ndarray, begin: int, end: int, t: int, start: int) -> float | None:
        size = len(self.words[t])
        near = names[max(begin, start - MARGIN): min(end, start + size + MARGIN)]
        for phrase in self.phrases[t]:
            ok = np.ones(max(0, len(near) - len(phrase) + 1), dtype=bool)
            for j, w in enumerate(phrase):
                ok &= near[j: j + len(ok)] == w
            if not ok.any():
                return None
        lo, hi = max(begin, start), min(end, start + size)
        same = names[lo:hi] == self.words[t][lo - start: hi - start]
        weights = self.weights[t]
        return float(weights[lo - start: hi - start][same].sum() / weights.sum()) if weights.sum() > 0 else float(same.sum() / size)


SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def scan(docs: DataFrame, weights: dict[str, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: base places and labels, the method's labels and score."""
    index = Index(weights)
    phrases = [(names_of(p), label) for p, label in BASE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tx.slices(batches):
            names, _, at = scan_words(part.column(1))
            n = part.num_rows
            count = np.zeros(n, dtype=np.int64)
            first = np.full(n, np.iinfo(np.int64).max)
            last = np.full(n, -1)
            labels: list[set[str]] = [set() for _ in range(n)]
            for phrase, label in phrases:
                hit = np.flatnonzero(names == phrase[0])
                doc = np.searchsorted(at, hit, side="right") - 1
                ok = hit + len(phrase) <= at[doc + 1]
                hit, doc = hit[ok], doc[ok]
                for j, w in enumerate(phrase[1:], 1):
                    ok = names[hit + j] == w
                    hit, doc = hit[ok], doc[ok]
                count += np.bincount(doc, minlength=n)
                np.minimum.at(first, doc, hit - at[doc])
                np.maximum.at(last, doc, hit - at[doc])
                for d in np.unique(doc):
                    labels[d].add(label)
            base = [",".join(sorted(x)) for x in labels]
            score = [0.0] * n
            for d, t, s in index.verified(names, at):
                labels[d].add(TEMPLATES[t][0])
                score[d] = max(score[d], s)
            none = count == 0
            yield pa.RecordBatch.from_arrays(
                [part.column(0).cast(pa.int64()), pa.array(np.diff(at)), pa.array(count), pa.array(first, mask=none), pa.array(last, mask=none),
                 pa.array(base), pa.array([",".join(sorted(x)) for x in labels]), pa.array(score)],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return scan(docs, idf(docs, text_col), id_col, text_col)


