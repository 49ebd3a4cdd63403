import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import licenses as L

from .samples import awkward, frame

LINES = ["Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0.",
         "This work is licensed under the GNU General Public License, version 3.", "Released under the MIT License.",
         "gnu general public", "apache LICENSE apache license", "cc by, cc by cc by-sa 4.0", "Licensed under the Apache Software, Version 2.0",
         "the GNU Lesser General Public License", "version 2 0 licensed under the apache", "released under the mit licence"]


def words_of(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def places(words, phrase):
    p = phrase.split()
    return [i for i in range(len(words) - len(p) + 1) if words[i:i + len(p)] == p]


def brute(rows):
    docs = [words_of(t) for _, t in rows]
    idf = {w: math.log((1 + len(docs)) / (1 + sum(w in d for d in docs))) for w in L.vocabulary()}
    out = Counter()
    for (i, _), w in zip(rows, docs):
        at = {label: places(w, p) for p, label in L.BASE}
        every = sorted(x for v in at.values() for x in v)
        base = {k for k, v in at.items() if v}
        labels, score = set(base), 0.0
        for label, must, t in L.TEMPLATES:
            tw = t.split()
            rare = L.rare_positions(t, idf)
            for s in range(-len(tw), len(w)):
                votes = sum(0 <= s + q < len(w) and w[s + q] == tw[q] for q in rare)
                near = w[max(0, s - L.MARGIN):max(0, min(len(w), s + len(tw) + L.MARGIN))]
                if votes >= min(L.AGREE, len(rare)) and all(places(near, p) for p in must):
                    labels.add(label)
                    total = sum(idf[x] for x in tw)
                    score = max(score, sum(idf[x] for q, x in enumerate(tw) if 0 <= s + q < len(w) and w[s + q] == x) / total)
        out[i, len(w), len(every), every[0] if every else None, every[-1] if every else None,
            ",".join(sorted(base)), ",".join(sorted(labels)), round(score, 9)] += 1
    return out


def test_matches_brute_force(spark):
    rows = [r for r in awkward() if r[0] != 17] + [(400 + n, f"ab cd\n{x} ef {'gh ' * n}") for n, x in enumerate(LINES)] + [(500, " ".join(LINES))]
    got = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9))
                  for r in L.license_scan(frame(spark, rows)).collect())
    assert got == brute(rows)
    by = {k[0]: k for k in got}
    assert by[400][6] == "cc-by,cc-by-nc-4.0" and by[401][6] == "apache,apache-2.0" and by[402][6] == "gpl,gpl-3.0"
    assert by[403][5:7] == ("mit", "mit") and by[404][6] == "" and by[410][6] == ""


def test_empty_table(spark):
    assert L.license_scan(frame(spark, awkward()).where(F.lit(False))).count() == 0


@pytest.mark.parametrize("label,must,template", L.TEMPLATES)
def test_templates_hold_their_key_phrases(label, must, template):
    assert all(places(template.split(), p) for p in must)
