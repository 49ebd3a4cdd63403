import re
from collections import Counter

from pyspark.sql import functions as F

from tidemark.llm import quality

from .samples import awkward, frame


def brute(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    seen = Counter(grams)
    covered = {j for i, g in enumerate(grams) if seen[g] > 1 for j in range(i, i + 8)}
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
            n < 20 or 100 * len(covered) > 30 * n)


def test_counts_match_brute_force(spark):
    rows = awkward()
    labels = spark.createDataFrame([(9, 1, 0), (10, 1, 0), (17, 1, 0), (11, 0, 0)], "doc_id long, quality int, toxic int")
    out = quality.quality_rules(frame(spark, rows), labels).collect()
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out)
    assert got == Counter((i, *brute(t)) for i, t in rows)
    assert all(not r.kept for r in out if r.base_failed)
    by = {r.doc_id: r for r in out if r.doc_id is not None}
    assert by[2].score == 0 and by[17].score > by[22].score


def test_scores_match_definition(spark):
    import numpy as np
    rows = [(i, t) for i, t in awkward(2) if i is not None]
    labels = spark.createDataFrame([(9, 1), (5, 1), (17, 1)], "doc_id long, quality int")
    docs = frame(spark, rows)
    got = {(r.doc_id, r.n_words): r.score for r in quality.quality_rules(docs, labels).collect()}
    size = 1 << quality.BITS
    raw, target = np.ones(size), np.ones(size)
    def grams(t):
        b = (t or "").encode()
        return [((b[i] << 16 | b[i + 1] << 8 | b[i + 2]) * 0x9E3779B1 % (1 << 32)) >> (32 - quality.BITS) for i in range(len(b) - 2)]
    for i, t in rows:
        for g in grams(t):
            raw[g] += 1
            target[g] += i in (9, 5, 17)
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    for i, t in rows:
        g = grams(t)
        want = float(np.mean(ratio[g])) if g else 0.0
        assert abs(got[i, brute(t)[0]] - want) < 1e-9


def test_empty_tables_and_no_trusted_rows(spark):
    none = frame(spark, awkward()).where(F.lit(False))
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.quality_rules(none, labels).count() == 0
    assert {r.score for r in quality.quality_rules(frame(spark, awkward()), labels).collect()} == {0.0}
