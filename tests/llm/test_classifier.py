import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import classifier as Q
from tidemark.llm import text as tx

from .samples import awkward, frame

LABELS = "doc_id long, quality int, toxic int, score double"


def plain(text):
    """The statistics from Python strings."""
    raw = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    n, size = max(len(words), 1), max(len(raw), 1)
    lengths = [len(w.decode("utf8", "replace")) for w in words]
    mean = sum(lengths) / n
    lines = [x for x in raw.split(b"\n") if re.search(rb"[^\x20\x09-\x0D]", x)]
    some = max(len(lines), 1)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(8)}
    is_letter = lambda b: b >= 128 or chr(b).isalpha()
    punct = lambda b: 33 <= b < 127 and not chr(b).isalnum()
    upper = lambda s: sum(65 <= b <= 90 for b in s)
    letters = lambda s: sum(map(is_letter, s))
    bytes_ = Counter(raw)
    return [math.log1p(len(words)), mean, math.sqrt(max(sum(x * x for x in lengths) / n - mean * mean, 0)), len(words) / some,
            sum(b in b"#*$%&|<>" for b in raw) / n, sum(map(punct, raw)) / size, sum(48 <= b < 58 for b in raw) / size, upper(raw) / max(letters(raw), 1),
            sum(upper(w) >= 2 and upper(w) == letters(w) for w in words) / n, raw.count(b"!") / n, sum(b == 32 or 9 <= b < 14 for b in raw) / size,
            sum(b >= 128 for b in raw) / size, (len(lines) - len(set(lines))) / some, len(covered) / n, len(set(words)) / n,
            max(Counter(words).values(), default=0) / n, sum(a == b for a, b in zip(words, words[1:])) / n, sum(x <= 3 for x in lengths) / n,
            sum(letters(w) == 0 for w in words) / n, sum(re.findall(rb"[^\x20\x09-\x0D]+", x)[-1][-1] in b".!?" for x in lines) / some,
            -sum(c / size * math.log2(c / size) for c in bytes_.values()), max(bytes_.values(), default=0) / size]


def test_statistics_match_plain_python():
    texts = [t for _, t in awkward()] + ["One. Two!\nTHREE 3 |||\n\nOne. Two!\n", "\n\n", "a"]
    got = Q.statistics(*tx.flat(pa.array(texts)))
    np.testing.assert_allclose(got, np.array([plain(t) for t in texts]), atol=1e-9)
    long = " ".join(texts[4] for _ in range(3000))  # longer than a slice
    np.testing.assert_allclose(Q.statistics(*tx.flat(pa.array([long, "b"])))[0], plain(long), atol=1e-9)


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = Q.quality(docs, labels)
    joined = out.join(labels, "doc_id").where("held_out").select("score", "predicted", "quality").toPandas()
    good, bad = joined.score[joined.quality == 1].values, joined.score[joined.quality == 0].values
    assert (good[:, None] > bad).mean() + 0.5 * (good[:, None] == bad).mean() > 0.97
    assert (joined.predicted == joined.quality).mean() > 0.97
    assert out.count() == docs.count() and joined.score.between(0, 1).all()


def learning(rng, n):
    """Rows whose label follows two statistics."""
    grid = rng.integers(0, Q.GRID, (n, Q.WIDTH)).astype("<u2")
    grid[:, 3] = 7  # one value only
    label = ((grid[:, 1] > 2000) ^ (grid[:, 5] < 1500)).astype(int)
    return grid, label


def brute_split(bins, g, h, rows):
    """Best split of the rows by trying each, as (gain, statistic, threshold)."""
    best = (1e-9, 0, Q.BINS)
    for f in range(Q.WIDTH):
        for t in range(Q.BINS):
            left, right = rows & (bins[:, f] <= t), rows & (bins[:, f] > t)
            if left.sum() >= Q.LEAST and right.sum() >= Q.LEAST:
                worth = lambda m: g[m].sum() ** 2 / (h[m].sum() + Q.RIDGE)
                gain = worth(left) + worth(right) - worth(rows)
                if gain > best[0] + 1e-7:
                    best = (gain, f, t)
    return best


def test_trees_match_brute_force_and_any_dealing(spark, monkeypatch):
    monkeypatch.setattr(Q, "TREES", 2)
    rng = np.random.default_rng(5)
    grid, label = learning(rng, 600)
    rows = spark.createDataFrame([(int(y), r.tobytes()) for y, r in zip(label, grid)], "label int, grid binary")
    model = Q.fit(rows.repartition(5))
    again = Q.fit(rows.repartition(2))
    assert all((getattr(model, a) == getattr(again, a)).all() for a in ("lut", "feature", "threshold", "leaf"))
    bins = model.bins(grid)
    raw = np.full(len(label), model.base)
    for tree in range(2):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - label, p * (1 - p)
        at = [np.ones(len(label), dtype=bool)]
        for node in range(2 ** Q.DEPTH - 1):
            gain, f, t = brute_split(bins, g, h, at[node])
            mine = (int(model.feature[tree, node]), int(model.threshold[tree, node]))
            left = bins[:, mine[0]] <= mine[1]
            if mine != (f, t):  # a tie but for rounding
                worth = lambda m: g[m].sum() ** 2 / (h[m].sum() + Q.RIDGE)
                assert abs(worth(at[node] & left) + worth(at[node] & ~left) - worth(at[node]) - (gain if t < Q.BINS else 0)) < 1e-4
            at += [at[node] & left, at[node] & ~left]
        for leaf in range(2 ** Q.DEPTH):
            inside = at[2 ** Q.DEPTH - 1 + leaf]
            if inside.any():
                assert model.leaf[tree, leaf] == pytest.approx(-Q.RATE * g[inside].sum() / (h[inside].sum() + Q.RIDGE), abs=1e-5)
            raw[inside] += model.leaf[tree, leaf]
    np.testing.assert_allclose(model.raw(bins), raw)


def test_quantile_bins():
    counts = np.zeros((Q.WIDTH, Q.GRID), dtype=np.int64)
    counts[0, :] = 3
    counts[1, 5], counts[1, 9], counts[1, 4000] = 1000, 1, 1
    lut = Q.quantile_bins(counts)
    assert len(set(lut[0])) == Q.BINS and (np.diff(lut.astype(int), axis=1) >= 0).all()
    assert lut[1, 5] < lut[1, 9] <= lut[1, 4000] and (lut[2] == 0).all()


def test_held_out_labels_are_not_learned(spark):
    rows = [(i, "### $$$ %%% ||| " * 5 if i % 3 == 0 else "fine words stand here in a line.") for i in range(300)]
    docs = frame(spark, rows)
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1]
    labels = [(i, int(i % 3 != 0), 0, 0.1) for i in range(300)]
    other = [(i, 1 - q if i in held else q, t, s) for i, q, t, s in labels]
    a, b = ({(r.doc_id, r.score, r.held_out) for r in Q.quality(docs, spark.createDataFrame(x, LABELS)).collect()} for x in (labels, other))
    assert a == b and {i for i, _, h in a if h} == set(held)
    assert all((s >= 0.5) == (i % 3 != 0) for i, s, _ in a)


def test_awkward_rows_and_missing_classes(spark):
    docs = frame(spark, awkward())
    none = Q.quality(docs, spark.createDataFrame([], LABELS)).collect()
    assert len(none) == len(awkward()) and {r.score for r in none} == {0.0} and {r.predicted for r in none} == {0}
    one = Q.quality(docs, spark.createDataFrame([(i, 1, 1, 0.0) for i in (5, 8, 9, 10, 11, 12)] + [(None, 0, 1, 0.0), (6, None, 0, 0.0), (999, 0, 0, 0.0)], LABELS)).collect()
    assert {r.score for r in one} == {1.0} and len(one) == len(none)
    assert Q.quality(docs.where(F.lit(False)), spark.createDataFrame([(5, 1, 1, 0.0)], LABELS)).count() == 0
