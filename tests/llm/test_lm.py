import math
import re
import zlib
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemark.llm import lm, queries

from .samples import awkward, frame


def tokens_of(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x20\x09-\x0D]+", lower) + [None]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


class Plain:
    """The same model with dictionaries, evaluated recursively."""

    def __init__(self, rows):
        self.uni, self.bi = Counter(), Counter()
        for i, t in rows:
            if not held(i):
                w = tokens_of(t)
                self.uni.update(w)
                self.bi.update(zip([0, *w], w))
        self.total = sum(self.uni.values())
        self.d1, self.d2 = (lm.discounts(Counter(c.values())) for c in (self.uni, self.bi))
        self.unknown = 1 - sum(map(self.known, self.uni)) if self.total else 1.0
        self.after, self.hist = defaultdict(list), Counter()
        for (h, w), c in self.bi.items():
            self.after[h].append(w)
            self.hist[h] += c
        self.weight = {}
        for h, ws in self.after.items():
            left = 1 - sum(self.disc(self.bi[h, w], self.d2) for w in ws) / self.hist[h]
            self.weight[h] = left / (1 - sum(map(self.known, ws)))

    @staticmethod
    def disc(c, d):
        return c * d[c] if c <= lm.K else c - 0.5

    def known(self, w):
        return self.disc(self.uni[w], self.d1) / self.total

    def p(self, w, h):
        if self.bi[h, w]:
            return self.disc(self.bi[h, w], self.d2) / self.hist[h]
        low = self.known(w) if self.uni[w] else self.unknown
        return self.weight[h] * low if h in self.hist else low

    def row(self, i, t):
        w = tokens_of(t)
        v = len(self.uni)
        return (i, held(i), len(w), sum(self.uni[x] > 0 for x in w), self.total,
                round(sum(math.log10((self.uni[x] + 1) / (self.total + v + 1)) for x in w), 6),
                round(sum(math.log10(self.p(x, h)) for h, x in zip([0, *w], w)), 6))


def got(df):
    return Counter((*r[:5], round(r.base_score, 6) + 0.0, round(r.score, 6) + 0.0) for r in df.collect())


def close(a, b):
    a, b = (sorted(c.elements(), key=lambda r: (r[0] is None, *map(str, r[:5]), r[5:])) for c in (a, b))
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x[:5] == y[:5] and x[5:] == pytest.approx(y[5:], abs=3e-6), (x, y)


def test_awkward_rows(spark):
    rows = awkward()
    m = Plain(rows)
    close(got(lm.katz_scores(frame(spark, rows))), Counter(m.row(*r) for r in rows))


def test_documents(spark):
    t = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"])
    rows = list(zip(*t.to_pydict().values()))
    m = Plain(rows)
    out = lm.katz_scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert out.where("held_out").count() > 100
    close(got(out), Counter(m.row(*r) for r in rows))
    for h in [0, "the", "de", "erent", "clown"]:  # exactly normalised
        if h in m.hist:
            assert abs(sum(m.p(w, h) for w in m.uni) + m.weight[h] * m.unknown - 1) < 1e-9


def test_many_stretches_and_frequent_words(spark):
    rows = awkward(3) + [(2000 + i, "the hot pair " * (i % 40) + f"tail{i % 7}") for i in range(300)]
    m = Plain(rows)
    close(got(lm.katz_scores(frame(spark, rows).repartition(7))), Counter(m.row(*r) for r in rows))


def test_no_training_rows_and_empty(spark):
    docs = frame(spark, awkward())
    only = [r for r in awkward() if held(r[0])]
    out = lm.katz_scores(frame(spark, only)).collect()
    assert len(out) == len(only) and all(r.score == 0 and r.n_known == 0 and r.train_tokens == 0 for r in out)
    assert lm.katz_scores(docs.where(F.lit(False))).count() == 0


def test_discounts():
    assert lm.discounts({1: 10}).tolist()[1:3] == [0.5, 0.75]
    d = lm.discounts({1: 1000, 2: 300, 3: 140, 4: 80, 5: 52, 6: 36})
    assert all(0 < x < 1 for x in d[1:])


class Longer:
    """The model of any order with dictionaries: histories are the tokens before, the nearest first."""

    def __init__(self, rows, order):
        self.order = order
        self.counts = [Counter() for _ in range(order)]
        for i, t in rows:
            if not held(i):
                for g in self.grams(t):
                    for m in range(order):
                        self.counts[m][g[: m + 1]] += 1
        self.total = sum(self.counts[0].values())
        self.d = [lm.discounts(Counter(c.values())) for c in self.counts]
        self.after = [defaultdict(list) for _ in range(order)]
        for m, c in enumerate(self.counts):
            for g in c:
                self.after[m][g[1:]].append(g[0])
        self.hist = [{h: sum(self.counts[m][w, *h] for w in ws) for h, ws in a.items()} for m, a in enumerate(self.after)]
        self.unknown = 1 - sum(self.seen((w,)) for w in self.after[0][()]) if self.total else 1.0
        self.weights = {}

    def grams(self, t):
        w = [0] * (self.order - 1) + tokens_of(t)
        return [tuple(w[i - k] for k in range(self.order)) for i in range(self.order - 1, len(w))]

    def seen(self, g):
        c, d = self.counts[len(g) - 1][g], self.d[len(g) - 1]
        return (c * d[c] if c <= lm.K else c - 0.5) / self.hist[len(g) - 1][g[1:]]

    def weight(self, h):
        if h not in self.hist[len(h)]:
            return 1.0
        if h not in self.weights:
            ws = self.after[len(h)][h]
            self.weights[h] = (1 - sum(self.seen((w, *h)) for w in ws)) / (1 - sum(self.p((w, *h[:-1])) for w in ws))
        return self.weights[h]

    def p(self, g):
        if self.counts[len(g) - 1][g]:
            return self.seen(g)
        return self.weight(g[1:]) * self.p(g[:-1]) if len(g) > 1 else self.unknown

    def score(self, t):
        return sum(math.log10(self.p(g)) for g in self.grams(t))


def longer(rows, order):
    """The bigram model's rows with the score of the longer one."""
    m, base = Longer(rows, order), Plain(rows)
    return Counter((*base.row(*r)[:6], round(m.score(r[1]), 6)) for r in rows)


@pytest.mark.parametrize("order", [2, 3, 4])
def test_order(spark, order):
    rows = awkward(3) + [(2000 + i, "the hot pair " * (i % 40) + f"of the tail{i % 7} the pair tail{i % 5}") for i in range(300)]
    close(got(lm.katz_scores(frame(spark, rows).repartition(7), order=order)), longer(rows, order))


@pytest.mark.parametrize("order", [2, 3])
def test_order_in_many_partitions_with_few_common_words(spark, monkeypatch, order):
    monkeypatch.setattr(lm, "PARTITION", 400)
    monkeypatch.setattr(lm, "COMMON", 6)
    rows = awkward(4) + [(3000 + i, f"the pair of the tail{i % 9} and the pair of {'them ' * (i % 5)}") for i in range(200)]
    close(got(lm.katz_scores(frame(spark, rows), order=order)), longer(rows, order))


def test_query_scores_by_trigrams(spark, tmp_path):
    rows = awkward(5) + [(9_000_000 + i, f"one two three two three one {'two ' * (i % 3)}") for i in range(40)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    close(got(queries.op3_lm_scoring(spark, str(tmp_path))), longer(rows, 3))
    m = Longer(rows, 3)
    for h in [(0, 0), ("kata", 0), ("two", "one"), ("three", "two"), ("two", "never seen"), ("never seen", "two")]:  # exactly normalised
        assert abs(sum(m.p((w, *h)) for w in m.after[0][()]) + m.p(("not known", *h)) - 1) < 1e-9


def test_long_histories_without_training_rows(spark):
    only = [r for r in awkward() if held(r[0])]
    assert [r.score for r in lm.katz_scores(frame(spark, only), order=3).collect()] == [0] * len(only)
    assert lm.katz_scores(frame(spark, awkward()).where(F.lit(False)), order=3).count() == 0
    with pytest.raises(ValueError):
        lm.katz_scores(frame(spark, only), order=1)
