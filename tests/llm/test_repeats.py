import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import anchors, repeats, substring, suffix
from tidemark.llm import text as tx

from .samples import awkward, frame


def brute_words(rows, size):
    """By definition: a window is a repeat if its words start earlier. Rows with one id and text are one place."""
    first, docs = {}, []
    for i, t in rows:
        docs.append((i, (t or "").encode().split()))
    for i, w in docs:
        for s in range(len(w) - size + 1):
            k, at = tuple(w[s:s + size]), (i is not None, i or 0, s)
            first[k] = min(first.get(k, at), at)
    out = Counter()
    for i, w in docs:
        gone = set()
        for s in range(len(w) - size + 1):
            if first[tuple(w[s:s + size])] < (i is not None, i or 0, s):
                gone |= set(range(s, s + size))
        kept = b" ".join(x for n, x in enumerate(w) if n not in gone)
        out[i, len(w), len(gone), hashlib.sha256(kept).hexdigest()] += 1
    return out


def brute_bytes(rows, size):
    seen, docs = Counter(), [(i, (t or "").encode()) for i, t in rows]
    for _, b in docs:
        seen.update(b[s:s + size] for s in range(len(b) - size + 1))
    out = Counter()
    for i, b in docs:
        gone = np.zeros(len(b) + 1, dtype=bool)
        for s in range(len(b) - size + 1):
            if seen[b[s:s + size]] > 1:
                gone[s:s + size] = True
        gone = gone[:-1]
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(gone) else 0
        out[i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, dtype=np.uint8)[~gone])).hexdigest()] += 1
    return out


def planted(seed):
    """Texts over few words with passages cut out of each other, so that repeats begin and end everywhere."""
    rng = random.Random(seed)
    vocab = [f"{a}{b}" for a in "abcdef" for b in ("", "lo", "mix", "é")]
    base = [rng.choice(vocab) for _ in range(400)]
    rows = []
    for i in range(60):
        words = [rng.choice(vocab) for _ in range(rng.randrange(5, 80))]
        for _ in range(rng.randrange(4)):
            a = rng.randrange(380)
            cut = base[a:a + rng.randrange(3, 90)]
            if rng.random() < 0.4 and cut:
                cut[rng.randrange(len(cut))] = "edit"
            words[rng.randrange(len(words)):0] = cut
        rows.append((i, rng.choice([" ", "\n", "  "]).join(words)))
    rows += [(900 + i, " ".join(base[50:50 + 22 + i] + [f"own{i}"] * (i % 3))) for i in range(100)]  # one passage, many ends
    return rows + [(2000, "go " * 500), (2001, "go " * 70 + "stop " + "go " * 40), (2002, "ab" * 700), (2003, "ab" * 333 + "x")]


def distinct_ids(rows):
    return [r for n, r in enumerate(rows) if r[0] is not None]


@pytest.mark.parametrize("rows", [awkward(), planted(1), planted(2)], ids=["awkward", "planted", "planted2"])
def test_words_match_brute_force(spark, rows):
    rows = rows if any(i is None for i, _ in rows) else rows + [(None, rows[0][1])]
    got = Counter(tuple(r) for r in substring.remove_repeated_words(frame(spark, rows)).collect())
    assert got == brute_words(rows, 20)
    assert sum(k[2] * n for k, n in got.items()) > 1000


@pytest.mark.parametrize("rows", [awkward(), planted(1), planted(2)], ids=["awkward", "planted", "planted2"])
def test_bytes_match_brute_force(spark, rows):
    got = Counter(tuple(r) for r in suffix.remove_repeated_bytes(frame(spark, rows), 100).collect())
    assert got == brute_bytes(rows, 100)
    assert sum(k[2] * n for k, n in got.items()) > 1000


@pytest.mark.parametrize("rows", [awkward(), planted(1)], ids=["awkward", "planted"])
def test_refinement_matches_brute_force(spark, rows):
    got = Counter(tuple(r) for r in suffix.remove_repeated_bytes(frame(spark, rows), 100, method="refinement").collect())
    assert got == brute_bytes(rows, 100)
    none = frame(spark, rows).where(F.lit(False))
    assert suffix.remove_repeated_bytes(none, method="refinement").count() == 0


def test_both_methods_agree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    a, b = (Counter(tuple(r) for r in suffix.remove_repeated_bytes(docs, method=m).collect()) for m in ("anchors", "refinement"))
    assert a == b and sum(k[2] * n for k, n in a.items()) > 100_000


def test_bytes_of_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = Counter(tuple(r) for r in suffix.remove_repeated_bytes(frame(spark, rows)).collect())
    assert got == brute_bytes(rows, 400)


def test_kept_texts_and_empty_table(spark):
    docs = frame(spark, planted(3))
    for r in substring.remove_repeated_words(docs, with_text=True).collect():
        assert hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 and len(r.kept.split()) == r.n_words - r.n_removed
    for r in suffix.remove_repeated_bytes(docs, 100, with_text=True).collect():
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed
    none = docs.where(F.lit(False))
    assert substring.remove_repeated_words(none).count() == suffix.remove_repeated_bytes(none).count() == 0


@pytest.mark.parametrize("kind", ["words", "bytes"])
def test_equal_windows_choose_alike(kind):
    """Every window is in one run, and windows of equal content have equal keys wherever they stand."""
    texts = [t for _, t in planted(4)] + ["", "a b"] + ["no. " + "a b " * n + "yes" for n in (30, 47)] + ["a b b " * 40, "q " + "a b b " * 30]
    import pyarrow.parquet as pq
    if kind == "words":
        texts += pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"])["text"].to_pylist()
    if kind == "words":
        values, off = substring.word_units(pa.array(texts))
        chooser = anchors.WordAnchors(20, 3)
    else:
        values, off = tx.flat(pa.array(texts))
        chooser = anchors.ByteAnchors(60, 15, 8)
    runs, _ = chooser.runs(values, off)
    starts, doc = anchors.window_starts(off, chooser.length)
    assert runs.count.sum() == len(starts)
    assert (np.repeat(runs.start, runs.count) + np.arange(len(starts)) - np.repeat(np.cumsum(runs.count) - runs.count, runs.count) == starts).all()
    keys, wholes = defaultdict(set), defaultdict(set)
    for s, k in zip(starts, np.repeat(runs.key, runs.count)):
        keys[values[s:s + chooser.length].tobytes()].add(int(k))
    assert all(len(k) == 1 for k in keys.values())
    for s, c, w in zip(runs.start, runs.count, runs.whole):
        wholes[int(w)].add(values[s:s + c - 1 + chooser.length].tobytes())
    assert all(len(w) == 1 for w in wholes.values())


@pytest.mark.parametrize("own", [None, 7], ids=["null ids", "one id"])
def test_many_texts_of_one_id(spark, own):
    """20,000 documents share an id, passages of theirs repeat: each is its own document."""
    rng = random.Random(9)
    vocab = [f"{a}{b}{c}" for a in "abcdefgh" for b in "aeiou" for c in ("n", "rs", "lt")]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    passages = [say(24) for _ in range(300)]
    texts = []
    for _ in range(20_000):
        w = say(rng.randrange(3, 30))
        if rng.random() < 0.3:
            w[len(w) // 2:0] = rng.choice(passages)
        texts.append(" ".join(w))
    df = spark.createDataFrame([(own, t) for t in texts], "doc_id long, text string").repartition(6)
    prints = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    # brute force: documents are ordered by their text's hash
    ranked = sorted(set(texts), key=lambda t: prints[t])
    as_rows = [(n, t) for n, t in enumerate(ranked)]
    copies = Counter(texts)
    want = Counter()
    for (n, _, gone, sha), c in brute_words(as_rows, 20).items():
        want[len(ranked[n].split()), gone, sha] += c * copies[ranked[n]]
    got = Counter((r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove_repeated_words(df).collect())
    assert got == want
    got = Counter(tuple(r)[1:] for r in suffix.remove_repeated_bytes(df, 60).collect())
    want = Counter()
    for k, c in brute_bytes([(n, t) for n, t in enumerate(texts)], 60).items():
        want[k[1:]] += c
    assert got == want


def test_folding_keeps_the_answer(spark, monkeypatch):
    """A key with many wholes is spread, marked, and still resolved."""
    folder = repeats.Folder()
    rng = np.random.default_rng(0)
    n = 5000
    key = np.where(rng.random(n) < 0.5, 7, rng.integers(0, 50, n) + 100).astype(np.uint64)
    whole = rng.integers(0, 900, n).astype(np.uint64)
    list(folder.add(key, whole, rng.integers(0, 40, n), rng.integers(0, 3, n), rng.integers(0, 9, n), np.ones(n, dtype=np.int64)))
    out = folder.flush().to_pydict()
    flags = Counter(out["flags"])
    assert flags[repeats.MARKER] == 1 and flags[repeats.SPREAD_FLAG] > 64 and sum(out["n"]) == n
    spread = [k for k, f in zip(out["key"], out["flags"]) if f == repeats.SPREAD_FLAG]
    assert len(set(spread)) == len(spread)
