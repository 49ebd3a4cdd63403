import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import spelling as S

from .samples import awkward, frame

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def brute(rows):
    words = words_of(rows)
    near = defaultdict(set)  # words that share what is left of one deletion are candidates
    held = defaultdict(list)
    for w in words:
        for key in {w, *(w[:i] + w[i + 1:] for i in range(len(w)))}:
            held[key].append(w)
    for group in held.values():
        for a in group:
            near[a] |= {b for b in group if one_edit(a, b)}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda b: (-words[b], b), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return out


def planted(seed):
    """Words that differ by one edit in every place, chains of forms, repeated letters, upper case, accents."""
    rng = random.Random(seed)
    base = ["accommodate", "aaaaaaa", "ababababab", "naïveté", "straße", "ÉCOLES", "zzzzz", "banana"] + [
        "".join(rng.choice("abeéüß") for _ in range(rng.randrange(5, 9))) for _ in range(60)]
    bag = []
    for w in base:
        bag += [w] * rng.choice((1, 3, 12, 50))
        for _ in range(6):
            i, c = rng.randrange(len(w)), rng.choice("abeéÀ")
            v = rng.choice((w[:i] + w[i + 1:], w[:i] + c + w[i:], w[:i] + c + w[i + 1:], w + c))
            bag += [v] * rng.choice((1, 3, 6, 20))
    for k in range(8):  # a chain whose counts double
        bag += ["chained" + "x" * k] * 3 * 2 ** k
    rng.shuffle(bag)
    return [(i, rng.choice((" ", "-", "9", "\n", "日")).join(bag[i * 20:i * 20 + 20])) for i in range(len(bag) // 20 + 1)]


def test_matches_brute_force(spark):
    for rows in (planted(1), awkward() + planted(2) + [(7000, "Wörter " * 9 + "y" * 3000 + " " + "y" * 3000 + " " + "y" * 3000 + " " + "y" * 2999 + "z" * 3)]):
        got = [tuple(r) for r in S.spelling_variants(frame(spark, rows)).collect()]
        want = brute(rows)
        assert len(got) == len(set(got)) and set(got) == want
        assert sum(r[1] is not None for r in want) > 20 and any(r[1] != r[2] and r[1] for r in want)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert {tuple(r) for r in S.spelling_variants(docs).collect()} == brute(rows)


def test_long_text_and_empty_tables(spark):
    rng = random.Random(3)
    text = " ".join("".join(rng.choice("abcé") for _ in range(6)) for _ in range(250_000))  # longer than a slice
    rows = [(1, text), (2, None), (3, "")]
    assert {r.word: r.n for r in S.vocabulary(frame(spark, rows)).collect()} == words_of(rows)
    assert S.spelling_variants(frame(spark, rows[1:])).count() == 0
    assert S.spelling_variants(frame(spark, rows).where(F.lit(False))).count() == 0


def test_folding_and_hashes():
    texts = ["Ab " * 5, "x" * 200 + " né", ""]
    buf = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    start, end = np.array([0, 3, 0]), np.array([2, 150, 100])
    seeds = np.array([zlib.crc32(b"1:"), zlib.crc32(b"2:"), 0], dtype=np.uint32)
    assert [int(c) for c in S.crcs(buf, start, end, seeds)] == [zlib.crc32(buf[a:b].tobytes(), int(s)) for a, b, s in zip(start, end, seeds)]
    assert S.found(pa.array(["1"]), pa.array([None], pa.string())).to_pylist() == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text("abc", min_size=5, max_size=9), st.integers(0, 8), st.sampled_from("abcd"), st.integers(0, 2)), min_size=1, max_size=12))
def test_near_words_always_meet(made):
    """Any two near words share a pivot with a prefix at a place that the index allows, whatever the weights."""
    words = set()
    for w, i, c, kind in made:
        i %= len(w)
        words |= {w, (w[:i] + w[i + 1:], w[:i] + c + w[i:], w[:i] + c + w[i + 1:])[kind]}
    words = sorted(w for w in words if len(w) >= 5)
    weights = Counter(w[i:i + 2] for w in words for i in range(len(w) - 1))
    run, _ = S._indexed(weights)
    batch = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([1] * len(words), pa.int64())], names=["word", "n"])
    rows = [r for b in run([batch]) for r in b.to_pylist()]
    pivot, prefix = defaultdict(set), defaultdict(set)
    for r in rows:
        (pivot if r["pivot"] else prefix)[r["key"]].add((r["word"], r["letters"]))
    met = {frozenset((a, b)) for k in pivot for a, x in pivot[k] for b, y in prefix.get(k, ()) if a != b and ((x ^ y) & (2 ** 64 - 1)).bit_count() <= 2}
    assert all(frozenset((a, b)) in met for a in words for b in words if one_edit(a, b))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(1, 9)), min_size=3, max_size=7))
def test_pivots_are_the_lightest_without_overlap(made):
    places = np.cumsum([g for g, _ in made[:3]] + [1 + g for g, _ in made[3:]]) + np.arange(len(made))
    grams = [(int(p), w) for p, (_, w) in zip(places, made)]
    pairs = [(grams[i][1] + grams[j][1], i, j) for i in range(len(grams)) for j in range(i) if grams[i][0] - grams[j][0] >= S.GRAM]
    if pairs:
        chosen = S.pivots(grams)
        assert len(chosen) == 2 and grams[chosen[1]][0] - grams[chosen[0]][0] >= S.GRAM
        assert sum(grams[k][1] for k in chosen) == min(pairs)[0]
