import random
import re

from pyspark.sql import functions as F

from tidemark.llm import decontaminate

from .samples import awkward, frame


def words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute_shingles(text, size=5):
    w = words(text)
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)}


def items_of(rows):
    by = dict(rows)
    out = []
    for n, (d, a, b) in enumerate([(9, 45, 70), (10, 0, 30), (17, 1000, 1060), (17, 40, 52), (17, 5000, 5300), (5, 0, 120), (202, 0, 9)]):
        w = by[d].split()[a:b]
        out.append((n, " ".join(w)))
        w = list(w)
        if len(w) > 12:
            w[len(w) // 2] = "other"
        out.append((100 + n, "; ".join(w).title()))
    return [*out, (500, None), (501, ""), (502, "too short here"), (None, out[0][1]), (0, out[0][1]), (503, "not found in any of these documents at all")]


def brute(rows, items):
    out = set()
    for d, t in rows:
        for i, x in items:
            size = min(5, len(words(x))) or 5
            s, q = brute_shingles(t, size), brute_shingles(x, size)
            if q and len(q & s) >= 0.8 * len(q):
                out.add((d, i, len(q), len(q & s)))
    return out


def test_pairs_match_brute_force(spark):
    rows = awkward()
    items = items_of(rows)
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in decontaminate.contaminated(frame(spark, rows), table).collect()}
    assert got == brute(rows, items) and len(got) > 20


def test_blocks_give_the_same(spark):
    rows = awkward()
    items = items_of(rows)
    table = spark.createDataFrame(items, "item_id long, text string")
    kept, decontaminate.BLOCK_SHINGLES = decontaminate.BLOCK_SHINGLES, 300
    try:
        got = {(r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in decontaminate.contaminated(frame(spark, rows), table).collect()}
    finally:
        decontaminate.BLOCK_SHINGLES = kept
    assert got == brute(rows, items)


def test_short_items_are_all_found(spark):
    """Items of one to eight words, each whole in some document: none is left to chance."""
    rng = random.Random(4)
    vocab = [f"{a}{b}" for a in "abcdefghij" for b in range(300)]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(400))) for i in range(60)]
    items = []
    for n in range(1500):
        w, size = rng.choice(rows)[1].split(), 1 + n % 8
        at = rng.randrange(len(w) - size)
        items.append((n, " ".join(w[at:at + size])))
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in decontaminate.contaminated(frame(spark, rows), table).collect()}
    assert got == brute(rows, items) and {i for _, i, _, _ in got} == set(range(1500))


def test_long_texts_are_read_whole(spark):
    rng = random.Random(5)
    text = " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(250_000))  # longer than a slice
    items = [(1, " ".join(text.split()[-40:])), (2, " ".join(text.split()[120_000:120_004]))]
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(frame(spark, [(1, text), (2, "none")]),
                                                                     spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(1, 1), (1, 2)}


def test_rows_without_items_stay(spark):
    rows = awkward()
    items = items_of(rows)
    found = {d for d, _, _, _ in brute(rows, items)}
    table = spark.createDataFrame(items, "item_id long, text string")
    for block in (decontaminate.BLOCK_SHINGLES, 300):
        kept, decontaminate.BLOCK_SHINGLES = decontaminate.BLOCK_SHINGLES, block
        try:
            got = sorted(r.doc_id or -1 for r in decontaminate.decontaminated(frame(spark, rows), table).collect())
        finally:
            decontaminate.BLOCK_SHINGLES = kept
        assert got == sorted(d or -1 for d, _ in rows if d not in found)


def test_empty_tables(spark):
    docs = frame(spark, awkward())
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(docs, none).count() == 0
    some = spark.createDataFrame(items_of(awkward()), "item_id long, text string")
    assert decontaminate.contaminated(docs.where(F.lit(False)), some).count() == 0
