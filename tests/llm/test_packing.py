import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import packing

from .samples import awkward, frame

PATH = P.path("byte_bpe_50k.json")


def plain_ids(text):
    t = Tokenizer.from_file(PATH)
    return t.encode(text or "", add_special_tokens=False).ids + [0]


TOKENIZER = Tokenizer.from_file(PATH)


def test_special_strings_are_tokens():
    assert packing.encoder(PATH)(["a <|endoftext|> b"]) == [[64, 220, 50256, 275]]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|endoftext", "|>", " ", "\n ", "a", " b", "é"]), max_size=12))
def test_engines_agree_around_special_strings(parts):
    text = "".join(parts)
    assert packing.encoder(PATH)([text])[0] == TOKENIZER.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab 'sé 　 \t\n\r1,.😀日\x85\x1c")) | st.characters(exclude_categories=["Cs"]), max_size=40))
def test_both_engines_agree(text):
    assert packing.encoder(PATH)([text])[0] == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_engines_agree_on_documents_and_extremes():
    import pyarrow.parquet as pq
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()
    texts += [" " * 50_000, "a" + "\n" * 3_000 + "b", "x" * 100_000, "<|endoftext|> a<|endoftext|>", "1" * 5_000]
    assert packing.encoder(PATH)(texts) == [e.ids for e in TOKENIZER.encode_batch(texts, add_special_tokens=False)]


def test_file_without_ranks_takes_its_own_engine():
    other = P.path("word_bpe_49k.json")
    assert packing.byte_ranks(other) is None
    assert packing.encoder(other)(["some words Here"]) == [Tokenizer.from_file(other).encode("some words Here", add_special_tokens=False).ids]


def one_by_one(lengths, capacity):
    left = []
    for x in sorted(lengths, reverse=True):
        fit = [(r, i) for i, r in enumerate(left) if r >= x]
        if fit:
            r, i = min(fit)
            left[i] -= x
        else:
            left.append(capacity - x)
    return Counter(left)


def test_plan_is_best_fit_decreasing():
    rng = random.Random(5)
    for _ in range(60):
        cap = rng.choice([1, 7, 40, 100])
        lengths = [min(cap, 1 + int(rng.paretovariate(0.7))) for _ in range(rng.randrange(0, 400))]
        hist = Counter(lengths)
        used = defaultdict(int)
        steps = sorted(packing.plan(hist, cap))
        for length, n in hist.items():
            own = [s for s in steps if s[0] == length]
            for r in range(n):
                s = [s for s in own if s[1] <= r][-1]
                used[s[2] + (r - s[1]) // s[3]] += length
        assert Counter(cap - u for u in used.values()) == one_by_one(lengths, cap)


def test_pack_whole_table(spark):
    rows = awkward() + [(300 + i, "copy of one text") for i in range(500)]
    out = packing.pack(frame(spark, rows), PATH, 256).collect()
    want = Counter()
    for i, t in rows:
        ids = np.array(plain_ids(t), dtype="<u4")
        first = len(ids) % 256 or 256
        at = [0, *range(first, len(ids) + 1, 256)]
        for n, (a, b) in enumerate(zip(at, at[1:])):
            want[i, n, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    bins = defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():  # gapless from 0, within the capacity
        b.sort()
        assert [o for o, _ in b] == [sum(n for _, n in b[:k]) for k in range(len(b))] and sum(n for _, n in b) <= 256
    assert len(bins) == sum(one_by_one([r.length for r in out], 256).values())


def test_empty_table(spark):
    assert packing.pack(frame(spark, awkward()).where(F.lit(False)), PATH).count() == 0
