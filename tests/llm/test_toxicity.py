import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.llm import text as tx
from tidemark.llm import toxicity as X

from .samples import awkward, frame


def plain(text):
    """The same features, from Python strings."""
    text = text or ""
    raw = text.encode()
    low = bytearray(raw)
    for i, b in enumerate(raw):
        if 0x41 <= b <= 0x5A or (i and raw[i - 1] == 0xC3 and 0x80 <= b <= 0x9E and b != 0x97):
            low[i] += 0x20
    spans = [m.span() for m in re.finditer(rb"[0-9a-z\x80-\xff]+", bytes(low))]
    words = [bytes(low[a:b]) for a, b in spans]
    n = max(len(words), 1)
    insult = [w.decode("utf8", "replace") in X.INSULTS for w in words]
    you = [i for i, w in enumerate(words) if w.decode("utf8", "replace") in X.SECOND_PERSON]
    near = [any(abs(i - j) <= X.NEAR for j in you) for i, h in enumerate(insult) if h]
    letters = max(sum(chr(b).isalpha() if b < 128 else True for b in raw), 1)
    upper = sum(0x41 <= b <= 0x5A for b in raw)
    is_letter = lambda b: b >= 128 or chr(b).isalpha()
    long3 = sum(raw[i] == raw[i - 1] == raw[i - 2] and is_letter(raw[i]) for i in range(2, len(raw)))
    odd = sum(raw[i] in b"0123456789@$*#%!" and is_letter(raw[i - 1]) and is_letter(raw[i + 1]) for i in range(1, len(raw) - 1))
    shout = sum(b - a > 1 and all(0x41 <= c <= 0x5A for c in raw[a:b]) for a, b in spans)
    punct = sum(33 <= b < 127 and not chr(b).isalnum() for b in raw)
    return [sum(insult) / n, 0, 0, 0, 0, float(any(insult)), sum(near) / n, len(you) / n, upper / letters, shout / n,
            raw.count(b"!") / n, punct / n, long3 / n, odd / n, np.log1p(len(words))]


def test_features_match_plain_python():
    texts = [t for _, t in awkward()] + ["You are an IDIOT, moron!!! sooo st*pid 1diot", "du DUMMKOPF über Éa ÉA tú"]
    buf, off = tx.flat(pa.array(texts))
    none = X.Lexicon(np.empty(0, dtype=tx.U64), np.empty(0))
    got = np.stack(X.features(buf, off, X.fixed(X.INSULTS), X.fixed(X.SECOND_PERSON), none), axis=1)
    np.testing.assert_allclose(got, np.array([plain(t) for t in texts]), atol=1e-12)


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = X.toxicity(docs, labels)
    joined = out.join(labels, "doc_id").where("held_out").select("score", "predicted", "toxic").toPandas()
    bad, good = joined.score[joined.toxic == 1].values, joined.score[joined.toxic == 0].values
    assert (bad[:, None] > good).mean() + 0.5 * (bad[:, None] == good).mean() > 0.97
    assert (joined.predicted == joined.toxic).mean() > 0.97
    assert out.count() == docs.count() and joined.score.between(0, 1).all()


def test_held_out_labels_are_not_learned(spark):
    rows = [(i, "you idiot moron" if i % 3 == 0 else "fine words here") for i in range(400)]
    docs = frame(spark, rows)
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    labels = [(i, 1, int(i % 3 == 0)) for i in range(400)]
    other = [(i, q, 1 - t if i in held else t) for i, q, t in labels]
    schema = "doc_id long, quality int, toxic int"
    a, b = ({(r.doc_id, r.score, r.held_out) for r in X.toxicity(docs, spark.createDataFrame(x, schema)).collect()} for x in (labels, other))
    assert a == b and {i for i, _, h in a if h} == set(held)
    assert all((s >= 0.5) == (i % 3 == 0) for i, s, _ in a)


def test_awkward_rows_and_missing_classes(spark):
    docs = frame(spark, awkward())
    schema = "doc_id long, quality int, toxic int"
    none = X.toxicity(docs, spark.createDataFrame([], schema)).collect()
    assert len(none) == len(awkward()) and {r.score for r in none} == {0.0}
    one = X.toxicity(docs, spark.createDataFrame([(5, 1, 1), (None, 1, 1), (6, 1, None), (999, 0, 0)], schema)).collect()
    assert {r.score for r in one} <= {0.0, 1.0} and len(one) == len(none)
    assert X.toxicity(docs.where(F.lit(False)), spark.createDataFrame([(5, 1, 1)], schema)).count() == 0


def test_a_task_holds_little_beside_its_batch():
    text = "some words that no document repeats, number %d, and a few more of them " * 40
    batch = pa.record_batch({"text": [text % tuple(range(i, i + 40)) for i in range(1_500)], "label": pa.array([i % 2 for i in range(1_500)], pa.int32())})
    whole = {}
    tracemalloc.start()
    try:
        for part in X.entry_counts(iter([batch])):
            for name, *n in zip(*(c.to_pylist() for c in part.columns)):
                whole[name] = [a + b for a, b in zip(whole.get(name, (0, 0)), n)]
            del part
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert batch.nbytes > 4 << 20 and peak < 80 << 20
    assert max(map(tuple, whole.values())) == (750, 750)  # an entry of all rows is counted once a row, in whatever slice


def test_texts_go_to_python_once(spark, monkeypatch):
    docs = frame(spark, awkward())
    sent = []
    monkeypatch.setattr(X, "featured", lambda rows, *a, f=X.featured, **b: sent.append(rows.schema) or f(rows, *a, **b))
    model = X.fit(docs, spark.createDataFrame([(5, 1, 0)], "doc_id long, quality int, toxic int"))
    assert sorted(map(str, model.accepted(docs).collect())) == sorted(map(str, docs.collect()))
    assert [f.name for f in sent[-1]] == ["text", "row"] and "text" not in sent[-1]["row"].dataType.names
    alone = docs.select("text")
    assert sorted(map(str, model.accepted(alone).collect())) == sorted(map(str, alone.collect()))
    named = docs.withColumnRenamed("text", "a b").withColumnRenamed("lang", "text")
    kept = model.accepted(named.withColumnRenamed("text", "x.y"), text_col="a b")
    assert kept.columns == [c if c != "text" else "x.y" for c in named.columns] and kept.count() == docs.count()
