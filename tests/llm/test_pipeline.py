from collections import Counter, defaultdict

import pytest

import corpus_pipeline as C
from tidemark.llm import decontaminate, near, toxicity

from .samples import awkward, frame
from .test_decontaminate import brute_shingles
from .test_near import brute as brute_near

SF = "/root/testdata/sf0.01"


def rows_of(df):
    return Counter(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output rows of every stage, as run() chains them."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (_, f) in enumerate(C.STAGES):
        made = f(spark, docs, SF)
        if k < 4:
            assert made.columns == docs.columns and [t for _, t in made.dtypes] == [t for _, t in docs.dtypes]
            made = C.written(made, "test-stage")
        out.append((docs, made))
        docs = made
    return out


def test_toxicity_drops_what_it_predicts(spark, stages):
    docs, kept = stages[0]
    scores = toxicity.toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    want = docs.join(scores.where("predicted = 0").select("doc_id"), "doc_id", "left_semi")
    assert rows_of(kept) == rows_of(want.select(*docs.columns)) and 0 < kept.count() < docs.count()


def test_one_of_each_group_stays(stages):
    docs, kept = stages[1]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = {c for _, c, _ in brute_near(rows)}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want) and len(want) < len(rows)
    assert not rows_of(kept) - rows_of(docs)


def test_documents_with_items_go(spark, stages):
    docs, kept = stages[2]
    items = [brute_shingles(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = [r for r in docs.collect() if all(len(q & s) < 0.8 * len(q) for s in [brute_shingles(r.text)] for q in items if q)]
    assert rows_of(kept) == Counter(map(tuple, clean)) and len(clean) < docs.count()


def test_personal_data_and_counts(stages):
    docs, kept = stages[3]
    before, after = ({r.doc_id: r for r in d.collect()} for d in (docs, kept))
    assert before.keys() == after.keys()
    changed = [i for i in before if before[i].text != after[i].text]
    assert 0 < len(changed) < 0.3 * len(before)
    assert all(after[i].n_chars == len(after[i].text) and after[i].source == before[i].source for i in after)


def test_packing_holds_every_document(spark, stages):
    docs, packed = stages[4]
    rows = packed.collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}
    bins = defaultdict(int)
    for r in rows:
        bins[r.sequence_id] += r.length
    assert max(bins.values()) <= 2048
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in C.run(spark, SF).collect()) == \
        Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)


def test_filters_on_awkward_rows(spark):
    docs = frame(spark, awkward())
    kept = near.deduplicated(docs)
    assert kept.columns == docs.columns
    groups = brute_near(awkward())
    named = sum(1 for i, t in awkward() if not (t or "").split())
    assert kept.count() == named + len({c for (i, c, _) in groups if c is not None and any((t or "").split() for j, t in awkward() if j == c)}) \
        + sum(1 for i, t in awkward() if i is None and t)
    dotted = docs.withColumnRenamed("lang", "a.b").withColumnRenamed("source", "row").withColumnRenamed("n_chars", "kid")
    assert near.deduplicated(dotted).columns == dotted.columns and near.deduplicated(dotted).count() == kept.count()
    labels = spark.createDataFrame([(5, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.fit(dotted, labels).accepted(dotted).columns == dotted.columns
    assert toxicity.fit(docs, labels).accepted(docs).columns == docs.columns
    none = spark.createDataFrame([], "item_id long, text string")
    assert rows_of(decontaminate.decontaminated(docs, none)) == rows_of(docs)
