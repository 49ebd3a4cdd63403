from collections import Counter

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tidemark.llm import components, near

from .samples import awkward, frame


def brute(rows):
    """(doc_id, class_id, n_links) by comparing every pair of texts."""
    sets = []
    for _, t in rows:
        w = [x for x in (t or "").encode().split()]
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    n = len(rows)
    by = {}
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, set()).add(i)
    link = {i: set() for i in range(n)}
    for i in range(n):
        near_i = set().union(*(by[x] for x in sets[i])) if sets[i] else set()
        link[i] = {j for j in near_i if j != i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-12}
    root = {}
    for i in range(n):
        if i in root:
            continue
        todo, seen = [i], {i}
        while todo:
            new = link[todo.pop()] - seen
            seen |= new
            todo += new
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        for j in seen:
            root[j] = min(ids) if ids else None
    return Counter((rows[i][0], root[i], len(link[i])) for i in range(n))


def run(docs):
    return Counter(tuple(r) for r in near.near_duplicates(docs).collect())


def test_rows_of_one_id_meet_their_own_class_only(spark, monkeypatch):
    base = [f"w{n}" for n in range(60)]
    rows = [(None if i % 2 else 7, " ".join([*base, f"end{i}"])) for i in range(40)]  # two ids, 40 classes, one group
    rows += [(None, rows[1][1])] * 20
    met, representatives = [], near._representatives

    def counted(*args):
        out = representatives(*args)
        met.append(out.count())
        return out
    monkeypatch.setattr(near, "_representatives", counted)
    assert run(frame(spark, rows)) == brute(rows)
    assert met == [len(rows)]  # 60 rows, not each row with each class of its id


def test_awkward_rows(spark):
    rows = awkward() + [(800 + i, awkward()[4][1] + f" end{i}") for i in range(40)] + [(None, "one"), (900, "two three"), (901, "two\nthree")]
    assert run(frame(spark, rows)) == brute(rows)


def test_documents(spark):
    t = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"])
    want = brute(list(zip(*t.to_pydict().values())))
    assert run(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")) == want


def test_blocks_and_skew(spark, monkeypatch):
    base = " ".join(f"w{i}" for i in range(120))
    rows = [(i, base + f" v{i} v{i}") for i in range(130)] + [(1000 + i, base) for i in range(70)] + awkward()
    want = brute(rows)
    monkeypatch.setattr(near, "BLOCK", 16)
    assert run(frame(spark, rows)) == want


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000, i) for i in range(1001, 1300)] + [(i, i + 1) for i in range(2000, 2060)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent = {x: x for e in edges for x in e}
    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    alone = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in parent if x not in alone}


def test_empty_tables(spark):
    docs = frame(spark, awkward())
    assert near.near_duplicates(docs.where(F.lit(False))).count() == 0
    none = near.near_duplicates(docs.where("text is null or text = ''")).collect()
    assert {(r.class_id == r.doc_id, r.n_links) for r in none if r.doc_id} == {(True, 0)}


def test_forest_and_links():
    sets = [np.arange(10), np.arange(11), np.arange(100, 110), np.arange(100, 111)]
    similar = near.linked(sets, np.zeros(4), True)
    assert similar.sum() == 4 and sorted(near.forest(similar)) == [(0, 1), (2, 3)]
    assert not near.linked(sets, np.zeros(4), False).any()
