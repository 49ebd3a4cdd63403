import os
import tempfile
import threading
from collections import Counter

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tidemark.operators import findings_store as FS

COLUMNS = "finding_hash string, scan_id long, src_id long, part string, rule_idx int, match_idx int, pattern string, category string, severity string, match string, context string"


def findings(spark, scan, numbers):
    rows = [(f"{n:032x}", scan, n, "body", n % 5, 0, f"rule {n % 5}", "kit", ("low", "high")[n % 2], "m", "c") for n in numbers]
    return spark.createDataFrame(rows, COLUMNS)


def new_store(spark, buckets=4):
    return FS.FindingsStore(spark, os.path.join(tempfile.mkdtemp(prefix="tm-store-"), "store"), buckets)


def hashes(df):
    return Counter((int(r.finding_hash, 16), r.scan_id) for r in df.collect())


def recount(store):
    return {(r.pattern, r.severity): r["count"] for r in store.read().groupBy("pattern", "severity").agg(F.count("*").alias("count")).collect()}


def counted(store):
    return {(r.pattern, r.severity): r["count"] for r in store.statistics(["pattern", "severity"]).collect()}


def test_two_appends_from_one_version(spark):
    store = new_store(spark)
    store.append(findings(spark, 0, range(20)))
    first, second = store.begin(findings(spark, 1, range(10, 40))), store.begin(findings(spark, 2, range(30, 60)))
    before = store.read()
    assert second.commit() == 2 and first.commit() == 3   # the second one got in first; the first saw it and tried again
    got = hashes(store.read())
    assert set(got.values()) == {1} and {n for n, _ in got} == set(range(60))
    assert {n for n, s in got if s == 2} == set(range(30, 60)) and {n for n, s in got if s == 1} == set(range(20, 30))
    assert {n for n, _ in hashes(before)} == set(range(20))                    # a reader keeps its version
    assert {n for n, _ in hashes(store.read(2))} == set(range(20)) | set(range(30, 60))
    assert counted(store) == recount(store)


def test_threads_lose_nothing(spark):
    store, errors = new_store(spark), []

    def write(k):
        try:
            FS.FindingsStore(spark, store.path, 4).append(findings(spark, k, range(k * 5, k * 5 + 12)))
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(5)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    got = hashes(store.read())
    assert not errors and store.versions() == [1, 2, 3, 4, 5]
    assert {n for n, _ in got} == set(range(32)) and set(got.values()) == {1} and counted(store) == recount(store)


def test_withdraw_compact_and_find_again(spark):
    store = new_store(spark)
    store.append(findings(spark, 0, range(30)))
    store.append(findings(spark, 1, range(20, 50)))
    gone = spark.createDataFrame([(f"{n:032x}",) for n in (*range(5), *range(40, 45), 999)], "finding_hash string")
    pending = store.begin(findings(spark, 2, [3, 4, 60]))   # begun while 3 and 4 were there
    store.withdraw(gone)
    left = set(range(5, 40)) | set(range(45, 50))
    assert {n for n, _ in hashes(store.read())} == left and counted(store) == recount(store)
    pending.commit()
    left |= {3, 4, 60}
    assert {n for n, _ in hashes(store.read())} == left and counted(store) == recount(store)
    again = store.append(findings(spark, 3, [0, 1, 10]))
    left |= {0, 1}
    assert {n for n, _ in hashes(store.read())} == left and counted(store) == recount(store)
    whole, numbers = hashes(store.read()), counted(store)
    store.compact()
    assert hashes(store.read()) == whole and counted(store) == numbers
    assert len(store.version().data) == len(store.version().deltas) == 1 and not store.version().gone
    assert hashes(store.read(again)) == whole                                  # the old version is still there
    store.append(findings(spark, 4, [2, 3]))
    assert {n for n, _ in hashes(store.read())} == left | {2} and counted(store) == recount(store)


def test_compaction_sets_in(spark, monkeypatch):
    monkeypatch.setattr(FS, "COMPACT_AT", 3)
    store = new_store(spark)
    for k in range(7):
        store.append(findings(spark, k, range(k, k + 4)))
        assert len(store.version().data) < 3
    assert {n for n, _ in hashes(store.read())} == set(range(10)) and counted(store) == recount(store)


def test_a_streams_batch_counts_once(spark):
    store = new_store(spark)
    store.append(findings(spark, 0, range(5)), "s", 0)
    store.append(findings(spark, 1, range(9)), "s", 1)
    at = store.version().number
    store.append(findings(spark, 2, range(20)), "s", 1)   # replayed, with other rows even
    assert store.version().number == at and len(hashes(store.read())) == 9


def test_no_shuffle_below_the_joins(spark):
    store = new_store(spark)
    store.append(findings(spark, 0, range(50)))
    store.append(findings(spark, 1, range(40, 70)))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        mine = store.begin(findings(spark, 2, range(60, 90))).mine
        plan = mine._jdf.queryExecution().executedPlan().toString()
        assert "LeftAnti" in plan and "Exchange" not in plan and {n for n, _ in hashes(mine)} == set(range(70, 90))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_refusals_and_empty_appends(spark):
    store = new_store(spark)
    with pytest.raises(AnalysisException):
        store.read()
    store.append(findings(spark, 0, range(3)).where("false"))
    assert store.read().count() == 0
    store.append(findings(spark, 0, range(3)))
    with pytest.raises(AnalysisException):
        store.append(findings(spark, 0, range(3)).drop("category"))
    assert store.read().count() == 3
