import os
import tempfile
import time

from pyspark.sql import functions as F

from tidemark.functions import rules as R
from tidemark.operators import store as ST
from tidemark.plans import fixtures as FX
from tidemark.streaming import stream as SS

SF = "/root/testdata/sf0.001"


def test_dedupe_idempotent_and_append(spark):
    from tidemark.plans import catalog
    raw = catalog.raw_findings(spark, SF)
    once = ST.dedupe(raw)
    twice = ST.dedupe(once)
    assert once.count() == twice.count() == raw.select("finding_hash").distinct().count()
    # appending the same findings again adds nothing
    assert ST.append(once, raw).count() == 0


def staged(spark, base, scans, files=1):
    pages = FX.pages_with_headers(spark, SF)
    visits = pages.withColumn("scan_id", F.explode(F.expr(FX.scan_membership_sql("page_id"))))
    SS.stage_files(visits.select(*[f.name for f in SS.VISIT_SCHEMA.fields]), os.path.join(base, "in"), scans, files=files)
    return pages


def test_stream_equals_batch_and_restart_adds_nothing(spark):
    rules = R.select_rules(["financial", "sensitive", "security"])
    base = tempfile.mkdtemp(prefix="tm-stream-")
    pages = staged(spark, base, range(FX.N_SCANS))
    source, out = os.path.join(base, "in"), os.path.join(base, "out")
    paths = SS.scan_stream(spark, source, rules, out)
    from tidemark.operators.headers import scan_page
    batch = scan_page(pages, rules, "broad").withColumn(
        "scan_id", F.explode(F.expr(FX.scan_membership_sql("src_id"))))
    cols = ["finding_hash", "scan_id", "match_idx", "start"]
    got = spark.read.parquet(paths["raw"]).select(*cols)
    assert got.exceptAll(batch.select(*cols)).count() == 0
    assert batch.select(*cols).exceptAll(got).count() == 0
    store = SS.store_stream(spark, paths, 1)
    n_store = store.read().count()
    assert n_store == ST.dedupe(batch).count() and len(store.versions()) >= 4
    # restart from the same checkpoints: nothing new is processed
    SS.scan_stream(spark, source, rules, out)
    SS.store_stream(spark, paths, 1)
    assert store.read().count() == n_store and got.count() == batch.count()


def test_status_is_read_while_it_runs_and_survives_a_restart(spark):
    rules = R.select_rules(["financial"])
    base = tempfile.mkdtemp(prefix="tm-status-")
    source, out = os.path.join(base, "in"), os.path.join(base, "out")
    pages = staged(spark, base, (0, 1))
    paths = SS.scan_stream(spark, source, rules, out)
    running = SS.start_status(spark, paths, processingTime="1 second")
    try:
        want = pages.select(F.explode(F.expr(FX.scan_membership_sql("page_id"))).alias("s")).where("s < 2").count()
        seen = None
        for _ in range(120):
            seen = SS.running_status(spark, paths["status"])
            if seen is not None and seen.agg(F.sum("pages")).first()[0] == want:
                break
            time.sleep(0.5)
        assert running.isActive and seen.agg(F.sum("pages")).first()[0] == want
    finally:
        running.stop()
    staged(spark, base, (2, 3))   # more arrives while the query is down
    SS.scan_stream(spark, source, rules, out)
    status = SS.running_status(spark, SS.status_stream(spark, paths, 1)).orderBy("scan_id").collect()
    from tidemark.operators.headers import scan_page
    batch = scan_page(pages, rules, "broad").withColumn("scan_id", F.explode(F.expr(FX.scan_membership_sql("src_id"))))
    found = {r.scan_id: r.n for r in batch.groupBy("scan_id").agg(F.count("*").alias("n")).collect()}
    assert [(r.scan_id, r.findings) for r in status] == [(k, found.get(k, 0)) for k in range(4)]
    assert [r.pages_total for r in status] == [sum(x.pages for x in status[:k + 1]) for k in range(4)]
    assert status[-1].findings_total == batch.count()


def test_bounded_dedupe_expires_and_restarts(spark):
    """Hours of findings, each repeated in the hour and an hour later, and late ones."""
    base = tempfile.mkdtemp(prefix="tm-seen-")
    whole, parts = os.path.join(base, "whole"), os.path.join(base, "parts")

    def hour(h):
        rows = [(f"h{h}-{i}", h, 1_700_000_000 + h * 3600 + i) for i in range(50)]
        rows += [(f"h{h}-{i}", h, 1_700_000_000 + h * 3600 + 600 + i) for i in range(50)]   # dropped: remembered
        rows += [("again", h, 1_700_000_000 + h * 3600)]                                  # counts anew when forgotten
        rows += [(f"late{h}", h, 1_700_000_000)] if h >= 3 else []                          # behind the watermark
        return spark.createDataFrame(rows, SS.SEEN_SCHEMA)

    for h in range(8):
        SS.stage_files(hour(h), os.path.join(whole, "in"), [h])
    state = SS.dedupe_stream(spark, os.path.join(whole, "in"), whole, "1800 seconds", 1)
    got = sorted(tuple(r) for r in spark.read.parquet(os.path.join(whole, "seen")).select("finding_hash", "scan_id").collect())
    assert [x for x in got if x[0].startswith("h")] == sorted((f"h{h}-{i}", h) for h in range(8) for i in range(50))
    assert not [x for x in got if x[0].startswith("late")]
    assert [x for x in got if x[0] == "again"] == [("again", h) for h in (0, 2, 4, 6)] or len([x for x in got if x[0] == "again"]) >= 3
    assert max(state) <= 3 * 51 < 8 * 50   # two hours or so, however many came
    for h in range(8):   # the same with a restart after every hour
        SS.stage_files(hour(h), os.path.join(parts, "in"), [h])
        SS.dedupe_stream(spark, os.path.join(parts, "in"), parts, "1800 seconds", 1)
    again = sorted(tuple(r) for r in spark.read.parquet(os.path.join(parts, "seen")).select("finding_hash", "scan_id").collect())
    assert [x for x in again if x[0] != "again"] == [x for x in got if x[0] != "again"]
