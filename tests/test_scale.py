"""What keeps tasks, kept tables and written files in proportion to the input."""
import os
import tempfile

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tidemark.functions.rules import select_rules
from tidemark.operators import headers as H
from tidemark.operators import scan as S
from tidemark.operators.findings_store import FindingsStore
from tidemark.plans import catalog
from tidemark.sources import sinks as SK
from tidemark.sources.tables import SPREAD_BYTES, spread
from tidemark.streaming import stream as SS

SF = "/root/testdata/sf0.001"


def test_spread_goes_by_the_text(spark):
    """A text that repeats lies in a file once: its size tells nothing of the work."""
    path = os.path.join(tempfile.mkdtemp(prefix="tm-scale-"), "t.parquet")
    rows = 3000
    (spark.range(rows).coalesce(1).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("page_id"), F.concat(F.lit("u"), F.col("id") % 900).alias("url"),
                                          F.repeat(F.lit("some text of 32 characters here "), 2048).alias("body")).write.parquet(path))
    out = spread(spark.read.parquet(path))
    sizes = [r["n"] for r in out.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == rows and out.agg(F.countDistinct("page_id")).first()[0] == rows // 2
    assert max(sizes) << 16 < 4 * SPREAD_BYTES


def test_kept_table_holds_no_findings(spark):
    kept = catalog.page_positions(spark, SF)
    assert kept.columns == ["src_id", "page_url", "_t", "_part", "_f"]
    whole = H.scan_page(catalog.pages_h(spark, SF), catalog.ALL, "broad").select(S.FINDING_COLUMNS)
    cut = catalog.page_findings(spark, SF).select(S.FINDING_COLUMNS)
    assert cut.count() == whole.count() > 0 and cut.exceptAll(whole).isEmpty()
    assert "Join" not in catalog.stored_findings(spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_findings_are_not_dealt_by_scan(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")   # as if ``events`` were large
    try:
        plan = catalog.report_findings(spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


@pytest.mark.parametrize("fmt", ["json", "csv", "html"])
def test_compressed_report(spark, fmt):
    rows = [(k % 2, "2026-01-01 00:00:00", f"http://a/{k}", "Cat", "Rule", "low", f' "m{k}" ', "c\nd <b>", k, "body", 0, 0) for k in range(40)]
    f = spark.createDataFrame(rows, "scan_id long, timestamp string, url string, category string, pattern string, severity string, match string, "
                                    "context string, src_id long, part string, rule_idx int, match_idx int")
    plain, packed = (SK.write(f, SK.scratch_path(spark, "t"), fmt, by="scan_id", compression=c) for c in (None, "gzip"))

    def back(path):
        df = SK.read_csv(spark, path) if fmt == "csv" else spark.read.text(path)
        return sorted(map(str, df.collect()))
    assert back(plain) == back(packed) and len(back(packed)) >= 40
    assert all(n.endswith(".gz") for n in spark.read.text(packed).inputFiles())


def test_store_keeps_its_buckets(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="tm-scale-"), "store")
    raw = catalog.raw_findings(spark, SF)
    FindingsStore(spark, path, 5).append(raw.filter("scan_id = 0"))
    late = FindingsStore(spark, path)
    assert late.buckets == late.version().buckets == 5
    late.append(raw.filter("scan_id = 1"))
    two = catalog.ST.dedupe(raw.filter("scan_id < 2"))
    assert late.read().count() == two.count()
    assert catalog.store_buckets(1) == 16 and catalog.store_buckets(3 << 30) >= 96


def test_first_commit_settles_the_buckets(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="tm-scale-"), "store")
    raw = catalog.raw_findings(spark, SF)
    one = FindingsStore(spark, path, 3).begin(raw.filter("scan_id = 0"))
    two = FindingsStore(spark, path, 4).begin(raw.filter("scan_id = 1"))
    one.commit()
    with pytest.raises(AnalysisException, match="3 buckets"):
        two.commit()


def test_stream_in_many_tasks(spark):
    """The files and tasks of a micro-batch change no finding."""
    base = os.path.join(tempfile.mkdtemp(prefix="tm-scale-"), "s")
    rules = select_rules(["cloud", "sensitive"])
    pages = catalog.FX.pages_with_headers(spark, SF).withColumn("scan_id", F.col("page_id") % 2)
    visits = pages.select(*[f.name for f in SS.VISIT_SCHEMA.fields])
    SS.stage_files(spread(visits), os.path.join(base, "in"), [0, 1], files=3)
    paths = SS.scan_stream(spark, os.path.join(base, "in"), rules, os.path.join(base, "out"), files_per_trigger=3, tasks=11)
    assert len([n for n in os.listdir(os.path.join(base, "in")) if n.endswith(".parquet")]) == 6
    cols = ["scan_id", "finding_hash", "start", "context"]
    found, batch = spark.read.parquet(paths["raw"]).select(cols), H.scan_page(visits, rules, carry=["scan_id"]).select(cols)
    assert found.count() == batch.count() and found.exceptAll(batch).isEmpty()
    assert catalog.stream_files(1) == catalog.STREAM_FILES and catalog.stream_files(3 << 30) == 256
