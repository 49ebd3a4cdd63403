"""The scan as Structured Streaming jobs, one query a sink.

``scan_stream`` scans page visits as they arrive with the same plan as the
batch path and writes findings to a file sink, whose log makes every
micro-batch count once whatever is restarted. The other queries read that
sink as a stream of their own, each with its checkpoint, so that a slow or
failed one holds up no other and the rules run once:

* ``store_stream`` appends unseen findings to the findings store;
* ``status_stream`` keeps pages and findings per scan as a streaming aggregate
  (``complete`` output: each trigger publishes all totals as a new version, and
  a reader takes the latest whole one while the query runs on);
* ``dedupe_stream`` drops repeats with state that expires: a hash is
  remembered until the watermark passes its event time by the delay;
* ``lines_stream`` emits findings as JSON lines.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.rules import Rule
from tidemark.operators.findings_store import FindingsStore
from tidemark.operators.headers import scan_page

VISIT_SCHEMA = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()),
    T.StructField("body", T.StringType()),
    T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
    T.StructField("status_code", T.IntegerType()), T.StructField("depth", T.IntegerType()),
    T.StructField("from_js", T.BooleanType()), T.StructField("scan_id", T.LongType()),
])
#: what ``dedupe_stream`` reads: a finding's identity, its scan, and the second it was seen at
SEEN_SCHEMA = "finding_hash string, scan_id long, visited long"


def stage_files(visits: DataFrame, folder: str, keys, split_col: str = "scan_id", files: int = 1) -> None:
    """Write the ``visits`` of each key as ``files`` files, in the order of
    ``keys`` (the file source reads files by modification time), so that a
    test stream with that many files a trigger has one micro-batch a key. Rows
    are dealt in turn, which sorts them in every task: large ``visits`` come spread."""
    for k in keys:
        visits.filter(F.col(split_col) == k).repartition(files).write.mode("append").parquet(folder)


def _read(spark: SparkSession, folder: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def _checkpointed(paths: dict, name: str) -> str:
    return os.path.join(paths["checkpoints"], name)


def layout(out: str) -> dict:
    return {k: os.path.join(out, k) for k in ("raw", "store", "status", "lines", "checkpoints")}


def scan_stream(spark: SparkSession, source: str, rules: list[Rule], out: str,
                profile: str = "broad", files_per_trigger: int | None = 1, tasks: int | None = None) -> dict:
    """Scan the visit files in ``source`` until they are all processed
    (``availableNow``); returns the layout of ``out``, with the findings'
    schema and the source for the queries that follow. ``tasks``: of a
    micro-batch, whose small files Spark would put together by their stored size."""
    paths = layout(out)
    visits = _read(spark, source, VISIT_SCHEMA, files_per_trigger)
    if tasks:
        visits = visits.repartition(tasks, F.xxhash64("scan_id", "page_id", "url", "body"))
    found = scan_page(visits, rules, profile, carry=["scan_id"])
    q = (found.writeStream.format("parquet").option("path", paths["raw"])
         .option("checkpointLocation", _checkpointed(paths, "raw")).trigger(availableNow=True).start())
    q.awaitTermination()
    return paths | {"schema": found.schema, "source": source}


# --- the findings store -------------------------------------------------------

def store_stream(spark: SparkSession, paths: dict, files_per_trigger: int | None = None, buckets: int = 16) -> FindingsStore:
    """Append the findings of the raw sink to the store, first one a hash. The
    store knows each stream's last batch, so a replayed one adds nothing."""
    def merge(batch: DataFrame, batch_id: int) -> None:
        FindingsStore(batch.sparkSession, paths["store"], buckets).append(batch, stream=paths["raw"], batch=batch_id)

    q = (_read(spark, paths["raw"], paths["schema"], files_per_trigger).writeStream.foreachBatch(merge)
         .option("checkpointLocation", _checkpointed(paths, "store")).trigger(availableNow=True).start())
    q.awaitTermination()
    return FindingsStore(spark, paths["store"], buckets)


# --- status -------------------------------------------------------------------

def _publish(path: str):
    def publish(totals: DataFrame, batch_id: int) -> None:
        totals.withColumn("version", F.lit(batch_id)).write.mode("overwrite").parquet(os.path.join(path, f"v{batch_id:012d}"))
    return publish


def start_status(spark: SparkSession, paths: dict, files_per_trigger: int | None = None, **trigger) -> StreamingQuery:
    """Start the status query: pages and findings per scan, counted in the
    state store, published whole at every trigger."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    visits = _read(spark, paths["source"], VISIT_SCHEMA, files_per_trigger).select("scan_id", one.alias("pages"), none.alias("findings"))
    found = _read(spark, paths["raw"], paths["schema"], files_per_trigger).select("scan_id", none.alias("pages"), one.alias("findings"))
    totals = visits.unionByName(found).groupBy("scan_id").agg(F.sum("pages").alias("pages"), F.sum("findings").alias("findings"))
    return (totals.writeStream.outputMode("complete").foreachBatch(_publish(paths["status"]))
            .option("checkpointLocation", _checkpointed(paths, "status")).trigger(**(trigger or {"availableNow": True})).start())


def status_stream(spark: SparkSession, paths: dict, files_per_trigger: int | None = None) -> str:
    start_status(spark, paths, files_per_trigger).awaitTermination()
    return paths["status"]


def _children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder that a job has finished writing."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
    return sorted(n for n in names if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))


def running_status(spark: SparkSession, status_path: str) -> DataFrame | None:
    """The latest totals that the status query has published, scan by scan with
    totals so far; None before the first."""
    versions = _children(spark, status_path)
    if not versions:
        return None
    latest = spark.read.parquet(os.path.join(status_path, versions[-1]))
    upto = Window.orderBy("scan_id")   # a row a scan
    return latest.select("scan_id", "pages", "findings", F.sum("pages").over(upto).alias("pages_total"),
                         F.sum("findings").over(upto).alias("findings_total"))


# --- dedupe with state that expires ---------------------------------------------

def deduped(seen: DataFrame, delay: str) -> DataFrame:
    """First of each hash; a repeat within ``delay`` of it is dropped, and so is
    what comes later than the watermark, ``delay`` behind the latest event."""
    timed = seen.withColumn("ts", F.timestamp_seconds("visited")).withWatermark("ts", delay)
    return timed.dropDuplicatesWithinWatermark(["finding_hash"]).drop("ts")


def dedupe_stream(spark: SparkSession, source: str, out: str, delay: str, files_per_trigger: int | None = None) -> list[int]:
    """Dedupe the findings files of ``source`` into ``out``; returns the number
    of hashes remembered after each micro-batch."""
    q = (deduped(_read(spark, source, SEEN_SCHEMA, files_per_trigger), delay).writeStream.format("parquet")
         .option("path", os.path.join(out, "seen")).option("checkpointLocation", os.path.join(out, "checkpoint"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return [p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators]


# --- lines and summary ------------------------------------------------------------

def lines_stream(spark: SparkSession, paths: dict) -> str:
    """The ``stream`` output format: findings as JSON lines, as they come."""
    q = (_read(spark, paths["raw"], paths["schema"]).writeStream.format("json").option("path", paths["lines"])
         .option("checkpointLocation", _checkpointed(paths, "lines")).trigger(availableNow=True).start())
    q.awaitTermination()
    return paths["lines"]


def summary(spark: SparkSession, paths: dict) -> DataFrame:
    """Summary only: totals of the latest status and of the store (two one-row
    aggregates put side by side)."""
    status = running_status(spark, paths["status"]).agg(F.sum("pages").alias("pages_total"), F.sum("findings").alias("findings_raw"))
    stored = FindingsStore(spark, paths["store"]).read().agg(F.count(F.lit(1)).alias("findings_stored"))
    key = F.lit(1).alias("_one")
    return status.select(key, "*").join(stored.select(key, "*"), "_one").drop("_one")
