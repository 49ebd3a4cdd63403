"""Findings store: scan tagging, first-wins dedup, append, scan log, page log.

Dedup keeps row number 1 per hash: Spark prunes such a window to one row per
hash in every task before the shuffle, so a hash repeated millions of times
(the same match many times on one page) sends one row a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDER_COLS = ["scan_id", "src_id", "part", "rule_idx", "match_idx"]
STORED_MATCH = 500     # the store keeps at most 500 characters of a match
STORED_CONTEXT = 1000  # and 1000 of its context


def finding_hash(url: Column, pattern: Column, match: Column) -> Column:
    """MD5 of url + rule + match text (already cut to 200), no separators."""
    return F.md5(F.concat(url, pattern, match))


def first_wins(findings: DataFrame, key: str = "finding_hash", order=ORDER_COLS) -> DataFrame:
    """One row per ``key``: the first by ``order``."""
    ranked = findings.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.filter("_rn = 1").drop("_rn")


def to_store_rows(findings: DataFrame) -> DataFrame:
    """Stored form: match ≤500 and context ≤1000 characters."""
    return (findings.withColumn("match", F.substring("match", 1, STORED_MATCH))
            .withColumn("context", F.substring("context", 1, STORED_CONTEXT)))


def dedupe(findings: DataFrame) -> DataFrame:
    """First finding per hash wins over the whole store."""
    return first_wins(to_store_rows(findings))


def append(store: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` to append: first per hash inside the batch, and none
    whose hash the store already holds (left anti join on the hash)."""
    batch = first_wins(to_store_rows(new))
    return batch.join(store.select("finding_hash"), "finding_hash", "left_anti")


def scan_log_current(log: DataFrame) -> DataFrame:
    """Append-only scan log → the current row per scan (latest event)."""
    cols = [c for c in log.columns if c not in ("scan_id", "event_no")]
    cur = log.groupBy("scan_id").agg(F.max_by(F.struct(*cols), "event_no").alias("_r"))
    return cur.select("scan_id", *[F.col(f"_r.{c}").alias(c) for c in cols])


def summary(pages_per_scan: DataFrame, raw: DataFrame, stored: DataFrame) -> DataFrame:
    """Per scan: pages visited, findings before dedup, findings stored."""
    r = raw.groupBy("scan_id").agg(F.count(F.lit(1)).alias("findings_raw"))
    s = stored.groupBy("scan_id").agg(F.count(F.lit(1)).alias("findings_stored"))
    return (pages_per_scan.join(r, "scan_id", "left").join(s, "scan_id", "left")
            .select("scan_id", "pages_scanned",
                    F.coalesce("findings_raw", F.lit(0)).alias("findings_raw"),
                    F.coalesce("findings_stored", F.lit(0)).alias("findings_stored")))
