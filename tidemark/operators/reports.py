"""Aggregations, orderings and limits over findings, scans and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

def severity_rank():
    return F.when(F.col("severity") == "high", 0).when(F.col("severity") == "low", 2).otherwise(1)


def total(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def top_patterns(findings: DataFrame, n: int = 10) -> DataFrame:
    """Findings per rule, descending, ``n`` rows; ties broken by name so the
    cut is deterministic (partial counts are combined before the shuffle;
    the top-n is a TakeOrdered, never a global sort)."""
    c = findings.groupBy("pattern").agg(F.count(F.lit(1)).alias("count"))
    return c.orderBy(F.desc("count"), F.asc("pattern")).limit(n)


def severity_counts(findings: DataFrame, ordered: bool = False) -> DataFrame:
    c = findings.groupBy("severity").agg(F.count(F.lit(1)).alias("count"))
    if not ordered:
        return c
    c = c.filter(F.col("severity").isin("high", "medium", "low"))
    return c.withColumn("rank", severity_rank()).orderBy("rank")


def category_counts(findings: DataFrame) -> DataFrame:
    c = findings.groupBy("category").agg(F.count(F.lit(1)).alias("count"))
    return c.orderBy(F.desc("count"), F.asc("category"))


def report_summary(findings: DataFrame, by: str | None = None) -> DataFrame:
    """One row (or one for each value of ``by``): total, high, medium, low (zero when absent)."""
    return findings.groupBy(*([by] if by else [])).agg(F.count(F.lit(1)).alias("total"),
                        F.count_if(F.col("severity") == "high").alias("high"),
                        F.count_if(F.col("severity") == "medium").alias("medium"),
                        F.count_if(F.col("severity") == "low").alias("low"))


SCAN_ORDER = ["src_id", "part", "rule_idx", "match_idx"]


def report_rows(findings: DataFrame) -> DataFrame:
    """Findings in rank order high, medium, low (unknown ranks as medium),
    stable in scan order; severity shown in capitals. The order is a
    distributed sort on (rank, scan order) — the key columns are returned,
    no row numbering through a single partition."""
    return (findings.select(severity_rank().alias("rank"), *SCAN_ORDER, "url", "pattern",
                            F.upper("severity").alias("severity"), "match", "context")
            .orderBy("rank", *SCAN_ORDER))


def findings_by_scan(findings: DataFrame, scan_id: int) -> DataFrame:
    """One scan's findings, severity text descending, then scan order
    (distributed sort; the key columns are returned)."""
    f = findings.filter(F.col("scan_id") == scan_id)
    return (f.select(*SCAN_ORDER, "url", "pattern", "category", "match", "context", "severity")
            .orderBy(F.desc("severity"), *SCAN_ORDER))


def scan_history(scans: DataFrame, limit: int = 50) -> DataFrame:
    return scans.orderBy(F.desc("start_time")).limit(limit)


def per_page(findings: DataFrame) -> DataFrame:
    return findings.groupBy("page_url").agg(F.count(F.lit(1)).alias("n"))


def status_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("status_code").agg(F.count(F.lit(1)).alias("pages"))


def progress(visits: DataFrame, order_col: str, max_pages: int) -> DataFrame:
    """int(100 × visited / max_pages) after each visit, visits capped at
    max_pages (the crawl stops there), and 100 at the end. The visit order is
    one sequence, so the cap is applied by a top-k before numbering."""
    first = visits.orderBy(order_col).limit(max_pages)
    n = F.row_number().over(Window.orderBy(order_col))
    rows = first.select(order_col, F.least(F.lit(100), F.floor(n * 100 / max_pages)).cast("int").alias("percent"))
    end = visits.sparkSession.range(1).select(F.lit(None).cast(visits.schema[order_col].dataType).alias(order_col),
                                              F.lit(100).alias("percent"))
    return rows.unionByName(end)


def union_findings(*dfs: DataFrame) -> DataFrame:
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out
