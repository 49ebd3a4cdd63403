"""Sinks: CSV, JSON lines, HTML report, statistics page, parquet tables.

Everything is written by Spark tasks; HTML rows are built as columns and
written as text after ordering, so no result passes through the driver.
Output folders default to a fresh folder under the session's
``spark.checkpoint.dir`` (the shared folder on a cluster).
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import ensure_checkpoint_dir

FORMATS = ("stream", "json", "csv", "html")
CSV_FIELDS = ["timestamp", "url", "category", "pattern", "severity", "match", "context"]


def scratch_path(spark: SparkSession, name: str) -> str:
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "tidemark-out", f"{name}-{uuid.uuid4().hex[:12]}")


def check_format(fmt: str) -> str:
    """Only stream, json, csv and html are accepted."""
    if fmt not in FORMATS:
        raise ValueError(f"invalid format {fmt!r}: must be one of {', '.join(FORMATS)}")
    return fmt


def _parts(df: DataFrame, by: str | None, compression: str | None = None):
    """A writer into one folder, or into one for each value of ``by``."""
    writer = df.write.mode("overwrite")
    if compression:
        writer = writer.option("compression", compression)
    return writer.partitionBy(by) if by else writer


def write_csv(findings: DataFrame, path: str, by: str | None = None, compression: str | None = None) -> str:
    """The seven report fields with a header line; ``by`` (scan_id): a report a scan."""
    # the writer trims values by default; a match may start or end with spaces
    (_parts(findings.select(*CSV_FIELDS, *([by] if by else [])), by, compression)
     .option("header", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return path


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.option("header", True).option("escape", '"')
            .option("multiLine", True).csv(path))


def write_json(findings: DataFrame, path: str, compression: str | None = None) -> str:
    """All fields, JSON lines."""
    _parts(findings, None, compression).json(path)
    return path


def html_escape(c: Column) -> Column:
    """&, <, >, double and single quotes → entities (ampersand first)."""
    out = F.replace(c, F.lit("&"), F.lit("&amp;"))
    for ch, ent in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(ch), F.lit(ent))
    return out


def html_row(findings: DataFrame) -> Column:
    """One table row of the report: url ≤100, match ≤100, context ≤200,
    severity in capitals, all escaped."""
    sev = F.coalesce(F.col("severity"), F.lit("medium"))
    return F.concat(
        F.lit("<tr class=\"severity-"), html_escape(sev), F.lit("\"><td>"),
        html_escape(F.upper(sev)), F.lit("</td><td>"), html_escape(F.col("pattern")),
        F.lit("</td><td>"), html_escape(F.coalesce(F.col("category"), F.lit(""))),
        F.lit("</td><td>"), html_escape(F.substring("url", 1, 100)),
        F.lit("</td><td><code>"), html_escape(F.substring("match", 1, 100)),
        F.lit("</code></td><td>"), html_escape(F.substring("context", 1, 200)),
        F.lit("</td></tr>"))


def write_html(findings: DataFrame, path: str, by: str | None = None, compression: str | None = None) -> str:
    """Report: summary counts, then one row per finding in rank order
    (high, medium, low; unknown = medium), then the closing tags; ``by``
    (scan_id): a report for each scan, in a folder of its own.

    The lines are range-sorted and written without collapsing to one task:
    the part files, read in name order, are the report."""
    from tidemark.operators.reports import report_summary, severity_rank
    order = [c for c in ("src_id", "part", "rule_idx", "match_idx") if c in findings.columns]
    types = dict(findings.dtypes)

    def nulls():
        return F.struct(*[F.lit(None).cast(types[c]).alias(c) for c in order])
    keys = [by] if by else []
    summaries = report_summary(findings, by)
    head = summaries.select(*keys, F.concat(
        F.lit("<html><head><meta charset=\"utf-8\"><title>Scan report</title></head><body>"
              "<h1>Scan report</h1><p>Total: "), F.col("total").cast("string"),
        F.lit(" High: "), F.col("high").cast("string"), F.lit(" Medium: "), F.col("medium").cast("string"),
        F.lit(" Low: "), F.col("low").cast("string"),
        F.lit("</p><table><tr><th>Severity</th><th>Pattern</th><th>Category</th><th>URL</th>"
              "<th>Match</th><th>Context</th></tr>")).alias("line"), F.lit(0).alias("_k0"),
        F.lit(0).alias("_rank"), nulls().alias("_o"))
    rows = findings.select(*keys, html_row(findings).alias("line"), F.lit(1).alias("_k0"),
                           severity_rank().alias("_rank"), F.struct(*order).alias("_o"))
    tail = summaries.select(*keys, F.lit("</table></body></html>").alias("line"), F.lit(2).alias("_k0"),
                            F.lit(0).alias("_rank"), nulls().alias("_o"))
    lines = head.unionByName(rows).unionByName(tail).orderBy(*keys, "_k0", "_rank", "_o")
    _parts(lines.select("line", *keys), by, compression).text(path)
    return path


def write_tables(tables: dict[str, DataFrame], path: str) -> dict[str, str]:
    """Store tables as parquet; findings and pages partitioned by scan."""
    out = {}
    for name, df in tables.items():
        p = os.path.join(path, name)
        w = df.write.mode("overwrite")
        if "scan_id" in df.columns and name in ("findings", "pages"):
            w = w.partitionBy("scan_id")
        w.parquet(p)
        out[name] = p
    return out


def write(findings: DataFrame, path: str, fmt: str, by: str | None = None, compression: str | None = None) -> str:
    """``compression`` (gzip, ...): Spark reads such files back as they are; contexts that overlap
    make a report many times as long as what it holds."""
    check_format(fmt)
    if fmt == "csv":
        return write_csv(findings, path, by, compression)
    if fmt in ("json", "stream"):
        return write_json(findings, path, compression)
    return write_html(findings, path, by, compression)


def roundtrip_tables(spark: SparkSession, sf_dir: str, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a store table and read it back (source of the
    history views)."""
    base = scratch_path(spark, "store")
    paths = write_tables({name: df}, base)
    back = spark.read.parquet(paths[name])
    # partition columns come back with inferred types; restore the written ones
    return back.select(*[F.col(c).cast(t).alias(c) for c, t in df.dtypes])


def write_statistics(totals: dict[str, DataFrame], categories: DataFrame, severities: DataFrame,
                     top_current: DataFrame, top_history: DataFrame, path: str) -> str:
    """Statistics page: totals, findings by category, severity counts (high,
    medium, low), top rules of the current scan and of the store."""
    def table(df: DataFrame, k: int, title: str, key: str, val: str, cls: bool = False) -> DataFrame:
        cell = (F.concat(F.lit("<td class='severity-"), html_escape(F.col(key)), F.lit("'>"),
                         html_escape(F.upper(F.col(key))), F.lit("</td>")) if cls
                else F.concat(F.lit("<td>"), html_escape(F.col(key).cast("string")), F.lit("</td>")))
        rows = df.select(F.concat(F.lit("<tr>"), cell, F.lit("<td>"), F.col(val).cast("string"),
                                  F.lit("</td></tr>")).alias("line"), F.lit(k).alias("_k"),
                         F.row_number().over(Window.orderBy(F.desc(val), F.col(key))).alias("_o"))
        head = df.sparkSession.range(1).select(
            F.lit(f"<h3>{title}</h3><table>").alias("line"), F.lit(k).alias("_k"), F.lit(0).alias("_o"))
        tail = df.sparkSession.range(1).select(
            F.lit("</table>").alias("line"), F.lit(k).alias("_k"), F.lit(1 << 30).alias("_o"))
        return head.unionByName(rows).unionByName(tail)

    from pyspark.sql import Window
    parts = []
    for i, (name, df) in enumerate(totals.items()):
        parts.append(df.select(F.concat(F.lit(f"<p>{name}: <b>"), F.col(name).cast("string"), F.lit("</b></p>")).alias("line"),
                               F.lit(i).alias("_k"), F.lit(0).alias("_o")))
    parts.append(table(categories, 10, "Findings by Category", "category", "count"))
    parts.append(table(severities.drop("rank"), 11, "Severity Distribution", "severity", "count", cls=True))
    parts.append(table(top_current, 12, "Top Patterns Found", "pattern", "count"))
    parts.append(table(top_history, 13, "Historical Top Patterns", "pattern", "count"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    (out.orderBy("_k", "_o").select("line").coalesce(1).write.mode("overwrite").text(path))
    return path
