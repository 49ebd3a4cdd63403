"""Sources: stored tables → the shapes the scan expects."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


#: bytes of text that a task of a scan takes (its findings are many times as long)
SPREAD_BYTES = 4 << 20


def text_bytes(df: DataFrame) -> int:
    """UTF-8 bytes in the string columns: one narrow pass. File sizes do not tell
    them, as repeated texts lie in a file once."""
    texts = [c for c, t in df.dtypes if t == "string"]
    if not texts:
        return 0
    return df.agg(F.sum(sum(F.coalesce(F.octet_length(c), F.lit(0)).cast("long") for c in texts)).alias("n")).first()["n"] or 0


def parts_for(spark: SparkSession, size: int) -> int:
    """Tasks for ``size`` bytes of text: one a core at least."""
    return max(spark.sparkContext.defaultParallelism, -(-size // SPREAD_BYTES))


def spread(df: DataFrame, size: int | None = None) -> DataFrame:
    """Deal a scan's input into tasks of SPREAD_BYTES of text, one a core at least.

    A file of one row group is one task whatever the split size, and a split
    of 128 MB keeps one core with the rules for minutes. The text is moved once; rows are dealt by
    a hash of what they hold, so that no task sorts them and a task that runs
    again deals them alike.
    """
    keys = [c for c, t in df.dtypes if "map<" not in t]
    return df.repartition(parts_for(df.sparkSession, text_bytes(df) if size is None else size), F.xxhash64(*keys))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def read_pages(spark: SparkSession, sf_dir: str, profile: str = "broad") -> DataFrame:
    """Stored pages → Page schema.

    ``page_id, url, body, headers MAP<STRING,STRING>, status_code, depth,
    from_js``. Bodies are whole in both profiles; the broad one drops empty
    bodies (the broad tool skips a page whose text is empty).
    """
    return page_columns(read_table(spark, sf_dir, "pages"), profile)


def page_columns(pages: DataFrame, profile: str = "broad") -> DataFrame:
    """(page_id, url, html) → Page schema."""
    out = pages.select("page_id", "url", F.col("html").alias("body"))
    if profile == "broad":
        out = out.filter(F.col("body").isNotNull() & (F.length("body") > 0))
    return out.select("page_id", "url", "body", F.lit(None).cast("map<string,string>").alias("headers"),
                      F.lit(200).alias("status_code"), F.lit(0).alias("depth"), F.lit(False).alias("from_js"))


def first_headers(header_rows: DataFrame) -> DataFrame:
    """Multi-valued header rows (page_id, name, seq, value) → the first value
    per name, as one map per page (one shuffle, on page_id; a page holds a
    bounded number of header rows)."""
    first = ("element_at(transform(array(array_sort(collect_list(struct(name, seq, value)))), "
             "rows -> map_from_entries(transform(filter(rows, (x, i) -> i = 0 OR "
             "rows[greatest(i - 1, 0)].name != x.name), x -> struct(x.name, x.value)))), 1)")
    return header_rows.groupBy("page_id").agg(F.expr(first).alias("headers"))


def header_text(headers: Column, profile: str = "broad") -> Column:
    """Header map → ``name: value`` lines sorted by name.

    The strict tool ends every line with a newline; the broad one joins
    lines with newlines. Both originals follow map order; names are sorted
    here so the text is deterministic.
    """
    lines = F.transform(F.array_sort(F.map_entries(headers)),
                        lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    if profile == "strict":
        return F.when(F.size(lines) > 0,
                      F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise(F.lit(""))
    return F.array_join(lines, "\n")


# --- bucketed folders ----------------------------------------------------------

def write_buckets(df: DataFrame, key: str, buckets: int, folder: str, dealt: bool = False) -> None:
    """Write a folder of Parquet files bucketed by ``key``. ``dealt``: df is
    partitioned by the same buckets already (a join of bucketed tables is)."""
    name = f"tm_write_{uuid.uuid4().hex}"
    rows = df if dealt else df.repartition(buckets, key)
    rows.write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", folder).saveAsTable(name)
    df.sparkSession.sql(f"DROP TABLE {name}")   # the files stay


def bucket_table(spark: SparkSession, path: str, columns: str, key: str, buckets: int, folders=None) -> DataFrame:
    """A bucketed table over ``path``, or over those of its ``folder=`` parts
    that are named: joins on ``key`` with one of as many buckets need no shuffle."""
    name = f"tm_read_{uuid.uuid4().hex}"
    parts = "" if folders is None else "PARTITIONED BY (folder)"
    columns = columns if folders is None else f"{columns}, folder STRING"
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet {parts} CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS "
              f"LOCATION '{path}'")
    if folders:
        spark.sql(f"ALTER TABLE {name} ADD " + " ".join(f"PARTITION (folder='{f}')" for f in folders))
    return spark.table(name)
