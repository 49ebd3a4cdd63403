"""Breadth-first reachability over stored pages and a link table.

The original fetches one URL at a time from a FIFO queue. Here a level of
the breadth-first search is three joins, however deep the search is: the
fetched pages of the frontier with the edge table, the targets less every URL
visited so far (anti join), and with the stored pages; one row per target
keeping the least key. A URL's key is the path of link positions that first
reaches it, level by level, so keys order a level as the queue would and need no
numbering between levels. A page cap is a top-k per level.

Edges, stored pages and visited URLs lie in the session's shared folder in the
same number of buckets by URL. Each level is a folder of the visited table, so
visited URLs are written once and never moved again, and the joins shuffle
candidates only. What is written cuts lineage and survives lost executors.

Reached URLs without a stored page use up the cap but yield no links, as a
failed fetch does in the original.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import ensure_checkpoint_dir
from tidemark.sources.tables import bucket_table, write_buckets

#: buckets of the crawl's tables
BUCKETS = 16
VISITED = "url STRING, key ARRAY<INT>, depth INT, fetched BOOLEAN"


def _written(df: DataFrame) -> DataFrame:
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/tidemark-crawl-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds 1, 2, 3, ... in the given order: a range-partitioned sort, the
    place inside the partition, and the counts of the partitions before."""
    placed = _written(df.orderBy(*order).withColumn("_p", F.spark_partition_id())
                      .withColumn("_i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_b", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).drop("_n")   # a row a partition
    return placed.join(before, "_p").withColumn(name, F.col("_b") + F.col("_i") + 1).drop("_p", "_i", "_b")


def reach(spark: SparkSession, stored_urls: DataFrame, edges: DataFrame, seeds: list[str],
          max_depth: int = 3, max_pages: int | None = 100, robots: DataFrame | None = None) -> DataFrame:
    """Visited URLs in crawl order.

    ``stored_urls``: (url) of pages that can be fetched; ``edges``:
    (src_url, dst_url, ord) or (src_url, dst_url, rank, ord): links in their
    order on the page. Returns (url, depth, visit_ord, fetched).
    ``max_pages`` is the original's cap; None reaches all.
    """
    from tidemark.operators.links import robots_filter

    if max_pages is not None and max_pages <= 0:
        raise ValueError("max_pages must be a positive page cap, or None")
    if "rank" not in edges.columns:
        edges = edges.withColumn("rank", F.lit(0))
    edges = edges.select("src_url", "dst_url", F.col("rank").cast("int").alias("rank"), F.col("ord").cast("int").alias("ord"))
    if robots is not None:
        edges = robots_filter(edges, robots, url_col="dst_url")
    base = f"{ensure_checkpoint_dir(spark)}/tidemark-crawl-{uuid.uuid4().hex[:12]}"
    # written once for every level: links are not extracted, nor judged, again
    write_buckets(edges, "src_url", BUCKETS, f"{base}/edges")
    edges = bucket_table(spark, f"{base}/edges", "src_url STRING, dst_url STRING, rank INT, ord INT", "src_url", BUCKETS)
    write_buckets(stored_urls.select("url").distinct(), "url", BUCKETS, f"{base}/stored")
    stored = bucket_table(spark, f"{base}/stored", "url STRING", "url", BUCKETS).withColumn("fetched", F.lit(True))
    # seeds: a short list given by the caller
    level = spark.createDataFrame([(u, [0, i]) for i, u in enumerate(dict.fromkeys(seeds))], "url string, key array<int>")
    if robots is not None:
        level = robots_filter(level, robots, url_col="url")
    folders, total, depth = [], 0, 0
    while True:
        if max_pages is not None:
            level = level.orderBy("key").limit(max_pages - total)          # top-k: the cap is the feature
        folders.append(f"level{depth}")
        write_buckets(level.join(stored, "url", "left").select(
            "url", "key", F.lit(depth).alias("depth"), F.coalesce("fetched", F.lit(False)).alias("fetched")),
            "url", BUCKETS, f"{base}/visited/folder={folders[-1]}")
        level = bucket_table(spark, f"{base}/visited", VISITED, "url", BUCKETS, folders[-1:])
        visited = bucket_table(spark, f"{base}/visited", VISITED, "url", BUCKETS, folders).drop("folder")
        n = level.count()
        total += n
        if n == 0 or depth >= max_depth or total == max_pages:
            break
        level = next_level(edges, level, visited)
        depth += 1
    return numbered(visited, ["depth", "key"], "visit_ord").select("url", "depth", "visit_ord", "fetched")


def next_level(edges: DataFrame, level: DataFrame, visited: DataFrame) -> DataFrame:
    """(url, key) of what the level's fetched pages link to and nobody has visited."""
    parents = level.filter("fetched").select(F.col("url").alias("src_url"), "key")
    found = edges.join(parents, "src_url").select(
        F.col("dst_url").alias("url"), F.concat("key", F.array("rank", "ord")).alias("key"))
    return found.groupBy("url").agg(F.min("key").alias("key")).join(visited.select("url"), "url", "left_anti")
