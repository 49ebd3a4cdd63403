"""Connected components of an edge table.

Alternating large and small stars: in each round every node sends its
neighbours to the least node it knows, until the edges are stars. Minima are
aggregated before the shuffle and joined back. A node with more than
``1 / HOT`` of all edges is one of at most ``HOT``: the minima of those are sent
to the tasks, so no task gathers a centre's edges. Each half round is written
to the shared folder, which also cuts the lineage. Only two numbers a round
reach the driver.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written

#: nodes that may be hot at once, and the least edges of such a node
HOT, HOT_EDGES = 1000, 100


def _star(pairs: DataFrame, total: int, small: bool) -> DataFrame:
    """pairs (u, v), at most ``total``: v goes to the least of u's neighbourhood. Large star: for each v > u; small star: for v < u, and u itself."""
    found = pairs.groupBy("u").agg(F.min("v").alias("v"), F.count("*").alias("n")).select("u", F.least("u", "v").alias("m"), "n")
    least = written(found, "minima")
    # n > total / HOT holds for fewer than HOT nodes
    hot = least.where(F.col("n") > max(HOT_EDGES, total // HOT)).select("u", F.col("m").alias("hot"))
    seen = pairs.join(F.broadcast(hot), "u", "left")
    sent = (seen.where("hot is not null").select("u", "v", F.col("hot").alias("m"))
            .unionByName(seen.where("hot is null").select("u", "v").join(least.select("u", "m"), "u")))
    if small:
        out = sent.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    else:
        out = sent.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u != v").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """edges (u, v) -> (node, root) for every node that has an edge; root is the least node of its component."""
    both = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, before = written(both, name), None
    while True:
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == tuple(sums):
            break
        before = tuple(sums)
        mirrored = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = written(_star(mirrored, 2 * sums[0], small=False), name)
        now = written(_star(large, sums[0], small=True), name)
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
