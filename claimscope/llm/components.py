"""Connected components of a link table, by alternating large-star and small-star steps.

Every round is two joins on written tables, so no component is ever collected; a vertex with any
number of links is a hot key that the join can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from claimscope.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes of ``links`` (a, b); component is the smallest node reachable."""
    edges = written(_directed(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "links")
    before = None
    while True:
        # what the edges are is observed while they are written
        seen = Observation()
        stepped = _small_star(_large_star(edges)).observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))
        edges = written(stepped, "links")
        if seen.get == before:
            break
        before = seen.get
    # every edge now leads from a node to its component's smallest node
    roots = edges.select(F.col("v").alias("node")).distinct()
    return written(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.withColumn("component", F.col("node"))), "components")


def _directed(edges: DataFrame) -> DataFrame:
    """From the larger to the smaller node, each once."""
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are led to the smallest of its neighbours and itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
    moved = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return written(_directed(moved), "links")


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are led to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u")
    return _directed(moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))))
