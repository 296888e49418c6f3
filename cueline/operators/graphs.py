"""Components of graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueline.storage import materialise, release


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Components of an undirected graph by alternating large and small stars.

    ``edges`` has two long columns. Returns ``node`` and ``root`` (smallest node of
    the component) for every node of an edge. All steps are joins and partial
    aggregates on the node; each round is written to the shared folder, and the round
    before it is deleted.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    e = materialise(e.where("u > v").distinct(), "edges")
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        old, e = e, materialise(small, "edges")
        release(old)
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return nodes.unionByName(roots)
