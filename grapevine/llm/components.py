"""Connected components of an edge table, by alternating star contraction.

Each round points every node's larger neighbours, then its smaller ones, at the smallest node it knows (large star, small star).
Rounds grow with the logarithm of the longest path, each is two aggregations, and each writes its edges to the shared
folder. No node, edge or component is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of (a, b): component is the smallest node that edges reach. No edges, no rows."""
    pairs = materialise(
        edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        name="component-edges",
    )
    before = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        # large star: neighbours larger than the node move to its smallest neighbour
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a != b").distinct()
        # small star: the node and its smaller neighbours move to the smallest of them
        floor = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(floor, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(floor.select("a", F.col("m").alias("b")))
        pairs = materialise(small.filter("a != b").distinct(), name="component-edges")
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    nodes = pairs.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    roots = pairs.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return nodes.unionByName(roots)
