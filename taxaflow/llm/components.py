"""Connected components of an edge table by alternating large-star and small-star steps; labels are the least node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def connected_components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, label) of every node in edges (u, v of any type with an order). Each step is a min-aggregation and a join, cut by checkpoint(); the edge count never grows. More than `most` rounds raise an error."""
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    state = None
    for _ in range(most):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.where("u > v")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select("u", "v", "m")
        e = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u > v").distinct().checkpoint()
        now = tuple(e.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components not settled after {most} rounds")
    labels = e.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("node"), "label")
    return labels.unionByName(e.select(F.col("v").alias("node")).distinct().withColumn("label", F.col("node")))
