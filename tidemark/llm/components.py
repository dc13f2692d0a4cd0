"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is a pre-aggregated minimum and a join; the edges are written to the shared folder after
each round, so lineage stays short and nothing but counts comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize


def _star(edges: DataFrame, smaller: bool) -> DataFrame:
    """Connect each node's larger (or smaller) neighbours to the least node of its neighbourhood."""
    both = edges if smaller else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # written, so that the join has an exchange on either side and Spark can split a large neighbourhood
    least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    linked = both.join(least, "u")
    if smaller:  # u > v in every edge
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    else:
        out = linked.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.filter("u > v").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component), component the least node; nodes without an edge to another are left out."""
    current = materialize(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct(), "edges"
    )
    while True:
        # done when all edges are stars: each u has one edge, and no v is a u
        n, parents = current.agg(F.count("*"), F.count_distinct("u")).first()
        chained = current.select(F.col("v").alias("u")).join(current.select("u"), "u", "left_semi").limit(1).count() if n == parents else 1
        if n == parents and not chained:
            break
        current = materialize(_star(_star(current, smaller=False), smaller=True), "edges")
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
