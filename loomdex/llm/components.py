"""Connected components of a link table by alternating large-star and small-star steps.

Each step is a group-by with map-side minima and a join on the vertex, so links
never leave the executors, and a vertex with very many links is split like any
skewed join key. O(log^2 n) steps; each one is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.runtime import discard, materialize


def connected_components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for each vertex of ``links(u long, v long)``; root is the component's least vertex.

    Self-links and nulls are dropped, repeated links count once, no links give no rows.
    """
    edges = materialize(
        links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links"
    )
    seen = None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if state == seen or not state["n"]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = materialize(large.distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = materialize(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "small")
        discard(large)
        discard(edges)
        edges = after
