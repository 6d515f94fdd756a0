"""Connected components by alternating large-star and small-star steps.

Each step is a table of its own: the driver plans many rounds, and a plan that holds both steps repeats the first one for each use of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from captionlake.llm.tables import discard, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """edges (u, v) with u > v: each node hands its larger neighbours to the least of itself and its neighbours.

    A node has smaller neighbours where it stands as u; a node that doesn't is the least itself. Repeats are left to the small star.
    """
    least = edges.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
    return edges.join(least, "v", "left").select("u", F.coalesce("m", "v").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """edges (u, v) with u > v: each node hands its smaller neighbours and itself to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    # the edge to the least neighbour stays, as the one that hands the node itself over
    moved = edges.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
    return moved.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (u, v): component is the least node that can be reached."""
    now = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct())
    mark = None
    while True:
        handed = materialize(_large_star(now))
        discard(now)
        now = materialize(_small_star(handed))
        discard(handed)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            break
        mark = seen
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
