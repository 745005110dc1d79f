"""Connected components of a graph given as a DataFrame of edges, by alternating large-star and small-star steps.

Each step is a partial aggregation and a join, so that no vertex's neighbours are gathered in one task: minima are combined before
the shuffle, and adaptive execution may split a join's hot vertex. Steps go on until the edges no longer change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """edges (u, v), u != v. Large star: every larger neighbour of u is linked to the least of u and its neighbours. Small star: u
    and every smaller neighbour are."""
    if small:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    else:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = near.groupBy("u").agg(F.min("v").alias("low"))
    if small:
        linked = near.join(least, "u").where("v != low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        own = least.select("u", F.col("low").alias("v"))
        return linked.unionByName(own).distinct()
    least = least.withColumn("low", F.least("u", "low"))
    return near.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()


def components(edges: DataFrame, stage: Stage) -> DataFrame:
    """(node, root) for every vertex of edges (u, v), u != v, both of one ordered type; root is the least vertex of its component,
    and has a row of its own. edges must be staged, or cheap to compute twice."""
    now = stage.write(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    while True:
        after = stage.write(_star(_star(now, small=False), small=True), "edges")
        # the fixed point is a set of stars; a sum over hashes and a count tell whether the edges changed
        r = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        stage.drop(now)
        now = after
        if state == tuple(r):
            break
        state = tuple(r)
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
