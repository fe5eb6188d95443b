"""Connected components by alternating star contractions, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.tables import drop_materialized, materialize


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("m", "u").alias("m"))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Point each node's larger (or smaller) neighbours at the least node of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = _least(both)
    joined = both.join(least, both["u"] == least["_u"])
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("_u").alias("u"), F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges(u, v) of longs -> (node, component): every node of an edge with the least node it reaches.

    Each round is two groupings with map-side combine and two equi-joins over
    edges only, written to the shared folder; the number of rounds is
    logarithmic. The result has one row per node.
    """
    now = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    seen = None
    while True:
        after = materialize(_star(_star(now, True).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), False))
        state = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_materialized(now)
        now = after
        if state == seen or not state[0]:
            break
        seen = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
