"""Liveness from heartbeats: states at ticks, their changes, and outages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALIVE, SUSPECT, DEAD = "ALIVE", "SUSPECT", "DEAD"


def state(elapsed: Column, suspect: int, dead: int) -> Column:
    """By microseconds since the last heartbeat; limits belong to the worse state."""
    if not 0 < suspect <= dead:
        raise ValueError("0 < suspect <= dead is needed")
    return F.when(elapsed >= dead, DEAD).when(elapsed >= suspect, SUSPECT).otherwise(ALIVE)


def at_ticks(beats: DataFrame, ticks: DataFrame, suspect: int, dead: int) -> DataFrame:
    """beats(node, ts, kind: JOIN, BEAT or LEAVE), ticks(ts) -> (node, tick, elapsed_us, state) while a node is a member.

    The as-of join is a union with a running last value over each node's own
    rows, so it is linear in both sides. Ticks are dealt to every node, which
    is the size of the result; they are broadcast.
    """
    member = Window.partitionBy("node").orderBy("ts", "rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    nodes = beats.select("node").distinct()
    dealt = nodes.join(F.broadcast(ticks.select("ts"))).select("node", "ts", F.lit("TICK").alias("kind"))
    rows = beats.select("node", "ts", "kind").unionByName(dealt).withColumn("rank", F.when(F.col("kind") == "TICK", 1).otherwise(0))
    entry = F.last(F.when(F.col("kind").isin("JOIN", "LEAVE"), F.struct("kind", "ts")), ignorenulls=True).over(member)
    beat = F.last(F.when(F.col("kind").isin("JOIN", "BEAT"), F.col("ts")), ignorenulls=True).over(member)
    rows = rows.withColumns({"_entry": entry, "_beat": beat}).where((F.col("kind") == "TICK") & (F.col("_entry.kind") == "JOIN"))
    elapsed = F.expr("timestampdiff(MICROSECOND, _beat, ts)")
    return rows.select("node", F.col("ts").alias("tick"), F.col("_beat").alias("last_beat"), elapsed.alias("elapsed_us")).withColumn("state", state(F.col("elapsed_us"), suspect, dead))


def transitions(states: DataFrame) -> DataFrame:
    """(node, tick, previous, current) where a tick changes a node's state.

    A heartbeat since the tick before sets a node alive without a record, so
    the state a tick starts from is ALIVE then.
    """
    w = Window.partitionBy("node").orderBy("tick")
    before = F.when(F.lag("last_beat").over(w) == F.col("last_beat"), F.lag("state").over(w)).otherwise(ALIVE)
    return states.withColumn("previous", F.coalesce(before, F.lit(ALIVE))).where(F.col("previous") != F.col("state")).select("node", "tick", "previous", F.col("state").alias("current"))


def outages(beats: DataFrame, dead: int) -> DataFrame:
    """(node, down_from, up_at): gaps between heartbeats that last as long as `dead` at least."""
    w = Window.partitionBy("node").orderBy("ts")
    gaps = beats.withColumn("up_at", F.lead("ts").over(w)).where("up_at IS NOT NULL")
    return gaps.where(F.expr("timestampdiff(MICROSECOND, ts, up_at)") >= dead).select("node", F.col("ts").alias("down_from"), "up_at")
