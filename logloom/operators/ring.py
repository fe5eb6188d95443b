"""Consistent hashing: positions, owners, movement and migration.

A position is the first 8 bytes of a SHA-256, kept as 16 hex digits: their
order as text is their order as unsigned numbers, and no 64-bit arithmetic can
overflow. A key belongs to the first position at or after its own, wrapping.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.schema import DELETE, ERRORS, PUT, VNODES

#: Rings of at most so many positions are broadcast; that is 7,800 nodes.
BROADCAST_POSITIONS = 1_000_000


def position(text: Column) -> Column:
    return F.substring(F.sha2(F.encode(text, "UTF-8"), 256), 1, 16)


def ring(spark: SparkSession, nodes: Sequence[str] | DataFrame, vnodes: int = VNODES) -> DataFrame:
    """(node, vnode, pos); of colliding positions the node that sorts last keeps it."""
    if not isinstance(nodes, DataFrame):
        nodes = spark.sql(f"SELECT explode(array({', '.join(repr(n) for n in sorted(nodes))})) AS node")
    rows = nodes.distinct().select("node", F.explode(F.sequence(F.lit(0), F.lit(vnodes - 1))).alias("vnode"))
    rows = rows.withColumn("pos", position(F.concat_ws("#", "node", F.col("vnode").cast("string"))))
    return rows.groupBy("pos").agg(F.max(F.struct("node", "vnode")).alias("m")).select("m.node", "m.vnode", "pos")


def with_node(ring_: DataFrame, node: str, vnodes: int = VNODES) -> DataFrame:
    """The ring and one node more; adding a node twice changes nothing."""
    both = ring_.unionByName(ring(ring_.sparkSession, [node], vnodes))
    return both.groupBy("pos").agg(F.max(F.struct("node", "vnode")).alias("m")).select("m.node", "m.vnode", "pos")


def without_node(ring_: DataFrame, node: str) -> DataFrame:
    return ring_.where(F.col("node") != node)


def replace_addresses(topology: DataFrame, changes: DataFrame) -> DataFrame:
    """topology(node, host, port) after changes of the same columns: a null host removes a node, others are added or replaced."""
    kept = topology.join(changes.select("node"), "node", "left_anti")
    return kept.unionByName(changes.where(F.col("host").isNotNull()).select(*topology.columns))


def arcs(ring_: DataFrame) -> DataFrame:
    """(node, lo, hi, top): lo < position <= hi belongs to node, by the arc's first byte or bytes it spans.

    An arc is repeated for each leading byte (two hex digits) it touches, so
    that keys meet arcs in an equi-join on that byte with a residual.
    """
    w = Window.orderBy("pos")  # as many rows as the ring has positions
    everything = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cut = ring_.select("node", F.lag("pos").over(w).alias("lo"), F.col("pos").alias("hi"), F.last("pos").over(everything).alias("end"))
    arc = lambda lo, hi: F.struct(F.coalesce(lo, F.lit("")).alias("lo"), hi.alias("hi"))
    own = arc(F.col("lo"), F.col("hi"))
    wrapped = F.when(F.col("lo").isNull(), F.array(own, arc(F.col("end"), F.lit("g")))).otherwise(F.array(own))
    all_ = cut.select("node", F.explode(wrapped).alias("a")).select("node", "a.*")
    byte = lambda c: F.conv(F.rpad(F.substring(c, 1, 2), 2, "0"), 16, 10).cast("int")
    top = F.explode(F.sequence(byte(F.col("lo")), F.when(F.col("hi") == "g", 255).otherwise(byte(F.col("hi")))))
    return all_.select("node", "lo", "hi", top.alias("top"))


def owners(keys: DataFrame, ring_: DataFrame, key: str = "key") -> DataFrame:
    """keys with `owner`; an empty ring owns nothing, which fails."""
    n = ring_.count()
    if not n:
        raise ValueError("the ring is empty")
    a = arcs(ring_)
    a = F.broadcast(a) if n <= BROADCAST_POSITIONS else a
    placed = keys.withColumn("_pos", position(F.col(key))).withColumn("_top", F.conv(F.substring("_pos", 1, 2), 16, 10).cast("int"))
    joined = placed.join(a, (F.col("_top") == F.col("top")) & (F.col("_pos") > F.col("lo")) & (F.col("_pos") <= F.col("hi")))
    return joined.select(*keys.columns, F.col("node").alias("owner"))


def keys_per_node(owned: DataFrame) -> DataFrame:
    return owned.groupBy("owner").agg(F.count(F.lit(1)).alias("keys"))


def moved(keys: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """(key, before, after) of the keys whose owner differs between two rings; two broadcast joins, no shuffle of keys."""
    a = owners(keys, before).withColumnRenamed("owner", "before")
    return owners(a, after).withColumnRenamed("owner", "after").where(F.col("before") != F.col("after"))


def migration(live: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """(node, op, key, value, step): a put at each moved key's new owner, then a delete at the old one."""
    m = moved(live, before, after)
    steps = F.array(
        F.struct(F.col("after").alias("node"), F.lit(PUT).alias("op"), F.col("value").alias("value"), F.lit(1).alias("step")),
        F.struct(F.col("before").alias("node"), F.lit(DELETE).alias("op"), F.lit(None).cast(live.schema["value"].dataType).alias("value"), F.lit(2).alias("step")),
    )
    return m.select("key", F.explode(steps).alias("s")).select("s.node", "s.op", "key", "s.value", "s.step")


def gate_ownership(ops: DataFrame, ring_: DataFrame, node: str) -> DataFrame:
    """ops with owner and error: what `node` answers to keys it doesn't own."""
    return owners(ops, ring_).withColumn("error", F.when(F.col("owner") == node, ERRORS["NONE"]).otherwise(ERRORS["NOT_OWNER"]))


def redirect(message: Column) -> Column:
    """The leader that a refusal names, null for none."""
    hint = F.regexp_extract(message, r"leader=(\S+)", 1)
    return F.when((hint != "") & (hint != "none"), hint)
