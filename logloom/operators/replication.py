"""Replication: outcomes of replicated records, catch-up, lag, snapshots and bootstrap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.operators.leadership import implied_term
from logloom.operators.state import live_state

APPLIED, ALREADY, GAP = "APPLIED", "ALREADY_APPLIED", "GAP_DETECTED"


def apply_outcomes(arrivals: DataFrame, next_seq: int = 1) -> DataFrame:
    """arrivals(follower, arrival, seq, ...) with outcome, up to each follower's first gap.

    A record is applied if it is the next number, was applied before if it is a
    lower one, and is a gap if it is higher. The running maximum of what arrived
    is the state as long as no gap was refused, so rows after the first gap,
    where a follower stops, aren't returned.
    """
    w = Window.partitionBy("follower").orderBy("arrival")
    top = F.greatest(F.lit(next_seq - 1), F.coalesce(F.max("seq").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(next_seq - 1)))
    out = arrivals.withColumn("_top", top)
    out = out.withColumn("outcome", F.when(F.col("seq") == F.col("_top") + 1, APPLIED).when(F.col("seq") <= F.col("_top"), ALREADY).otherwise(GAP))
    gaps = F.count_if(F.col("outcome") == GAP).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return out.withColumn("_gaps", gaps).where(F.col("_gaps") == 0).drop("_top", "_gaps")


def apply_until_gap(arrivals: DataFrame, next_seq: int = 1) -> DataFrame:
    return apply_outcomes(arrivals, next_seq).where(F.col("outcome") == APPLIED).drop("outcome")


def backlog(log: DataFrame, next_seq: int) -> DataFrame:
    """The records that a follower which wants next_seq hasn't got."""
    return log.where(F.col("seq") >= next_seq)


def missing(log: DataFrame, follower: DataFrame) -> DataFrame:
    return log.join(follower.select("seq"), "seq", "left_anti")


def exactly_once(backfill: DataFrame, live: DataFrame, last_sent: int) -> DataFrame:
    """A backfill up to last_sent and the live records after it."""
    return backfill.where(F.col("seq") <= last_sent).unionByName(live.where(F.col("seq") > last_sent).dropDuplicates(["seq"]))


def replica_lag(acks: DataFrame, leader_next: DataFrame) -> DataFrame:
    """acks(follower, arrival, acked) and one row next_seq -> (follower, acked, lag) by the latest acknowledgement."""
    latest = acks.groupBy("follower").agg(F.max_by("acked", "arrival").alias("acked"))
    return latest.crossJoin(F.broadcast(leader_next.limit(1))).select("follower", "acked", (F.col("next_seq") - F.col("acked")).alias("lag"))


def snapshot(log: DataFrame, watermark: int) -> DataFrame:
    """The live (key, value) as of an exact cut."""
    return live_state(log.where(F.col("seq") <= watermark)).select("key", "value")


def bootstrap(snapshot_: DataFrame, log: DataFrame, watermark: int) -> DataFrame:
    """State from a snapshot and the log behind it."""
    base = snapshot_.select(F.lit(watermark).cast("long").alias("seq"), "key", F.lit("PUT").alias("op"), "value")
    return live_state(base.unionByName(log.where(F.col("seq") > watermark).select("seq", "key", "op", "value"))).select("key", "value")


def needs_resync(next_seq: Column, leader_term: Column, first_follow: Column) -> Column:
    """A replica that holds records of an older term and follows for the first time starts over."""
    return first_follow & (next_seq > 1) & (implied_term(next_seq) < leader_term)


def follow_action(leader: Column, term: Column, me: Column, following: Column, following_term: Column, next_seq: Column, first_follow: Column) -> Column:
    """What a follower does next: STOP, KEEP, RESYNC or RECONNECT (from its own last applied record)."""
    keep = following.eqNullSafe(leader) & following_term.eqNullSafe(term)
    return F.when(leader.isNull() | (leader == me), "STOP").when(keep, "KEEP").when(needs_resync(next_seq, term, first_follow), "RESYNC").otherwise("RECONNECT")


def drop_every(arrivals: DataFrame, n: int) -> DataFrame:
    """A fault: every n-th arrival is lost."""
    return arrivals.where(F.col("arrival") % n != 0)


def duplicate_every(arrivals: DataFrame, n: int) -> DataFrame:
    """A fault: every n-th arrival comes twice, the second time half a step later."""
    twice = arrivals.where(F.col("arrival") % n == 0)
    return arrivals.select("*", F.lit(0).alias("copy")).unionByName(twice.select("*", F.lit(1).alias("copy")))


def delay_every(arrivals: DataFrame, n: int, by: int) -> DataFrame:
    """A fault: every n-th arrival comes later."""
    return arrivals.withColumn("arrival", F.when(F.col("arrival") % n == 0, F.col("arrival") + by).otherwise(F.col("arrival")))


def partition(arrivals: DataFrame, start: int, end: int) -> DataFrame:
    """A fault: nothing arrives from `start` up to `end`, when the partition heals; what was sent meanwhile is lost."""
    return arrivals.where((F.col("arrival") < start) | (F.col("arrival") >= end))


def fan_out(records: DataFrame, origin: str = "origin") -> DataFrame:
    """What listeners hear of: records written here, not those applied from a leader."""
    return records.where(F.col(origin) == "LOCAL").drop(origin)
