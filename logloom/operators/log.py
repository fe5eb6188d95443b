"""Logs: views of tables as logs, the valid prefix, truncation, numbering and append."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.schema import DELETE, PUT


def log_view(rows: DataFrame, seq: Column, key: Column, deleted: Column, value: Column) -> DataFrame:
    """(seq, key, op, value): rows as mutations; a deleted row has no value."""
    return rows.select(seq.alias("seq"), key.alias("key"), F.when(deleted, DELETE).otherwise(PUT).alias("op"), F.when(~deleted, value).alias("value"))


def events_log(events: DataFrame) -> DataFrame:
    return log_view(events, F.col("event_id") + 1, F.concat(F.lit("user-"), F.col("user_id").cast("string")), F.col("event_type") == "error", F.col("props"))


def orders_log(orders: DataFrame) -> DataFrame:
    return log_view(orders, F.col("o_orderkey") + 1, F.concat(F.lit("customer-"), F.col("o_custkey").cast("string")), F.col("o_orderstatus") == "F", F.col("o_orderpriority"))


def conversations_log(turns: DataFrame) -> DataFrame:
    """Keyed by conversation; sequence numbers count within a key."""
    return log_view(turns, F.col("turn").cast("long"), F.concat(F.lit("conversation-"), F.col("conv_id").cast("string")), F.lit(False), F.col("text"))


def valid_prefix(records: DataFrame, by: list[str]) -> DataFrame:
    """records(by..., ordinal, seq, intact): those before the first that is damaged or out of order.

    One window per file finds the order check; its minimum is an aggregate with
    map-side combine, so only (file, ordinal, seq) are ever sorted.
    """
    w = Window.partitionBy(*by).orderBy("ordinal")
    ok = F.col("intact") & (F.col("seq") > F.coalesce(F.lag("seq").over(w), F.lit(0)))
    flagged = records.withColumn("_ok", ok)
    bad = flagged.where(~F.col("_ok")).groupBy(*by).agg(F.min("ordinal").alias("_bad"))
    return flagged.join(bad, by, "left").where(F.col("_bad").isNull() | (F.col("ordinal") < F.col("_bad"))).drop("_ok", "_bad")


def truncate(log: DataFrame, watermark: int) -> DataFrame:
    return log.where(F.col("seq") > watermark)


def next_sequence(log: DataFrame, watermark: int = 0, at_least: int = 1) -> DataFrame:
    """One row: one past the last number in the log and the watermark, never below at_least."""
    return log.agg(F.greatest(F.coalesce(F.max("seq"), F.lit(0)) + 1, F.lit(watermark) + 1, F.lit(at_least)).alias("next_seq"))


def append(log: DataFrame, writes: DataFrame, next_seq: int, order: str) -> DataFrame:
    """The log with writes(order, op, key, value) numbered from next_seq.

    Writes that already carry a dense order (offsets of a source) are numbered
    by arithmetic; there is no global window.
    """
    first = writes.agg(F.min(order)).first()[0] or 0
    return log.unionByName(writes.select((F.col(order) - first + next_seq).cast("long").alias("seq"), "key", "op", "value"))
