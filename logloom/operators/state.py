"""Folding a log into state: the newest write of each key wins, deletes hide what is older.

All folds group by key with max_by over the sequence number: map-side combine
leaves one row for each key and task, so a key that holds a third of the log
doesn't burden one task. Windows are used only where each record needs its
neighbours within its key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.schema import DELETE, PUT


def winners(log: DataFrame) -> DataFrame:
    """(key, op, value, seq): each key's newest record, tombstones included."""
    w = F.max_by(F.struct("op", "value"), "seq")
    return log.groupBy("key").agg(w.alias("w"), F.max("seq").alias("seq")).select("key", "w.op", "w.value", "seq")


def live_state(log: DataFrame) -> DataFrame:
    return winners(log).where(F.col("op") == PUT).select("key", "value", "seq")


def state_as_of(log: DataFrame, seq: int) -> DataFrame:
    return live_state(log.where(F.col("seq") <= seq))


def live_keys(log: DataFrame) -> DataFrame:
    """Keys alone; the value column isn't read."""
    return log.groupBy("key").agg(F.max_by("op", "seq").alias("op")).where(F.col("op") == PUT).select("key")


def deleted_keys(log: DataFrame) -> DataFrame:
    return log.groupBy("key").agg(F.max_by("op", "seq").alias("op"), F.max("seq").alias("seq")).where(F.col("op") == DELETE).select("key", "seq")


def get(log: DataFrame, key: str) -> DataFrame:
    """The live value of one key; the predicate reaches the scan where the key is a stored column."""
    return live_state(log.where(F.col("key") == key))


def multi_get(log: DataFrame, keys: Sequence[str] | DataFrame) -> DataFrame:
    """(key, value) for each asked key, null where it isn't live. A list is filtered in place, a table is joined."""
    if isinstance(keys, DataFrame):
        asked, some = keys, log.join(keys, "key", "left_semi")
    else:
        asked = log.sparkSession.sql(f"SELECT explode(array({', '.join(repr(k) for k in keys)})) AS key")
        some = log.where(F.col("key").isin(*keys))
    return asked.join(live_state(some).select("key", "value"), "key", "left")


def _by_key():
    return Window.partitionBy("key").orderBy("seq")


def previous_value(log: DataFrame) -> DataFrame:
    """(seq, key, op, previous): the live value that each write replaced."""
    return log.select("seq", "key", "op", F.lag("value").over(_by_key()).alias("previous"))


def outcomes(log: DataFrame) -> DataFrame:
    """(seq, key, op, outcome): what each write answers."""
    was = F.lag("op").over(_by_key()) == PUT
    put = F.when(was, "OK (previous value replaced)").otherwise("OK")
    delete = F.when(was, "OK (removed)").otherwise("OK (not found)")
    return log.select("seq", "key", "op", F.when(F.col("op") == PUT, put).otherwise(delete).alias("outcome"))


def history(log: DataFrame) -> DataFrame:
    """(key, version, seq, op, valid_to): each key's writes with the number that ended each."""
    w = _by_key()
    return log.select("key", F.row_number().over(w).cast("long").alias("version"), "seq", "op", F.lead("seq").over(w).alias("valid_to"))


def mutation_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("key").agg(F.count_if(F.col("op") == PUT).alias("puts"), F.count_if(F.col("op") == DELETE).alias("deletes"), F.max("seq").alias("last_seq"))
