"""Measurement: workloads, latency statistics, throughput, amplification, and their reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

THROUGHPUT_COLUMNS = "experiment_id description timestamp op_type mode concurrency run_index warmup_ops measured_ops value_size_bytes elapsed_seconds throughput_ops_per_sec avg_latency_ms p50_latency_ms p95_latency_ms p99_latency_ms max_latency_ms".split()
DURATION_COLUMNS = "experiment_id description timestamp config_label dataset_size run_index elapsed_seconds".split()
METRIC_COLUMNS = "experiment_id description timestamp metric value unit".split()


def workload_key(prefix: str, i: Column) -> Column:
    """`prefix-0000000042`"""
    return F.concat(F.lit(f"{prefix}-"), F.lpad(i.cast("string"), 10, "0"))


def workload_value(size: int) -> Column:
    """Bytes 0, 1, 2, ... modulo 256."""
    return F.unhex(F.lit("".join(f"{i % 256:02x}" for i in range(size))))


def puts(spark: SparkSession, prefix: str, n: int, size: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("i"), F.lit("PUT").alias("op"), workload_key(prefix, F.col("id")).alias("key"), workload_value(size).alias("value"))


def round_robin_gets(spark: SparkSession, prefix: str, n: int, keys: int, offset: int = 0) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("i"), F.lit("GET").alias("op"), workload_key(prefix, (F.col("id") + offset) % keys).alias("key"))


def deletes(spark: SparkSession, prefix: str, n: int, start: int = 0) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("i"), F.lit("DELETE").alias("op"), workload_key(prefix, F.col("id") + start).alias("key"))


# The 48-bit linear congruential generator of java.util.Random.
LCG_A, LCG_C, LCG_BITS = 0x5DEECE66D, 0xB, 48


def _times(x: Column, hi: Column, lo: Column) -> Column:
    """x * (hi * 2^24 + lo) modulo 2^48, without overflow."""
    half = F.lit((1 << 24) - 1).cast("long")
    low, high = x.bitwiseAND(half), F.shiftright(x, 24)
    cross = (hi * low + lo * high).bitwiseAND(half)
    return (lo * low + F.shiftleft(cross, 24)).bitwiseAND(F.lit((1 << 48) - 1).cast("long"))


def lcg_state(seed: int, n: Column) -> Column:
    """The generator's state after n steps from a seed: jumps of 1, 2, 4, ... steps, as n's bits say, so every row finds its own."""
    mask = (1 << LCG_BITS) - 1
    jumps, a, c = [], LCG_A, LCG_C
    for bit in range(42):
        jumps.append(F.struct(*[F.lit(v).cast("long").alias(k) for k, v in (("bit", 1 << bit), ("hi", a >> 24), ("lo", a & 0xFFFFFF), ("c", c))]))
        a, c = a * a & mask, (a * c + c) & mask
    step = lambda s, j: (_times(s, j["hi"], j["lo"]) + j["c"]).bitwiseAND(F.lit(mask).cast("long"))
    first = F.lit((seed ^ LCG_A) & mask).cast("long")
    return F.aggregate(F.array(*jumps), first, lambda s, j: F.when(n.bitwiseAND(j["bit"]) != 0, step(s, j)).otherwise(s))


def lcg_double(seed: int, n: Column) -> Column:
    """The n-th double (from 0) in [0, 1) of the generator: 26 bits of one step and 27 of the next."""
    top = F.shiftright(lcg_state(seed, 2 * n + 1), 22)
    low = F.shiftright(lcg_state(seed, 2 * n + 2), 21)
    return (F.shiftleft(top, 27) + low).cast("double") / float(1 << 53)


def mixed(spark: SparkSession, prefix: str, n: int, keys: int, read_fraction: float, seed: int) -> DataFrame:
    """Uniform keys; an operation is a GET with probability read_fraction. The same seed gives the same sequence, any row by itself."""
    return spark.range(n).select(
        F.col("id").alias("i"),
        F.when(lcg_double(seed, 2 * F.col("id") + 1) < read_fraction, "GET").otherwise("PUT").alias("op"),
        workload_key(prefix, F.floor(lcg_double(seed, 2 * F.col("id")) * keys)).alias("key"),
    )


def nearest_rank(x: str, p: float) -> Column:
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {x})")


def latency_stats(samples: DataFrame, x: str, by: list[str] | None = None) -> DataFrame:
    """count, avg, p50, p95, p99 (nearest rank) and max; no row for an empty group."""
    out = samples.groupBy(*(by or [])).agg(
        F.count(x).alias("n"), F.avg(x).alias("avg"), *[nearest_rank(x, p / 100).alias(f"p{p}") for p in (50, 95, 99)], F.max(x).alias("max")
    )
    return out.where(F.col("n") > 0)


def throughput(ops: DataFrame, started: str, ended: str, by: list[str]) -> DataFrame:
    """Operations over the seconds from the first start to the last end of a phase."""
    seconds = F.expr(f"timestampdiff(MICROSECOND, min({started}), max({ended}))") / 1e6
    return ops.groupBy(*by).agg(F.count(F.lit(1)).alias("ops"), seconds.alias("seconds")).withColumn("ops_per_sec", F.when(F.col("seconds") > 0, F.col("ops") / F.col("seconds")))


def amplification(flushed_bytes: Column, logical_bytes: Column) -> Column:
    return F.when(logical_bytes > 0, flushed_bytes / logical_bytes)


def report(df: DataFrame, path: str) -> None:
    """One headered CSV per partition, quoted where needed."""
    df.write.csv(path, header=True, quote='"', escape='"', mode="overwrite")


def failover(timeline: DataFrame, by: str = "run") -> DataFrame:
    """timeline(run, event, ts) with KILLED, ELECTED, READY and FIRST_WRITE -> seconds from the kill to each; null for what never came.

    The first event of a kind after the kill counts.
    """
    killed = timeline.where(F.col("event") == "KILLED").groupBy(by).agg(F.min("ts").alias("_killed"))
    after = timeline.join(killed, by).where(F.col("ts") >= F.col("_killed"))
    first = lambda kind: F.min(F.when(F.col("event") == kind, F.col("ts")))
    out = after.groupBy(by).agg(F.first("_killed").alias("_killed"), *[first(k).alias(f"_{k}") for k in ("ELECTED", "READY", "FIRST_WRITE")])
    seconds = lambda c: F.expr(f"timestampdiff(MICROSECOND, _killed, {c})") / 1e6
    return out.select(by, seconds("_ELECTED").alias("election_s"), seconds("_READY").alias("transition_s"), seconds("_FIRST_WRITE").alias("first_write_s"))


def throughput_report(samples: DataFrame, experiment: str, description: str, mode: str, warmup_ops: int, value_size: int) -> DataFrame:
    """samples(op_type, concurrency, run_index, started, ended, latency_ns) -> report rows in the order of THROUGHPUT_COLUMNS."""
    by = ["op_type", "concurrency", "run_index"]
    t = throughput(samples, "started", "ended", by).select(*by, F.col("ops").alias("measured_ops"), F.col("seconds").alias("elapsed_seconds"), F.col("ops_per_sec").alias("throughput_ops_per_sec"))
    ms = {"avg": "avg_latency_ms", "p50": "p50_latency_ms", "p95": "p95_latency_ms", "p99": "p99_latency_ms", "max": "max_latency_ms"}
    stats = latency_stats(samples, "latency_ns", by).select(*by, *[(F.col(a) / 1e6).alias(b) for a, b in ms.items()])
    fixed = {"experiment_id": F.lit(experiment), "description": F.lit(description), "timestamp": F.current_timestamp(), "mode": F.lit(mode), "warmup_ops": F.lit(warmup_ops), "value_size_bytes": F.lit(value_size)}
    return t.join(stats, by).withColumns(fixed).select(*THROUGHPUT_COLUMNS)
