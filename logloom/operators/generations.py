"""Generations: immutable sorted runs of a log, merged on read or by compaction."""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.schema import BLOOM_OVERHEAD, COMPACTION_TRIGGER, DELETE, FLUSH_BYTES, HEADER_BYTES, PUT, RECORD_OVERHEAD, TOMBSTONE, VALUE, bytes_of


def by_count(log: DataFrame, size: int) -> DataFrame:
    """Entries of generations of `size` sequence numbers each: the newest record of a key in a generation."""
    gen = F.expr(f"(seq - 1) DIV {size}").alias("gen_id")
    w = F.max_by(F.struct("op", "value"), "seq")
    rows = log.groupBy(gen, "key").agg(w.alias("w"), F.max("seq").alias("seq"))
    return rows.select("gen_id", "key", F.when(F.col("w.op") == PUT, VALUE).otherwise(TOMBSTONE).alias("kind"), "w.value", "seq")


def bloom_bits(n: Column, p: float = 0.01) -> Column:
    """ceil(-n ln p / (ln 2)^2), 8 at least."""
    return F.greatest(F.ceil(-n * F.ln(F.lit(p)) / F.pow(F.ln(F.lit(2.0)), F.lit(2.0))), F.lit(8))


def record_bytes() -> Column:
    return F.lit(RECORD_OVERHEAD) + bytes_of("key") + bytes_of("value")


def catalog(gens: DataFrame) -> DataFrame:
    """Per generation: entries, tombstones, watermark and the bytes of its file and of its filter."""
    out = gens.groupBy("gen_id").agg(
        F.count(F.lit(1)).alias("entries"),
        F.count_if(F.col("kind") == TOMBSTONE).alias("tombstones"),
        F.max("seq").alias("watermark"),
        (F.sum(record_bytes()) + HEADER_BYTES).cast("long").alias("data_bytes"),
    )
    return out.withColumn("bloom_bytes", (F.ceil(bloom_bits(F.col("entries")) / 64) * 8 + BLOOM_OVERHEAD).cast("long"))


def merge(gens: DataFrame, keep_tombstones: bool = False) -> DataFrame:
    """(key, kind, value, gen_id): the newest generation that has any entry of a key decides."""
    w = F.max_by(F.struct("kind", "value"), "gen_id")
    out = gens.groupBy("key").agg(w.alias("w"), F.max("gen_id").alias("gen_id")).select("key", "w.kind", "w.value", "gen_id")
    return out if keep_tombstones else out.where(F.col("kind") == VALUE)


def memtable_bytes(winners: DataFrame) -> DataFrame:
    return winners.agg(F.coalesce(F.sum(bytes_of("key") + bytes_of("value")), F.lit(0)).alias("bytes"))


def compaction_after(flush: Column, trigger: int = COMPACTION_TRIGGER) -> Column:
    """Whether flush k (from 1) triggers a compaction: one table stays, so every trigger - 1 flushes after the first."""
    return (flush >= trigger) & ((flush - trigger) % (trigger - 1) == 0)


def flush_segments(log: DataFrame, log_id: str, threshold: int = FLUSH_BYTES) -> DataFrame:
    """(log_id, seq, segment): where size-triggered flushes cut each log.

    The size shrinks when a key is overwritten and resets at each cut, so a log
    is a sequential fold; logs are independent of each other and are folded in
    parallel, each from key, operation and length alone.
    """
    slim = log.select(F.col(log_id).alias("log_id"), "seq", "key", (bytes_of("key") + bytes_of("value")).alias("size"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        segment, total, held, out = 0, 0, {}, []
        for key, size in zip(pdf["key"], pdf["size"], strict=True):
            total += size - held.get(key, 0)
            held[key] = size
            out.append(segment)
            if total >= threshold:
                segment, total, held = segment + 1, 0, {}
        return pd.DataFrame({"log_id": pdf["log_id"], "seq": pdf["seq"], "segment": out})

    kind = dict(slim.dtypes)["log_id"]
    return slim.groupBy("log_id").applyInPandas(fold, f"log_id {kind}, seq long, segment long")


class Store:
    """Generations as Parquet files in a folder, with a manifest that names those that count.

    Files that the manifest doesn't list are invisible, so a write that dies
    half-way or a file that outlives its generation changes nothing; the
    watermark is in the manifest, so it outlasts an empty compaction.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def manifest(self) -> dict:
        """The manifest with the highest version; read once for each query."""
        fs, p = self._fs(f"{self.root}/manifest")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        versions = sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))
        if not versions:
            return {"version": 0, "watermark": 0, "generations": []}
        text = "".join(r.value for r in self.spark.read.text(f"{self.root}/manifest/{versions[-1]:012d}.json", wholetext=True).collect())
        return json.loads(text)

    def _commit(self, now: dict, **change) -> dict:
        new = now | change | {"version": now["version"] + 1}
        fs, tmp = self._fs(f"{self.root}/manifest/.{uuid.uuid4().hex}")
        out = fs.create(tmp)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        _, to = self._fs(f"{self.root}/manifest/{new['version']:012d}.json")
        if fs.exists(to) or not fs.rename(tmp, to):
            raise RuntimeError("another writer committed this version")
        return new

    def next_seq(self) -> int:
        return self.manifest()["watermark"] + 1

    def flush(self, log: DataFrame, batch: int | None = None) -> dict:
        """Write the winners of a piece of log as a new generation; nothing for an empty piece.

        Records up to the watermark are a replay and skipped. A numbered batch of a
        stream is skipped as a whole if the manifest has its number; if not, records
        that come late are kept, and lose to newer ones by their sequence numbers.
        """
        now = self.manifest()
        if batch is not None and batch <= now.get("batch", -1):
            return now
        piece = log if batch is not None else log.where(F.col("seq") > now["watermark"])
        top = piece.agg(F.max("seq")).first()[0]
        if top is None:
            return now
        w = F.max_by(F.struct("op", "value"), "seq")
        rows = piece.groupBy("key").agg(w.alias("w"), F.max("seq").alias("seq")).select("key", F.when(F.col("w.op") == DELETE, TOMBSTONE).otherwise(VALUE).alias("kind"), "w.value", "seq")
        done = {} if batch is None else {"batch": batch}
        return self._commit(now, watermark=max(top, now["watermark"]), generations=[*now["generations"], self._write(rows)], **done)

    def _write(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        writer = rows.repartitionByRange("key").sortWithinPartitions("key").write.option("parquet.bloom.filter.enabled#key", "true")
        writer.parquet(f"{self.root}/data/{name}")
        return name

    def generations(self) -> DataFrame | None:
        """(gen_id, key, kind, value, seq) of all listed generations; the pruned columns of all of them."""
        out = None
        for i, name in enumerate(self.manifest()["generations"]):
            g = self.spark.read.parquet(f"{self.root}/data/{name}").withColumn("gen_id", F.lit(i).cast("long"))
            out = g if out is None else out.unionByName(g)
        return out

    def get(self, key: str) -> bytes | None:
        """A key's value: its newest entry in any generation decides, a tombstone means none.

        The key is pushed to the files, whose statistics and Bloom filters skip all others.
        """
        gens = self.generations()
        found = None if gens is None else gens.where(F.col("key") == key).agg(F.max_by(F.struct("kind", "value"), F.struct("seq", "gen_id")).alias("e")).first()["e"]
        return bytes(found["value"]) if found is not None and found["kind"] == VALUE else None

    def read(self) -> DataFrame | None:
        gens = self.generations()
        if gens is None:
            return None
        w = F.max_by(F.struct("kind", "value"), F.struct("seq", "gen_id"))
        return gens.groupBy("key").agg(w.alias("w")).where(F.col("w.kind") == VALUE).select("key", "w.value")

    def compact(self, keep_tombstones: bool = False) -> dict:
        """Merge all generations into one; fewer than two are left alone, an empty result leaves none but the watermark."""
        now = self.manifest()
        if len(now["generations"]) < 2:
            return now
        w = F.max_by(F.struct("kind", "value", "seq"), F.struct("seq", "gen_id"))
        rows = self.generations().groupBy("key").agg(w.alias("w")).select("key", "w.kind", "w.value", "w.seq")
        if not keep_tombstones:
            rows = rows.where(F.col("kind") == VALUE)
        return self._commit(now, generations=[] if rows.isEmpty() else [self._write(rows)])

    def load_snapshot(self, rows: DataFrame, watermark: int) -> dict:
        """An empty store takes (key, value) rows as its one generation."""
        now = self.manifest()
        if watermark < 0 or now["generations"] or now["watermark"]:
            raise ValueError("a snapshot needs an empty store and a watermark of 0 at least")
        rows = rows.select("key", F.lit(VALUE).alias("kind"), "value", F.lit(watermark).cast("long").alias("seq"))
        return self._commit(now, watermark=watermark, generations=[] if rows.isEmpty() else [self._write(rows)])

    def resync(self, rows: DataFrame, watermark: int) -> dict:
        """Replace everything by a snapshot, in one change of the manifest: readers see all of the old state or all of the new."""
        if watermark < 0:
            raise ValueError("a snapshot needs a watermark of 0 at least")
        rows = rows.select("key", F.lit(VALUE).alias("kind"), "value", F.lit(watermark).cast("long").alias("seq"))
        return self._commit(self.manifest(), watermark=watermark, generations=[] if rows.isEmpty() else [self._write(rows)])

    def tail(self, log: DataFrame) -> DataFrame:
        """The log records that no generation reflects."""
        return log.where(F.col("seq") > self.manifest()["watermark"])
