"""Reading and writing the byte formats: each file is one task's work, any path Spark's readers can open.

Files are read whole, as binary rows, so stores that only Spark reads work too.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions import codecs
from logloom.schema import ERRORS
from logloom.tables import ship


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """(file, ordinal, offset, seq, op, key, value): each file's longest valid prefix."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = list(codecs.decode_log(data))
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(rows), pa.string()), *(pa.array(list(c), t) for c, t in zip(columns, types, strict=True))], ["file", "ordinal", "offset", "seq", "op", "key", "value"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, ordinal long, offset long, seq long, op string, key string, value binary")


def read_tables(spark: SparkSession, path: str) -> DataFrame:
    """(file, watermark, key, kind, value) of every entry; a corrupt file fails the read."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                watermark, _ = codecs.decode_header(data)
                rows = list(codecs.decode_table(data))
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 3
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file] * len(rows), pa.string()), pa.array([watermark] * len(rows), pa.int64()), *(pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.string(), pa.binary()), strict=True))],
                    ["file", "watermark", "key", "kind", "value"],
                )

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, watermark long, key string, kind string, value binary")


def generations_from(tables: DataFrame) -> DataFrame:
    """Entries of files as generations, newest watermark last."""
    return tables.select(F.col("watermark").alias("gen_id"), "watermark", "key", "kind", "value")


def encoded_tables(gens: DataFrame) -> DataFrame:
    """gens(gen_id, key, kind, value, seq) -> (gen_id, table binary, bloom binary): one file image per generation.

    A file is written by one writer, and a flush bounds a generation's size.
    """
    ship(gens.sparkSession)

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        rows = sorted(zip(t["key"].to_pylist(), t["kind"].to_pylist(), t["value"].to_pylist(), strict=True), key=lambda r: r[0].encode())
        table = codecs.encode_table(rows, max(t["seq"].to_pylist()))
        return pa.table({"gen_id": pa.array([key[0].as_py()], pa.int64()), "table": pa.array([table], pa.binary()), "bloom": pa.array([codecs.encode_bloom(codecs.bloom_for([r[0] for r in rows]))], pa.binary())})

    rows = gens.select(F.col("gen_id").cast("long").alias("gen_id"), "key", "kind", F.col("value").cast("binary").alias("value"), "seq")
    return rows.groupBy("gen_id").applyInArrow(run, "gen_id long, table binary, bloom binary")


def read_cluster_config(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """Lines of white-space separated fields; comments and blank lines are skipped, a wrong line or a repeated first field fails."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", "#.*$", "")).alias("line")).where("line <> ''")
    parts = F.split("line", r"\s+")
    ok = F.when(F.size(parts) == len(fields), parts).otherwise(F.raise_error(F.concat(F.lit("wrong number of fields: "), F.col("line"))).cast("array<string>"))
    out = lines.select(ok.alias("p")).select(*[F.col("p")[i].alias(f) for i, f in enumerate(fields)])
    twice = out.groupBy(fields[0]).count().where("count > 1").count()
    if twice or out.isEmpty():
        raise ValueError("repeated node" if twice else "no nodes")
    return out


def classify_frames(frames: DataFrame, max_frame: int = codecs.MAX_FRAME_BYTES, max_key: int = codecs.MAX_KEY_BYTES) -> DataFrame:
    """frames(id, payload) -> (id, outcome, error): what a server answers to each request frame."""
    ship(frames.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            outcome = [codecs.classify_frame(x or b"", max_frame, max_key) for x in b.column("payload").to_pylist()]
            error = [0 if o == "OK" else ERRORS[o] for o in outcome]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(outcome, pa.string()), pa.array(error, pa.int32())], ["id", "outcome", "error"])

    return frames.select(F.col("id").cast("long").alias("id"), "payload").mapInArrow(run, "id long, outcome string, error int")


def open_log(spark: SparkSession, path: str) -> DataFrame:
    """The records of one log file, created if it is missing; what follows its longest valid prefix is cut off the file.

    The prefix goes to a new file that takes the old one's place in one rename.
    """
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        fs.create(p).close()
    row = spark.read.format("binaryFile").load(path).select("content").first()  # none for an empty file
    data = bytes(row[0]) if row else b""
    good = codecs.valid_length(data)
    if good < len(data):
        fresh = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.prefix")
        out = fs.create(fresh, True)
        out.write(bytearray(data[:good]))
        out.close()
        hadoop = spark._jvm.org.apache.hadoop.fs
        rename = getattr(hadoop, "Options$Rename")
        how = spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        hadoop.FileContext.getFileContext(p.toUri(), spark._jsc.hadoopConfiguration()).rename(fresh, p, how)
    return read_logs(spark, path)
