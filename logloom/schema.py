"""Schemas and fixed values of the data model: an ordered log of keyed mutations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG = T.StructType([T.StructField("seq", T.LongType(), False), T.StructField("op", T.StringType(), False), T.StructField("key", T.StringType(), False), T.StructField("value", T.BinaryType())])
GENERATION = T.StructType([T.StructField("gen_id", T.LongType()), T.StructField("watermark", T.LongType()), T.StructField("key", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("value", T.BinaryType())])

PUT, DELETE = "PUT", "DELETE"
VALUE, TOMBSTONE = "VALUE", "TOMBSTONE"

# Sizes and codes of the formats.
RECORD_OVERHEAD = 17  # length, type, key length, value length, checksum
HEADER_BYTES = 24
BLOOM_OVERHEAD = 28
FLUSH_BYTES = 4 * 1024 * 1024
COMPACTION_TRIGGER = 4
MAX_KEY_BYTES = 65_536
MAX_FRAME_BYTES = 16 * 1024 * 1024
MAX_RECORD_BYTES = 64 * 1024 * 1024
ERRORS = {"NONE": 0, "MALFORMED_REQUEST": 1, "UNKNOWN_OPERATION": 2, "OVERSIZED_REQUEST": 3, "STORAGE_ERROR": 4, "INTERNAL_ERROR": 5, "NOT_OWNER": 6, "NOT_LEADER": 7}
SEQUENCES_PER_TERM = 1_000_000_000
MAX_LONG = 9_223_372_036_854_775_807
VNODES = 128


def bytes_of(c: Column | str) -> Column:
    """Length in bytes; a missing value has none."""
    return F.coalesce(F.octet_length(c), F.lit(0))


def checked_log(log: DataFrame) -> DataFrame:
    """The log, failing on a null key, a null value of a put, or a record too long to be read back."""
    bad = F.col("key").isNull() | ((F.col("op") == PUT) & F.col("value").isNull())
    long_ = bytes_of("key") + bytes_of("value") + 13 > MAX_RECORD_BYTES
    return log.withColumn("key", F.when(bad, F.raise_error(F.lit("null key or value"))).when(long_, F.raise_error(F.lit("record too long"))).otherwise(F.col("key")))
