"""A bit-exact membership filter: FNV-1a double hashing, built by a merge of partial filters."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.tables import ship

# The 64-bit FNV-1a offset and prime, and the byte that salts the second hash.
FNV_OFFSET, FNV_PRIME, SALT = 0xCBF29CE484222325, 0x100000001B3, 0x5A


def shape(n: int, p: float) -> tuple[int, int]:
    """Bits and hash functions for n entries at false-positive rate p."""
    if not 0 < p < 1:
        raise ValueError("the rate must be between 0 and 1")
    n = max(1, n)
    bits = max(8, math.ceil(-n * math.log(p) / math.log(2) ** 2))
    return bits, max(1, math.floor(bits / n * math.log(2) + 0.5))


def positions(keys: list[str], bits: int, hashes: int) -> np.ndarray:
    """[keys, hashes] bit indexes: the signed remainder of h1 + i * h2 with 64-bit wraparound."""
    body = [k.encode() for k in keys]
    width = max(map(len, body), default=0)
    chars = np.zeros((len(body), width), np.uint8)
    for i, b in enumerate(body):
        chars[i, : len(b)] = np.frombuffer(b, np.uint8)
    length = np.array([len(b) for b in body])
    h = np.full(len(body), FNV_OFFSET, np.uint64)
    prime = np.uint64(FNV_PRIME)
    for j in range(width):
        h = np.where(j < length, (h ^ chars[:, j].astype(np.uint64)) * prime, h)
    second = (h ^ np.uint64(SALT)) * prime
    combined = h[:, None] + np.arange(hashes, dtype=np.uint64) * second[:, None]
    return np.mod(combined.view(np.int64), np.int64(bits))


class Filter:
    def __init__(self, bits: int, hashes: int, words: np.ndarray | None = None):
        self.bits, self.hashes = bits, hashes
        self.words = np.zeros(-(-bits // 64), np.uint64) if words is None else words

    def add(self, keys: list[str]) -> None:
        at = positions(keys, self.bits, self.hashes).ravel()
        np.bitwise_or.at(self.words, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))

    def might_contain(self, keys: list[str]) -> np.ndarray:
        at = positions(keys, self.bits, self.hashes)
        return ((self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool).all(1)


def build(keys: DataFrame, key: str, p: float) -> Filter:
    """The filter of all keys. Executors send the indexes of words that are set, summed by OR before they are collected."""
    ship(keys.sparkSession)
    bits, hashes = shape(keys.count(), p)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Filter(bits, hashes)
        for b in batches:
            f.add(b.column(0).to_pylist())
        at = np.flatnonzero(f.words)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(f.words[at].view(np.int64))], ["i", "w"])

    rows = keys.select(key).mapInArrow(partial, "i long, w long").groupBy("i").agg(F.bit_or("w").alias("w")).collect()
    f = Filter(bits, hashes)
    for r in rows:
        f.words[r.i] = np.int64(r.w).view(np.uint64)
    return f


def test(rows: DataFrame, key: str, f: Filter) -> DataFrame:
    """rows with might_contain."""
    ship(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(f)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shared.value.might_contain(b.column(key).to_pylist()))], [*b.schema.names, "might_contain"])

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{names}, might_contain boolean")
