"""Benchmark decontamination: size-partitioned MinHash containment search.

Items are short and documents long, so an item's similarity to a whole document
says nothing. Items are therefore put into partitions by size (number of word
shingles, each partition's largest is `GROWTH` times its smallest), and for each
partition a document is read through windows of twice the partition's largest
size that overlap by half: a passage of that size lies whole in one of them,
which bounds from below the window's similarity to an item it contains. From
that bound follows how many minima are compared so that an item at the
threshold is missed with probability `miss` at most. Every candidate is then
verified by exact containment: the share of the item's shingles found anywhere
in the document.

Items reach the executors as a broadcast table of at most ITEM_BYTES of text;
a longer benchmark is taken in several such blocks, one pass for each.

Defined results: words are split at ASCII white space and A-Z lower-cased; an
item of fewer than k words is its whole word sequence, sought as such; items and
documents that are null or have no words match nothing; rows that share a doc_id
or an item_id give one row for each pair, with the larger containment.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.near_dedup import seeds
from logloom.llm.textvec import chunks, shingles, sorted_set, utf8, words
from logloom.tables import ship, tidy

GROWTH = 1.4
MISS = 1e-4
ITEM_BYTES = 32 << 20


class Items:
    """Minima and shingle sets of benchmark items, by shingle length and size partition."""

    def __init__(self, rows: list[tuple[int, str]], k: int, threshold: float, miss: float = MISS):
        self.threshold = threshold
        self.ids = np.array([i for i, _ in rows], np.int64)
        h, at = words(*utf8(pa.array([t or "" for _, t in rows], pa.large_string())))
        parts: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = defaultdict(list)
        for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
            if a < b:
                q = min(k, int(b - a))
                s = sorted_set(shingles(h[a:b], np.array([0, b - a]), q)[0])
                parts[q, math.ceil(math.log(len(s), GROWTH) - 1e-9)].append((i, s))
        self.partitions = []
        for (q, level), members in sorted(parts.items()):
            sizes = [len(s) for _, s in members]
            largest, least = max(sizes), min(sizes)
            # n of 2 * largest + (1 - t) * n shingles agree at least, n = t * least
            bound = threshold * least / (2 * largest + least * (1 - threshold))
            n = max(1, math.ceil(math.log(miss) / math.log(1 - bound)))
            flip, odd = seeds(n)
            sets = [s for _, s in members]
            table = []
            for j in range(n):
                m = np.array([((((s >> np.uint64(32)).astype(np.uint32)) ^ flip[j]) * odd[j]).min() for s in sets])
                order = np.argsort(m, kind="stable")
                table.append((m[order], order))
            self.partitions.append((q, largest, [i for i, _ in members], sets, table))

    def hits(self, offsets: np.ndarray, data: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """(text, item, containment) of all texts in a chunk."""
        h, at = words(offsets, data)
        for q in sorted({p[0] for p in self.partitions}):
            x, to = shingles(h, at, q)
            n = np.diff(at)
            usable = n >= q  # a text shorter than q words has no shingle of q words
            text = np.flatnonzero((np.diff(to) > 0) & usable)
            if not len(text):
                continue
            high = (x >> np.uint64(32)).astype(np.uint32)
            own = [p for p in self.partitions if p[0] == q]
            blocks = []
            for _, size, *_ in own:
                count = -(-(to[text + 1] - to[text]) // size)
                doc = np.repeat(text, count)
                start = to[doc] + size * (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count))
                blocks.append((doc, start, doc[:-1] == doc[1:]))
            found = set()
            for (_, _, members, _, table), (doc, start, joined) in zip(own, blocks, strict=True):
                flip, odd = seeds(len(table))
                for j, (minima, order) in enumerate(table):
                    m = np.minimum.reduceat((high ^ flip[j]) * odd[j], start)
                    m[:-1] = np.where(joined, np.minimum(m[:-1], m[1:]), m[:-1])
                    lo = np.searchsorted(minima, m)
                    for w in np.flatnonzero(minima[np.minimum(lo, len(minima) - 1)] == m):
                        e = lo[w]
                        while e < len(minima) and minima[e] == m[w]:
                            found.add((int(doc[w]), members[order[e]]))
                            e += 1
            sets = {i: s for p in own for i, s in zip(p[2], p[3], strict=True)}
            for d, i in sorted(found):
                share = np.isin(sets[i], x[to[d] : to[d + 1]]).mean()
                if share >= self.threshold:
                    yield d, i, float(share)


def _search(items, k: int, threshold: float):
    """(doc_id, text) -> (doc_id, item_id, containment)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Items(items.value, k, threshold)
        for batch in batches:
            offsets, data = utf8(batch.column("text"))
            rows = [(i + d, index.ids[x], c) for i, _, o, b in chunks(offsets, data) for d, x, c in index.hits(o, b)]
            at, ids, share = zip(*rows, strict=True) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(ids, pa.int64()), pa.array(share, pa.float64())], ["doc_id", "item_id", "containment"])

    return run


def _clean(items, k: int, threshold: float, text: str):
    """Rows in, those without a hit out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Items(items.value, k, threshold)
        for batch in batches:
            offsets, data = utf8(batch.column(text))
            keep = np.ones(batch.num_rows, bool)
            for i, _, o, b in chunks(offsets, data):
                keep[[i + d for d, _, _ in index.hits(o, b)]] = False
            yield batch.filter(pa.array(keep))

    return run


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(size / ITEM_BYTES))
    for b in range(n):
        yield [(r.item_id, r.text) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).collect()]


def find_contamination(docs: DataFrame, items: DataFrame, *, k: int = 5, threshold: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, containment) of every item that a document contains to the threshold at least."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = None
    for block in _blocks(items.select(F.col("item_id").cast("long").alias("item_id"), "text")):
        part = rows.mapInArrow(tidy(_search(spark.sparkContext.broadcast(block), k, threshold)), "doc_id long, item_id long, containment double")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("doc_id", "item_id").agg(F.max("containment").alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame, *, k: int = 5, threshold: float = 0.8, text: str = "text") -> DataFrame:
    """docs without the rows that contain an item; one pass over docs for each block of items, no shuffle."""
    spark = docs.sparkSession
    ship(spark)
    for block in _blocks(items.select(F.col("item_id").cast("long").alias("item_id"), "text")):
        docs = docs.mapInArrow(tidy(_clean(spark.sparkContext.broadcast(block), k, threshold, text)), docs.schema)
    return docs
