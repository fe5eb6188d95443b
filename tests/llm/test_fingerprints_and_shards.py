import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from logloom.llm import ordered_minhash as om
from logloom.llm import sharding

ROWS = [(5, "the quick brown fox jumps over the lazy dog " * 5), (1, None), (9, ""), (3, "a b"), (7, "Shti " * 400), (8, "the quick brown fox jumps over the lazy dog " * 5), (2, "x" * 50_000), (4, "é" * 10)]


def docs(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, "s", "t") for i, t in rows], "doc_id long, text string, _sig string, size string")


def test_edited_texts_and_likeness(spark):
    got = {r.doc_id: r for r in om.fingerprint_documents(docs(spark)).collect()}
    order = sorted((i, t or "") for i, t in ROWS)[::-1]
    for (i, t), (j, nxt) in zip(order, order[1:] + order[:1], strict=True):
        third = len(t) // 3
        edited = t[: len(t) - third] + nxt[:third]
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        same = lambda a, b: sum(a[k : k + 8] == b[k : k + 8] for k in range(0, len(a), 8)) / (len(a) // 8)
        assert got[i].near_edited == pytest.approx(same(got[i].fingerprint, got[i].edited_fingerprint))
        assert got[i].near_next == pytest.approx(same(got[i].fingerprint, got[j].fingerprint))
    assert got[5].fingerprint == got[8].fingerprint
    assert got[1].fingerprint == got[9].fingerprint and got[1].near_edited == 1.0


def test_buckets_do_not_change_successors(spark, sf, monkeypatch):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    one = {r.doc_id: r.edited_sha256 for r in om.fingerprint_documents(d).collect()}
    monkeypatch.setattr(om, "BUCKET_ROWS", 7)
    assert {r.doc_id: r.edited_sha256 for r in om.fingerprint_documents(d).collect()} == one


def test_order_and_occurrences_count(spark):
    words = [f"w{i}" for i in range(60)]
    d = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[30:] + words[:30])), (3, " ".join(words[::-1])), (4, " ".join(words[:55]))], "doc_id long, text string")
    sig = {r.doc_id: r.s for r in om.with_signature(d, "text", "s").collect()}
    like = lambda a, b: sum(x == y for x, y in zip(sig[a], sig[b], strict=True)) / len(sig[a])
    assert like(1, 4) > like(1, 2) > like(1, 3) == 0


def test_fingerprints_of_empty_and_repeated_rows(spark):
    assert om.fingerprint_documents(docs(spark).limit(0)).count() == 0
    d = docs(spark, [(1, "a b c d"), (1, "a b c d"), (None, "z")])
    assert om.fingerprint_documents(d).count() == 3


def test_shards(spark):
    rows = [(i, f"t{i % 50}" * (i % 7)) for i in range(3000)] + [(None, None), (5, "again")]
    out = sharding.shard_records(docs(spark, rows), [1.0] * 40, grown=[1.0] * 41).collect()
    assert len(out) == len(rows)
    slots = {}
    for r in out:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 40)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == 40
    text = {(i, (t or "")): (len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows}
    assert sorted((r.size, r.text_crc32) for r in out) == sorted(text[i, t or ""] for i, t in rows)
    assert 30 < sum(r.grown_shard == 40 for r in out) < 130
    again = sharding.shard_records(docs(spark, rows[:10]), [1.0] * 40)
    whole = {r.doc_id: r.shard for r in out}
    assert all(whole[r.doc_id] == r.shard for r in again.collect())
    assert sharding.shard_records(docs(spark, []), [1.0] * 3).count() == 0


def test_weights(spark):
    out = sharding.shard_records(docs(spark, [(i, "") for i in range(4000)]), [1.0, 3.0]).groupBy("shard").count().collect()
    n = {r.shard: r["count"] for r in out}
    assert 2800 < n[1] < 3200


def test_every_entry_ranks_all_numbered_kmers(spark):
    r = random.Random(5)
    texts = [" ".join(r.choice("a b c d e f g h".split()) for _ in range(n)) for n in (300, 40)] + [" ".join(f"w{r.randrange(900)}" for _ in range(2000)), "x y", "", "Shti " * 200]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {x.doc_id: list(x.s) for x in om.with_signature(d, "text", "s").collect()}
    kmers = [(i, at, *[w[at + j] if at + j < len(w) else None for j in range(om.K)]) for i, t in enumerate(texts) for w in [om_words(t)] for at in range(len(w))]
    rows = spark.createDataFrame(kmers, "doc_id int, at int, a string, b string, c string").select("doc_id", "at", F.xxhash64("a", "b", "c").alias("x"))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "x").orderBy("at")) - 1)
    rows = rows.select("doc_id", "at", F.when(F.col("n") == 0, F.col("x")).otherwise(F.xxhash64("x", "n")).alias("key"))
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(1), F.lit(om.ENTRIES))))
    first = rows.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id", "j").orderBy(F.xxhash64("key", "j")))).where(F.col("rank") <= om.TUPLE)
    entries = first.groupBy("doc_id", "j").agg(F.sort_array(F.collect_list(F.struct("at", "key"))).alias("o")).select("doc_id", "j", F.shiftright(F.xxhash64("o.key"), 32).cast("int").alias("e"))
    want = {}
    for x in entries.orderBy("doc_id", "j").collect():
        want.setdefault(x.doc_id, []).append(x.e)
    assert got == want


def om_words(text):
    return re.split(r"[\x20\x09-\x0D]+", text)


def test_the_winning_shard_is_recomputed(spark):
    import math
    import struct

    import xxhash

    from logloom.llm import sharding

    def winner(key, weights):
        def score(i, w):
            h = xxhash.xxh64_intdigest(struct.pack("<i", i), xxhash.xxh64_intdigest(struct.pack("<q", key), 42))
            return -w / math.log(((h >> 12) + 0.5) / 2**52), i

        return max(score(i, w) for i, w in enumerate(weights))[1]

    ids, weights = [0, 1, -5, 2**40, *range(100, 400)], [1.0, 2.0, 0.5, 1.0, 1.0]
    docs = spark.createDataFrame([(i, "t") for i in ids], "doc_id long, text string")
    rows = sharding.shard_records(docs, weights, grown=[*weights, 1.0]).collect()
    assert {r.doc_id: (r.shard, r.grown_shard) for r in rows} == {i: (winner(i, weights), winner(i, [*weights, 1.0])) for i in ids}
