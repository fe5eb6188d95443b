import pytest

from logloom.functions import codecs
from logloom.operators import generations, state
from logloom.operators.generations import Store
from logloom.sources import files


def df(spark, rows):
    return spark.createDataFrame(rows, "seq long, op string, key string, value binary")


def amp(rounds=10, keys=50):
    return [(r * keys + k + 1, "PUT", f"amp-{k:010d}", bytearray(100)) for r in range(rounds) for k in range(keys)]


def test_compaction_amplification_to_the_byte(spark):
    log = df(spark, amp())
    cut = generations.flush_segments(log.selectExpr("*", "'one' AS log_id"), "log_id", 2048)
    seg = {r.seq: r.segment for r in cut.collect()}
    assert max(seg.values()) + 1 == 28
    tables, blooms = 0, 0
    for s in range(28):
        rows = sorted((k, "VALUE", bytes(v)) for q, _, k, v in amp() if seg[q] == s)
        tables += len(codecs.encode_table(rows, 1))
        blooms += len(codecs.encode_bloom(codecs.bloom_for([r[0] for r in rows])))
    assert (tables, blooms) == (66_172, 1_456)
    last = sorted((f"amp-{k:010d}", "VALUE", bytes(100)) for k in range(50))
    assert len(codecs.encode_table(last, 1)) == 6_574
    assert len(codecs.encode_bloom(codecs.bloom_for([r[0] for r in last]))) == 92
    assert round(tables / (500 * 114), 6) == 1.160912


def test_catalog_counts_the_same_bytes(spark):
    gens = generations.by_count(df(spark, amp(1)), 50)
    r = generations.catalog(gens).first()
    assert (r.entries, r.data_bytes, r.bloom_bytes, r.watermark) == (50, 6_574, 92, 50)


def test_schedule(spark):
    for trigger in (2, 3, 4, 7):
        tables, compacts = 0, []
        for k in range(1, 30):
            tables += 1
            if tables >= trigger:
                compacts.append(k)
                tables = 1
        got = spark.range(1, 30).where(generations.compaction_after(__import__("pyspark").sql.functions.col("id"), trigger)).collect()
        assert [r.id for r in got] == compacts


def test_store_reads_merges_and_survives_leftovers(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.read() is None and store.next_seq() == 1
    store.flush(df(spark, [(1, "PUT", "a", bytearray(b"first")), (2, "PUT", "gone", bytearray(b"v"))]))
    store.flush(df(spark, [(1, "PUT", "a", bytearray(b"again")), (3, "DELETE", "gone", None), (4, "PUT", "a", bytearray(b"second"))]))
    assert {r.key: bytes(r.value) for r in store.read().collect()} == {"a": b"second"}
    (tmp_path / "s" / "data" / "orphan").mkdir()
    store.compact()
    assert len(store.manifest()["generations"]) == 1 and store.generations().count() == 1
    store.flush(df(spark, [(5, "DELETE", "a", None)]))
    store.compact()
    assert store.manifest()["generations"] == [] and store.next_seq() == 6


def test_snapshots_need_an_empty_store(spark, tmp_path):
    rows = spark.createDataFrame([("k", bytearray(b"v"))], "key string, value binary")
    a = Store(spark, str(tmp_path / "a"))
    assert a.load_snapshot(rows, 5)["watermark"] == 5 and a.next_seq() == 6
    with pytest.raises(ValueError):
        a.load_snapshot(rows, 6)
    b = Store(spark, str(tmp_path / "b"))
    with pytest.raises(ValueError):
        b.load_snapshot(rows, -1)
    assert b.load_snapshot(rows.limit(0), 5)["generations"] == [] and b.next_seq() == 6


def test_merge_equals_compaction_equals_replay(spark, sf):
    from logloom.operators.log import events_log

    log = events_log(spark.read.parquet(f"{sf}/events.parquet"))
    gens = generations.by_count(log, 100)
    want = sorted((r.key, r.value) for r in state.live_state(log).collect())
    assert sorted((r.key, r.value) for r in generations.merge(gens).collect()) == want
    images = files.encoded_tables(gens.withColumn("value", gens["value"].cast("binary"))).collect()
    state_ = {}
    for r in sorted(images, key=lambda r: r.gen_id):
        for k, kind, v in codecs.decode_table(bytes(r.table)):
            state_[k] = v if kind == "VALUE" else None
    assert sorted((k, v.decode()) for k, v in state_.items() if v is not None) == want


def test_resync_replaces_everything_at_once(spark, tmp_path):
    s = Store(spark, str(tmp_path / "r"))
    s.flush(df(spark, [(1, "PUT", "old", bytearray(b"1"))]))
    s.resync(spark.createDataFrame([("new", bytearray(b"2"))], "key string, value binary"), 40)
    assert {r.key for r in s.read().collect()} == {"new"} and s.next_seq() == 41
    assert [r.seq for r in s.tail(df(spark, [(40, "PUT", "a", bytearray(b"")), (41, "PUT", "b", bytearray(b""))])).collect()] == [41]
