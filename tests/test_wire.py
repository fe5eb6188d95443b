import struct

import pytest
from pyspark.sql import functions as F

from logloom.functions import codecs
from logloom.operators import leadership, measures, replication
from logloom.operators.generations import Store
from logloom.sources import files

LOG = "seq long, op string, key string, value binary"
RECORDS = [(1, "PUT", "a", b"x"), (2, "DELETE", "a", None), (3, "PUT", "ü", b""), (4, "PUT", "b", b"\x00\xff")]


def test_replication_frames_round_trip(spark):
    frames = spark.createDataFrame(RECORDS, LOG).orderBy("seq").select(codecs.replication_frame(F.col("seq"), F.col("op"), F.col("key"), F.col("value")).alias("f")).collect()
    data = b"".join(bytes(r.f) for r in frames)
    assert data[:16] == struct.pack(">bqi", 1, 1, 1) + b"a" + struct.pack(">i", 1)[:2]
    assert list(codecs.decode_replication(data)) == RECORDS
    for cut in (1, 5, 12, len(data) - 1):
        with pytest.raises(ValueError):
            list(codecs.decode_replication(data[:cut]))
    with pytest.raises(ValueError):
        list(codecs.decode_replication(b"\x07" + data[1:]))


def test_requests_and_responses(spark):
    for op, key, value in (("PUT", "k", b"v"), ("PUT", "k", b""), ("GET", "ü", None), ("DELETE", "", None)):
        assert codecs.decode_request(codecs.encode_request(op, key, value)) == (op, key, value)
    with pytest.raises(ValueError, match="UNKNOWN_OPERATION"):
        codecs.decode_request(struct.pack(">ibi", 5, 9, 0))
    rows = [("ABSENT", 0, None), ("PRESENT", 0, b"v"), ("ERROR", 7, b"not leader")]
    df = spark.createDataFrame(rows, "status string, error int, payload binary").coalesce(1)
    got = [bytes(r.f) for r in df.select(codecs.response_frame(F.col("status"), F.col("error"), F.col("payload")).alias("f")).collect()]
    assert [codecs.decode_response(f) for f in got] == [(s, e, p or b"") for s, e, p in rows]
    for bad in (got[1][:-1], got[1] + b"!", b"", struct.pack(">ibbi", 6, 9, 0, 0)):
        with pytest.raises(ValueError):
            codecs.decode_response(bad)


def test_snapshot_stream_is_all_or_nothing():
    data = codecs.encode_snapshot(9, [("a", b"1"), ("ü", b"")])
    assert codecs.decode_snapshot(data) == (9, [("a", b"1"), ("ü", b"")])
    for cut in (3, 8, 14, len(data) - 1):
        with pytest.raises(ValueError):
            codecs.decode_snapshot(data[:cut])


def test_vote_state():
    assert codecs.decode_vote_state(None) == (0, None)
    for state in ((0, None), (7, "node-ü"), (3, "")):
        data = codecs.encode_vote_state(*state)
        assert codecs.decode_vote_state(data) == state
        for i in range(len(data)):
            with pytest.raises(ValueError):
                codecs.decode_vote_state(data[:i] + bytes([data[i] ^ 64]) + data[i + 1 :])


def test_open_log_creates_and_truncates(spark, tmp_path):
    path = str(tmp_path / "wal.log")
    assert files.open_log(spark, path).count() == 0 and (tmp_path / "wal.log").read_bytes() == b""
    good = codecs.encode_log([r for r in RECORDS])
    (tmp_path / "wal.log").write_bytes(good + good[:7])
    (tmp_path / ".wal.log.crc").unlink(missing_ok=True)
    assert [r.seq for r in files.open_log(spark, path).orderBy("seq").collect()] == [1, 2, 3, 4]
    assert (tmp_path / "wal.log").read_bytes() == good


def test_store_get(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.get("a") is None
    store.flush(spark.createDataFrame([(1, "PUT", "a", b"1"), (2, "PUT", "b", b"2")], LOG))
    store.flush(spark.createDataFrame([(3, "DELETE", "a", None), (4, "PUT", "c", b"")], LOG))
    assert [store.get(k) for k in ("a", "b", "c", "d")] == [None, b"2", b"", None]


def test_late_records_of_a_stream_count_and_repeated_batches_do_not(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    rows = lambda *r: spark.createDataFrame(list(r), LOG)
    store.flush(rows((5, "PUT", "a", b"new"), (6, "PUT", "b", b"6")), 0)
    store.flush(rows((2, "PUT", "a", b"old"), (3, "PUT", "c", b"late"), (7, "DELETE", "b", None)), 1)
    want = {"a": b"new", "c": b"late"}
    assert {r.key: bytes(r.value) for r in store.read().collect()} == want and store.get("a") == b"new" and store.next_seq() == 8
    assert store.flush(rows((9, "PUT", "z", b"")), 1)["watermark"] == 7
    store.compact()
    assert {r.key: bytes(r.value) for r in store.read().collect()} == want


def test_append_refusals_and_commit(spark):
    entries = lambda rows: spark.createDataFrame(rows, "idx long, term long")
    log = entries([(1, 1), (2, 1), (3, 2)])
    ask = lambda rows, **k: leadership.handle_append(log, entries(rows), **({"term": 3, "current_term": 2, "prev_idx": 2, "prev_term": 1, "leader_commit": 9, "commit": 1} | k))
    after, said = ask([(3, 3), (4, 3)])
    assert said == {"term": 3, "success": True, "match_idx": 4, "commit": 4}
    assert sorted(map(tuple, after.collect())) == [(1, 1), (2, 1), (3, 3), (4, 3)]
    assert ask([], term=1)[1] == {"term": 2, "success": False, "match_idx": 0, "commit": 1}
    assert ask([(4, 3)], prev_idx=3, prev_term=1)[1] == {"term": 3, "success": False, "match_idx": 3, "commit": 1}
    assert ask([(9, 3)], prev_idx=8, prev_term=3)[1]["success"] is False
    assert ask([], leader_commit=1, commit=2)[1]["commit"] == 2


def test_a_sole_node_has_its_lease(spark):
    acks = spark.createDataFrame([], "term long, peer int, acked_within boolean")
    terms = spark.createDataFrame([(1,), (2,)], "term long")
    assert [r.lease for r in leadership.lease_valid(acks, 1, terms).collect()] == [True, True]
    assert [r.lease for r in leadership.lease_valid(acks, 3, terms).collect()] == [False, False]


def test_seeded_mix_is_the_generators_sequence(spark):
    state, out = (42 ^ 0x5DEECE66D) & (1 << 48) - 1, []

    def bits(n):
        nonlocal state
        state = (state * 0x5DEECE66D + 0xB) & (1 << 48) - 1
        return state >> (48 - n)

    for _ in range(300):
        x, y = ((bits(26) << 27) + bits(27)) / (1 << 53), ((bits(26) << 27) + bits(27)) / (1 << 53)
        out.append(("GET" if y < 0.8 else "PUT", f"w-{int(x * 70):010d}"))
    got = measures.mixed(spark, "w", 300, 70, 0.8, 42).orderBy("i").collect()
    assert [(r.op, r.key) for r in got] == out
    assert abs(spark.range(1).select(measures.lcg_double(42, F.lit(0).cast("long")).alias("x")).first().x - 0.7275636800328681) < 1e-15


def test_partition_heals_and_local_records_fan_out(spark, tmp_path):
    arrivals = spark.range(10).select(F.col("id").alias("arrival"))
    assert [r.arrival for r in replication.partition(arrivals, 3, 6).orderBy("arrival").collect()] == [0, 1, 2, 6, 7, 8, 9]
    from logloom.streaming.live import tell_listeners

    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "a", "LOCAL"), (2, "b", "REPLICATED"), (3, "c", "LOCAL")], "seq long, key string, origin string").write.parquet(src)
    heard, failed = [], []

    def breaks(batch, number):
        raise ValueError("no")

    log = spark.readStream.schema("seq long, key string, origin string").parquet(src)
    q = tell_listeners(log, [breaks, lambda b, n: heard.extend(r.seq for r in b.collect())], str(tmp_path / "cp"), failed).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(heard) == [1, 3] and [f[0] for f in failed] == [0]
