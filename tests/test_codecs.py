import numpy as np
import pytest

from logloom.functions import bloom, codecs
from logloom.sources import files

RECORDS = [(1, "PUT", "a", b"1"), (2, "PUT", "", b""), (3, "DELETE", "a", None), (7, "PUT", "é", b"\xff\xfe\x00\x80\x01")]


def test_log_round_trip_and_every_byte_flip():
    data = codecs.encode_log(RECORDS)
    assert [r[2:] for r in codecs.decode_log(data)] == RECORDS
    starts = [r[1] for r in codecs.decode_log(data)]
    for i in range(len(data)):
        broken = bytearray(data)
        broken[i] ^= 0x41
        got = [r[2:] for r in codecs.decode_log(bytes(broken))]
        assert got == RECORDS[: sum(s <= i for s in starts) - 1]
    for n in range(len(data)):
        ends = [*starts[1:], len(data)]
        assert [r[2:] for r in codecs.decode_log(data[:n])] == RECORDS[: sum(e <= n for e in ends)]


def test_log_order_is_checked():
    data = codecs.encode_log([(2, "PUT", "a", b"1"), (2, "PUT", "b", b"1"), (3, "PUT", "c", b"1")])
    assert [r[4] for r in codecs.decode_log(data)] == ["a"]


def test_table_round_trip_and_damage():
    rows = [("a", "VALUE", b"1"), ("b", "VALUE", b""), ("c", "TOMBSTONE", None)]
    data = codecs.encode_table(rows, 3)
    assert list(codecs.decode_table(data)) == rows and codecs.decode_header(data) == (3, 3)
    assert list(codecs.decode_table(codecs.encode_table([], 0))) == []
    for i in range(len(data)):
        broken = bytearray(data)
        broken[i] ^= 0x41
        with pytest.raises(codecs.Corrupt):
            list(codecs.decode_table(bytes(broken)))
    with pytest.raises(ValueError):
        codecs.encode_table([("b", "VALUE", b""), ("a", "VALUE", b"")], 1)


def test_bloom_has_no_false_negatives_and_few_positives():
    f = codecs.bloom_for([f"key-{i}" for i in range(5000)])
    assert f.might_contain([f"key-{i}" for i in range(5000)]).all()
    assert f.might_contain([f"miss-{i}" for i in range(20_000)]).mean() < 0.05
    back = codecs.decode_bloom(codecs.encode_bloom(f))
    assert (back.words == f.words).all() and (back.bits, back.hashes) == (f.bits, f.hashes)
    data = bytearray(codecs.encode_bloom(f))
    for i in (0, 5, 9, 13, 17, 21, 40, len(data) - 1):
        broken = bytearray(data)
        broken[i] ^= 1
        assert codecs.decode_bloom(bytes(broken)) is None
    assert codecs.decode_bloom(b"") is None


def test_bloom_positions_by_definition():
    def one(key, bits, hashes):
        def fnv(data):
            h = bloom.FNV_OFFSET
            for b in data:
                h = (h ^ b) * bloom.FNV_PRIME % 2**64
            return h

        signed = lambda x: x - 2**64 if x >= 2**63 else x
        h1, h2 = fnv(key.encode()), fnv(key.encode() + bytes([bloom.SALT]))
        return [signed((h1 + i * h2) % 2**64) % bits for i in range(hashes)]

    keys = ["", "a", "é", "amp-0000000007", "x" * 100]
    assert np.array_equal(bloom.positions(keys, 480, 7), [one(k, 480, 7) for k in keys])
    assert bloom.shape(50, 0.01) == (480, 7)


def test_frames():
    ok = codecs.encode_request("PUT", "k", b"v")
    assert codecs.classify_frame(ok) == "OK" == codecs.classify_frame(codecs.encode_request("GET", "k"))
    assert codecs.classify_frame(b"\x00\x00\x00\x05\x09\x00\x00\x00\x00") == "UNKNOWN_OPERATION"
    assert codecs.classify_frame(b"\xff\xff\xff\xff") == "OVERSIZED_REQUEST"
    assert codecs.classify_frame(b"\x7f\xff\xff\xff") == "OVERSIZED_REQUEST"
    assert codecs.classify_frame(b"\x00\x00\x00\x02\x01\x00") == "MALFORMED_REQUEST"
    assert codecs.classify_frame(b"\x00\x00\x00\x05\x02\xff\xff\xff\xff") == "MALFORMED_REQUEST"
    assert codecs.classify_frame(b"\x00\x00\x00\x07\x02\x00\x00\x00\x02\xc3\x28") == "MALFORMED_REQUEST"


def test_sources(spark, tmp_path):
    (tmp_path / "a.wal").write_bytes(codecs.encode_log(RECORDS) + b"torn")
    (tmp_path / "b.wal").write_bytes(b"")
    got = files.read_logs(spark, f"{tmp_path}/*.wal").orderBy("ordinal").collect()
    assert [(r.seq, r.op, r.key, None if r.value is None else bytes(r.value)) for r in got] == RECORDS
    (tmp_path / "t.sst").write_bytes(codecs.encode_table([("a", "VALUE", b"1"), ("b", "TOMBSTONE", None)], 9))
    assert sorted((r.key, r.kind, r.watermark) for r in files.read_tables(spark, f"{tmp_path}/*.sst").collect()) == [("a", "VALUE", 9), ("b", "TOMBSTONE", 9)]
    (tmp_path / "bad.sst").write_bytes(b"nonsense")
    with pytest.raises(Exception, match="cut off"):
        files.read_tables(spark, f"{tmp_path}/bad.sst").collect()


def test_cluster_config(spark, tmp_path):
    p = tmp_path / "c.conf"
    p.write_text("# nodes\n\nn1 h 1  2 # first\nn2 h 3 4\n")
    assert sorted(r.id for r in files.read_cluster_config(spark, str(p), ["id", "host", "a", "b"]).collect()) == ["n1", "n2"]
    p.write_text("n1 h 1 2\nn1 h 3 4\n")
    with pytest.raises(ValueError):
        files.read_cluster_config(spark, str(p), ["id", "host", "a", "b"])


def test_frames_as_rows(spark):
    d = spark.createDataFrame([(1, bytearray(codecs.encode_request("GET", "k"))), (2, bytearray(b"")), (3, None), (4, bytearray(b"\xff\xff\xff\xff"))], "id long, payload binary")
    assert {r.id: (r.outcome, r.error) for r in files.classify_frames(d).collect()} == {1: ("OK", 0), 2: ("MALFORMED_REQUEST", 1), 3: ("MALFORMED_REQUEST", 1), 4: ("OVERSIZED_REQUEST", 3)}
