import datetime as dt

import pytest
from pyspark.sql import functions as F

from logloom.operators import leadership, measures, membership, replication, ring, shell
from logloom.schema import MAX_LONG


def keys(spark, prefix, n):
    return spark.range(n).select(F.concat(F.lit(prefix), F.col("id").cast("string")).alias("key"))


def test_ring_spreads_and_moves_little(spark):
    r3 = ring.ring(spark, ["A", "B", "C"])
    counts = [r["keys"] for r in ring.keys_per_node(ring.owners(keys(spark, "distribution-key-", 3000), r3)).collect()]
    assert sum(counts) == 3000 and all(500 <= c <= 2000 for c in counts)
    add = ring.moved(keys(spark, "movement-key-", 2000), ring.ring(spark, ["A", "B"]), r3).collect()
    assert 0 < len(add) < 1500 and {r.after for r in add} == {"C"}
    gone = ring.moved(keys(spark, "removal-key-", 2000), r3, ring.ring(spark, ["A", "B"])).collect()
    assert gone and {r.before for r in gone} == {"C"}


def test_owner_by_definition(spark):
    import bisect
    import hashlib

    pos = sorted((hashlib.sha256(f"{n}#{v}".encode()).hexdigest()[:16], n) for n in "AB" for v in range(128))
    want = {}
    for i in range(500):
        h = hashlib.sha256(f"k{i}".encode()).hexdigest()[:16]
        want[f"k{i}"] = pos[bisect.bisect_left(pos, (h, "")) % len(pos)][1]
    assert {r.key: r.owner for r in ring.owners(keys(spark, "k", 500), ring.ring(spark, ["A", "B"])).collect()} == want
    with pytest.raises(ValueError):
        ring.owners(keys(spark, "k", 1), ring.ring(spark, ["A"]).limit(0))


def arrivals(spark, seqs):
    return spark.createDataFrame([("f", i, s) for i, s in enumerate(seqs)], "follower string, arrival long, seq long")


@pytest.mark.parametrize(("seqs", "want"), [([1, 1], ["APPLIED", "ALREADY_APPLIED"]), ([5], ["GAP_DETECTED"]), ([1, 2, 4, 3], ["APPLIED", "APPLIED", "GAP_DETECTED"]), ([], [])])
def test_replicated_outcomes(spark, seqs, want):
    assert [r.outcome for r in replication.apply_outcomes(arrivals(spark, seqs)).orderBy("arrival").collect()] == want


def test_faults_and_resync(spark):
    a = arrivals(spark, range(1, 21))
    assert replication.drop_every(a, 5).count() == 16
    assert replication.duplicate_every(a, 5).count() == 24
    assert replication.delay_every(a, 5, 3).where("arrival <> seq - 1").count() == 4
    row = spark.range(1).select(
        replication.needs_resync(F.lit(5), F.lit(2), F.lit(True)).alias("a"),
        replication.needs_resync(F.lit(1), F.lit(2), F.lit(True)).alias("b"),
        replication.needs_resync(F.lit(2_000_000_005), F.lit(2), F.lit(True)).alias("c"),
        replication.follow_action(F.lit("me"), F.lit(1), F.lit("me"), F.lit(None), F.lit(None), F.lit(1), F.lit(True)).alias("stop"),
        replication.follow_action(F.lit("x"), F.lit(1), F.lit("me"), F.lit("x"), F.lit(1), F.lit(9), F.lit(False)).alias("keep"),
    ).first()
    assert (row.a, row.b, row.c, row.stop, row.keep) == (True, False, False, "STOP", "KEEP")


def beats(spark, *events):
    t0 = dt.datetime(2026, 1, 1)
    return spark.createDataFrame([(n, t0 + dt.timedelta(seconds=s), k) for n, s, k in events], "node string, ts timestamp_ntz, kind string")


def ticks(spark, *seconds):
    return spark.createDataFrame([(dt.datetime(2026, 1, 1) + dt.timedelta(seconds=s),) for s in seconds], "ts timestamp_ntz")


@pytest.mark.parametrize(
    ("events", "at", "want"),
    [
        ([("n", 0, "JOIN")], [10], [("ALIVE", "SUSPECT")]),
        ([("n", 0, "JOIN")], [29], [("ALIVE", "SUSPECT")]),
        ([("n", 0, "JOIN")], [31], [("ALIVE", "DEAD")]),
        ([("n", 0, "JOIN")], [5, 11, 31], [("ALIVE", "SUSPECT"), ("SUSPECT", "DEAD")]),
        ([("n", 0, "JOIN"), ("n", 32, "BEAT")], [31, 33], [("ALIVE", "DEAD")]),
        ([("n", 0, "JOIN"), ("n", 12, "BEAT")], [11, 23], [("ALIVE", "SUSPECT"), ("ALIVE", "SUSPECT")]),
        ([("n", 0, "BEAT")], [40], []),
        ([("n", 0, "JOIN"), ("n", 5, "LEAVE")], [40], []),
    ],
)
def test_liveness(spark, events, at, want):
    s = 1_000_000
    out = membership.transitions(membership.at_ticks(beats(spark, *events), ticks(spark, *at), 10 * s, 30 * s))
    assert [(r.previous, r.current) for r in out.orderBy("tick").collect()] == want


def test_liveness_limits():
    with pytest.raises(ValueError):
        membership.state(F.lit(1), 0, 5)


def test_epochs(spark):
    d = spark.createDataFrame([(t,) for t in (0, 1, 5, MAX_LONG // 10**9 + 1000)], "t long").select(leadership.band_start(F.col("t")).alias("b"))
    assert sorted(r.b for r in d.collect()) == [0, 10**9, 5 * 10**9, MAX_LONG]
    e = spark.range(50).select(leadership.implied_term(F.col("id") * 10**9).alias("a"), leadership.implied_term(F.col("id") * 10**9 + 999_999_999).alias("b"), "id")
    assert e.where("a <> id OR b <> id").count() == 0
    with pytest.raises(Exception, match="negative"):
        spark.range(1).select(leadership.band_start(F.lit(-1))).collect()


def test_elections_commit_and_lease(spark):
    votes = spark.createDataFrame([(1, "a", "x"), (1, "b", "x"), (1, "c", "y"), (2, "a", "x"), (2, "b", "y"), (1, "a", "x")], "term long, voter string, candidate string")
    assert [(r.term, r.candidate) for r in leadership.election_winners(votes, 3).collect()] == [(1, "x")]
    entries = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "idx long, term long")
    match = lambda *m: spark.createDataFrame([(f"p{i}", x) for i, x in enumerate(m)], "peer string, match_idx long")
    assert leadership.commit_index(entries, match(2, 0), 3, 1).first()[0] == 2
    assert leadership.commit_index(entries, match(2, 0), 3, 2).first()[0] == 0
    assert leadership.commit_index(entries, match(3, 0), 3, 2).first()[0] == 3
    acks = spark.createDataFrame([(1, "p", True), (1, "q", False), (2, "p", False), (2, "q", False)], "term long, peer string, acked_within boolean")
    assert {r.term: r.lease for r in leadership.lease_valid(acks, 3).collect()} == {1: True, 2: False}


def test_log_repair(spark):
    log = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "idx long, term long")
    req = spark.createDataFrame([(3, 2), (4, 2)], "idx long, term long")
    got = leadership.append_entries(log, req, 2, 1)
    assert sorted((r.idx, r.term) for r in got.collect()) == [(1, 1), (2, 1), (3, 2), (4, 2)]
    assert leadership.append_entries(log, req, 2, 9).count() == 3


def test_latency_by_nearest_rank(spark):
    r = measures.latency_stats(spark.range(1, 1001).select(F.col("id").alias("x")), "x").first()
    assert (r["n"], r["avg"], r.p50, r.p95, r.p99, r["max"]) == (1000, 500.5, 500, 950, 990, 1000)
    r = measures.latency_stats(spark.createDataFrame([(40,), (10,), (30,), (20,)], "x long"), "x").first()
    assert (r["avg"], r.p50, r.p95, r.p99) == (25, 20, 40, 40)
    assert measures.latency_stats(spark.range(0).select(F.col("id").alias("x")), "x").count() == 0


def test_workloads(spark):
    p = measures.puts(spark, "amp", 3, 300).orderBy("i").collect()
    assert [r.key for r in p] == ["amp-0000000000", "amp-0000000001", "amp-0000000002"]
    assert bytes(p[0].value) == bytes(i % 256 for i in range(300))
    reads = measures.mixed(spark, "w", 5000, 10, 0.8, 1).where("op = 'GET'").count()
    assert 3800 < reads < 4200


def test_transcript(spark):
    lines = ["PUT k a b c", "GET k", "DELETE k", "GET k", "DELETE k", "put  k  v ", "PUT k 2", "PUT k", "PUT", "GET", "GET a b", "   ", "nope x", "help", "quit", "GET k"]
    d = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "line_no long, line string")
    got = [r.answer for r in shell.transcript(d.withColumn("s", F.lit(1)), ["s"]).orderBy("line_no").collect()]
    assert got == ["OK", "a b c", "OK (removed)", "(nil)", "OK (not found)", "OK", "OK (previous value replaced)", shell.PUT_USAGE, shell.PUT_USAGE, shell.GET_USAGE, shell.GET_SPACES, "", "Unknown command: NOPE. Type HELP for a list of commands.", shell.HELP, shell.BYE]


def test_ring_edits_and_addresses(spark):
    r = ring.ring(spark, ["A", "B"])
    three = ring.with_node(r, "C")
    assert three.exceptAll(ring.ring(spark, ["A", "B", "C"])).count() == 0 and three.count() == 384
    assert ring.with_node(three, "C").count() == 384
    assert ring.without_node(three, "C").exceptAll(r).count() == 0
    t = spark.createDataFrame([("a", "h1", 1), ("b", "h2", 2)], "node string, host string, port int")
    c = spark.createDataFrame([("b", "h9", 9), ("a", None, None), ("c", "h3", 3)], "node string, host string, port int")
    assert sorted((x.node, x.host) for x in ring.replace_addresses(t, c).collect()) == [("b", "h9"), ("c", "h3")]


def test_reports(spark):
    t0 = dt.datetime(2026, 1, 1)
    rows = [("GET", 1, 0, t0 + dt.timedelta(seconds=i), t0 + dt.timedelta(seconds=i + 1), 1_000_000 * (i + 1)) for i in range(10)]
    d = spark.createDataFrame(rows, "op_type string, concurrency int, run_index int, started timestamp, ended timestamp, latency_ns long")
    out = measures.throughput_report(d, "E1", "baseline", "LOCAL", 5, 100)
    r = out.first()
    assert out.columns == measures.THROUGHPUT_COLUMNS and (r.measured_ops, r.elapsed_seconds, r.throughput_ops_per_sec, r.p50_latency_ms, r.max_latency_ms) == (10, 10.0, 1.0, 5.0, 10.0)
    at = lambda s: t0 + dt.timedelta(seconds=s)
    f = spark.createDataFrame([(1, "ELECTED", at(0)), (1, "KILLED", at(1)), (1, "ELECTED", at(1.5)), (1, "READY", at(2)), (2, "READY", at(3))], "run long, event string, ts timestamp")
    assert [tuple(x) for x in measures.failover(f).collect()] == [(1, 0.5, 1.0, None)]
