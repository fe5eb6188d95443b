import datetime as dt

from logloom.operators.generations import Store
from logloom.streaming import live


def drain(query):
    query.processAllAvailable()
    query.stop()


def test_replication_stream_refuses_gaps_and_goes_on_after_a_restart(spark, tmp_path):
    def write(name, rows):
        spark.createDataFrame(rows, "follower string, arrival long, seq long").coalesce(1).write.parquet(f"{tmp_path}/in/{name}")

    def run():
        rows = spark.readStream.schema("follower string, arrival long, seq long").option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        drain(live.apply_replicated(rows).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").start())

    write("a", [("f", 0, 1), ("f", 1, 3), ("f", 2, 2), ("g", 0, 1)])
    run()
    write("b", [("f", 3, 3), ("f", 4, 2), ("g", 1, 2)])
    run()
    got = {(r.follower, r.arrival): r.outcome for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {("f", 0): "APPLIED", ("f", 1): "GAP_DETECTED", ("f", 2): "APPLIED", ("g", 0): "APPLIED", ("f", 3): "APPLIED", ("f", 4): "ALREADY_APPLIED", ("g", 1): "APPLIED"}


def test_live_store_equals_replay(spark, tmp_path):
    schema = "seq long, op string, key string, value binary"
    for i in range(5):
        rows = [(i * 10 + j + 1, "DELETE" if (i + j) % 4 == 0 else "PUT", f"k{j % 3}", None if (i + j) % 4 == 0 else bytearray(f"{i}-{j}".encode())) for j in range(10)]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    store = Store(spark, f"{tmp_path}/store")
    rows = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    drain(live.keep_store(rows, store, f"{tmp_path}/cp").start())
    from logloom.operators.state import live_state

    want = sorted((r.key, bytes(r.value)) for r in live_state(spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")).collect())
    assert sorted((r.key, bytes(r.value)) for r in store.read().collect()) == want


def test_heartbeat_timers(spark, tmp_path):
    t0 = dt.datetime(2026, 1, 1)
    batches = [[("n", 0), ("m", 0)], [("m", 15)], [("m", 16)], [("m", 40)], [("m", 41)], [("m", 42)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame([(n, t0 + dt.timedelta(seconds=s)) for n, s in rows], "node string, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    rows = spark.readStream.schema("node string, ts timestamp").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    drain(live.watch_heartbeats(rows, 10_000, 30_000).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").start())
    got = [(r.node, r.state) for r in spark.read.parquet(f"{tmp_path}/out").where("node = 'n'").orderBy("at").collect()]
    assert got == [("n", "SUSPECT"), ("n", "DEAD")]
