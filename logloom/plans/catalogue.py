"""The queries over the shared tables, each beside its SQL.

The event table is a log: sequence number event_id + 1, key user-<user_id>, a
DELETE for an error, else a PUT of props. Generations are runs of 1000 numbers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions import bloom, codecs
from logloom.operators import generations, leadership, log, measures, membership, replication, ring, shell, state
from logloom.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

LOG_SQL = """log AS (
  SELECT event_id + 1 AS seq, 'user-' || user_id AS key, CASE WHEN event_type = 'error' THEN 'DELETE' ELSE 'PUT' END AS op,
         CASE WHEN event_type = 'error' THEN NULL ELSE props END AS value
  FROM events)"""
WINNERS_SQL = f"{LOG_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM log), winners AS (SELECT key, op, value, seq FROM ranked WHERE rn = 1)"
LIVE_SQL = f"{WINNERS_SQL}, live AS (SELECT key, value, seq FROM winners WHERE op = 'PUT')"
CUT = 5000
GEN = 1000
NODES, MORE = ["node-a", "node-b", "node-c"], ["node-a", "node-b", "node-c", "node-d"]
MINUTE = 60_000_000


def query(sql: str | None = None, name: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLE_SQL[key] = sql
        return f

    return register


def _log(spark: SparkSession, sf: str) -> DataFrame:
    return log.events_log(table(spark, sf, "events"))


# ---- state ----


@query(f"WITH {LIVE_SQL} SELECT * FROM live")
def live_state(spark, sf):
    return state.live_state(_log(spark, sf))


@query(f"WITH {WINNERS_SQL} SELECT * FROM winners")
def state_with_tombstones(spark, sf):
    return state.winners(_log(spark, sf))


@query(f"WITH {LIVE_SQL.replace('FROM log)', f'FROM log WHERE seq <= {CUT})')} SELECT * FROM live")
def state_as_of(spark, sf):
    return state.state_as_of(_log(spark, sf), CUT)


@query("""SELECT 'customer-' || o_custkey AS key, arg_max(o_orderpriority, o_orderkey) AS value, max(o_orderkey) + 1 AS seq
FROM orders GROUP BY o_custkey HAVING arg_max(o_orderstatus, o_orderkey) <> 'F'""")
def live_state_orders(spark, sf):
    return state.live_state(log.orders_log(table(spark, sf, "orders")))


@query("SELECT 'conversation-' || conv_id AS key, arg_max(text, turn) AS value, max(turn)::BIGINT AS seq FROM conversations GROUP BY conv_id")
def live_state_conversations(spark, sf):
    return state.live_state(log.conversations_log(table(spark, sf, "conversations")))


@query(f"WITH {LIVE_SQL} SELECT * FROM live WHERE key = 'user-7'")
def get_key(spark, sf):
    return state.get(_log(spark, sf), "user-7")


ASKED = ["user-1", "user-7", "user-42", "user-absent"]


@query(f"WITH {LIVE_SQL} SELECT a.key, l.value FROM (SELECT unnest({ASKED!r}) AS key) a LEFT JOIN live l USING (key)")
def multi_get(spark, sf):
    return state.multi_get(_log(spark, sf), ASKED)


@query(f"WITH {LIVE_SQL} SELECT a.key, l.value FROM (SELECT DISTINCT 'user-' || c_custkey AS key FROM customer) a LEFT JOIN live l USING (key)")
def multi_get_table(spark, sf):
    keys = table(spark, sf, "customer").select(F.concat(F.lit("user-"), F.col("c_custkey").cast("string")).alias("key")).distinct()
    return state.multi_get(_log(spark, sf), keys)


@query(f"WITH {LIVE_SQL} SELECT key FROM live")
def live_keys(spark, sf):
    return state.live_keys(_log(spark, sf))


@query(f"WITH {WINNERS_SQL} SELECT key, seq FROM winners WHERE op = 'DELETE'")
def deleted_keys(spark, sf):
    return state.deleted_keys(_log(spark, sf))


@query(f"WITH {LOG_SQL} SELECT seq, key, op, lag(value) OVER (PARTITION BY key ORDER BY seq) AS previous FROM log")
def previous_value(spark, sf):
    return state.previous_value(_log(spark, sf))


OUTCOME_SQL = f"""WITH {LOG_SQL}, p AS (SELECT *, coalesce(lag(op) OVER (PARTITION BY key ORDER BY seq) = 'PUT', false) AS was FROM log)
SELECT seq, key, op, CASE WHEN op = 'PUT' THEN CASE WHEN was THEN 'OK (previous value replaced)' ELSE 'OK' END
  ELSE CASE WHEN was THEN 'OK (removed)' ELSE 'OK (not found)' END END AS outcome FROM p"""


@query(f"SELECT * FROM ({OUTCOME_SQL}) WHERE op = 'PUT'")
def put_outcome(spark, sf):
    return state.outcomes(_log(spark, sf)).where("op = 'PUT'")


@query(f"SELECT * FROM ({OUTCOME_SQL}) WHERE op = 'DELETE'")
def delete_outcome(spark, sf):
    return state.outcomes(_log(spark, sf)).where("op = 'DELETE'")


@query(f"WITH {LOG_SQL} SELECT key, row_number() OVER w AS version, seq, op, lead(seq) OVER w AS valid_to FROM log WINDOW w AS (PARTITION BY key ORDER BY seq)")
def key_history(spark, sf):
    return state.history(_log(spark, sf))


@query(f"WITH {LOG_SQL} SELECT key, count(*) FILTER (op = 'PUT') AS puts, count(*) FILTER (op = 'DELETE') AS deletes, max(seq) AS last_seq FROM log GROUP BY key")
def mutation_counts(spark, sf):
    return state.mutation_counts(_log(spark, sf))


@query("SELECT max(event_id) + 2 AS next_seq FROM events")
def next_sequence(spark, sf):
    return log.next_sequence(_log(spark, sf))


@query(f"SELECT max(event_id // {GEN} * {GEN} + {GEN}) FILTER (event_id % {GEN} = {GEN - 1}) AS watermark FROM events")
def watermark(spark, sf):
    full = _log(spark, sf).where(f"seq % {GEN} = 0")
    return full.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("watermark"))


# ---- generations ----

GENS_SQL = f"""{LOG_SQL}, byrank AS (SELECT *, (seq - 1) // {GEN} AS gen_id, row_number() OVER (PARTITION BY (seq - 1) // {GEN}, key ORDER BY seq DESC) AS rn FROM log),
gens AS (SELECT gen_id, key, CASE op WHEN 'PUT' THEN 'VALUE' ELSE 'TOMBSTONE' END AS kind, value, seq FROM byrank WHERE rn = 1)"""
CATALOG_SQL = f"""{GENS_SQL}, cat AS (SELECT gen_id, count(*) AS entries, count(*) FILTER (kind = 'TOMBSTONE') AS tombstones, max(seq) AS watermark,
  (sum(17 + strlen(key) + coalesce(strlen(value), 0)) + 24)::BIGINT AS data_bytes FROM gens GROUP BY gen_id),
catalog AS (SELECT *, (ceil(greatest(ceil(-entries * ln(0.01) / (ln(2.0) * ln(2.0))), 8) / 64) * 8 + 28)::BIGINT AS bloom_bytes FROM cat)"""
MERGED_SQL = f"{GENS_SQL}, newest AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY gen_id DESC) AS nr FROM gens), merged AS (SELECT key, kind, value, gen_id FROM newest WHERE nr = 1)"


def _gens(spark, sf):
    return generations.by_count(_log(spark, sf), GEN)


@query(f"WITH {GENS_SQL} SELECT * FROM gens")
def generation_winners(spark, sf):
    return _gens(spark, sf)


@query(f"WITH {CATALOG_SQL} SELECT * FROM catalog")
def generation_catalog(spark, sf):
    return generations.catalog(_gens(spark, sf))


@query(f"WITH {MERGED_SQL} SELECT key, value FROM merged WHERE kind = 'VALUE'")
def merge_on_read(spark, sf):
    return generations.merge(_gens(spark, sf)).select("key", "value")


@query(f"WITH {MERGED_SQL} SELECT * FROM merged WHERE kind = 'VALUE'")
def compact_full(spark, sf):
    return generations.merge(_gens(spark, sf))


@query(f"WITH {MERGED_SQL} SELECT * FROM merged")
def compact_keep_tombstones(spark, sf):
    return generations.merge(_gens(spark, sf), keep_tombstones=True)


@query(f"WITH {LOG_SQL} SELECT * FROM log WHERE seq > {CUT}")
def wal_after_truncate(spark, sf):
    return log.truncate(_log(spark, sf), CUT)


@query(f"WITH {LIVE_SQL} SELECT key, value FROM live")
def recovery_replay(spark, sf):
    rows = _log(spark, sf)
    return replication.bootstrap(replication.snapshot(rows, CUT), rows, CUT)


@query(f"""WITH {CATALOG_SQL}, active AS (SELECT key, value FROM gens WHERE gen_id = (SELECT max(gen_id) FROM gens))
SELECT (SELECT count(*) - 1 FROM catalog) AS tables, (SELECT sum(data_bytes)::BIGINT FROM catalog WHERE gen_id < (SELECT max(gen_id) FROM catalog)) AS table_bytes,
  (SELECT sum(strlen(key) + coalesce(strlen(value), 0))::BIGINT FROM active) AS active_bytes, (SELECT max(seq) + 1 FROM log) AS next_seq""")
def store_status(spark, sf):
    gens = _gens(spark, sf)
    top = gens.agg(F.max("gen_id").alias("top"))
    cat = generations.catalog(gens).crossJoin(F.broadcast(top)).where("gen_id < top").agg(F.count(F.lit(1)).alias("tables"), F.sum("data_bytes").alias("table_bytes"))
    active = generations.memtable_bytes(gens.crossJoin(F.broadcast(top)).where("gen_id = top")).select(F.col("bytes").cast("long").alias("active_bytes"))
    return cat.crossJoin(active).crossJoin(log.next_sequence(_log(spark, sf)))


@query(f"WITH {CATALOG_SQL} SELECT gen_id, data_bytes, data_bytes - 24 - 17 * entries AS payload_bytes, (24 + 17 * entries)::DOUBLE / data_bytes AS overhead FROM catalog")
def storage_overhead(spark, sf):
    c = generations.catalog(_gens(spark, sf))
    return c.select("gen_id", "data_bytes", (F.col("data_bytes") - 24 - 17 * F.col("entries")).alias("payload_bytes"), ((24 + 17 * F.col("entries")).cast("double") / F.col("data_bytes")).alias("overhead"))


@query(f"""WITH {CATALOG_SQL} SELECT f.flushed_bytes, l.logical_bytes, f.flushed_bytes::DOUBLE / l.logical_bytes AS amplification
FROM (SELECT sum(data_bytes)::BIGINT AS flushed_bytes FROM catalog) f, (SELECT sum(strlen(key) + coalesce(strlen(value), 0))::BIGINT AS logical_bytes FROM log) l""")
def write_amplification(spark, sf):
    f = generations.catalog(_gens(spark, sf)).agg(F.sum("data_bytes").alias("flushed_bytes"))
    logical = generations.memtable_bytes(_log(spark, sf)).select(F.col("bytes").cast("long").alias("logical_bytes"))
    return f.crossJoin(logical).withColumn("amplification", measures.amplification(F.col("flushed_bytes").cast("double"), F.col("logical_bytes")))


@query(f"""WITH {CATALOG_SQL}, newest AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY gen_id DESC) AS nr FROM gens),
after_ AS (SELECT (sum(17 + strlen(key) + strlen(value)) + 24)::BIGINT AS bytes_after, count(*) AS entries_after FROM newest WHERE nr = 1 AND kind = 'VALUE'),
before_ AS (SELECT sum(data_bytes)::BIGINT AS bytes_before, sum(entries)::BIGINT AS entries_before FROM catalog)
SELECT bytes_before, entries_before, bytes_after, entries_after, bytes_before - bytes_after AS reclaimed FROM before_, after_""")
def compaction_reclaim(spark, sf):
    gens = _gens(spark, sf)
    before = generations.catalog(gens).agg(F.sum("data_bytes").alias("bytes_before"), F.sum("entries").alias("entries_before"))
    after = generations.merge(gens).agg((F.sum(generations.record_bytes()) + 24).cast("long").alias("bytes_after"), F.count(F.lit(1)).alias("entries_after"))
    return before.crossJoin(after).withColumn("reclaimed", F.col("bytes_before") - F.col("bytes_after"))


@query(f"WITH {CATALOG_SQL} SELECT gen_id, gen_id + 1 AS flush, gen_id + 1 >= 4 AND (gen_id + 1 - 4) % 3 = 0 AS compacts FROM catalog")
def compaction_schedule(spark, sf):
    flush = F.col("gen_id") + 1
    return generations.catalog(_gens(spark, sf)).select("gen_id", flush.alias("flush"), generations.compaction_after(flush).alias("compacts"))


@query()
def flush_segments(spark, sf):
    owned = ring.owners(_log(spark, sf), ring.ring(spark, NODES))
    return generations.flush_segments(owned, "owner", 2048)


@query("""WITH r AS (SELECT user_id AS file, event_id AS ordinal, event_id + 1 AS seq, event_id % 997 <> 0 AS intact FROM events),
bad AS (SELECT file, min(ordinal) AS bad FROM r WHERE NOT intact GROUP BY file)
SELECT r.* FROM r LEFT JOIN bad USING (file) WHERE bad IS NULL OR ordinal < bad""")
def valid_prefix(spark, sf):
    e = table(spark, sf, "events")
    r = e.select(F.col("user_id").alias("file"), F.col("event_id").alias("ordinal"), (F.col("event_id") + 1).alias("seq"), (F.col("event_id") % 997 != 0).alias("intact"))
    return log.valid_prefix(r, ["file"])


@query()
def bloom_filter(spark, sf):
    """False positives of a filter over the live keys for keys that aren't there."""
    keys = state.live_keys(_log(spark, sf))
    f = bloom.build(keys, "key", 0.01)
    absent = spark.range(5000).select(F.concat(F.lit("absent-"), F.col("id").cast("string")).alias("key"))
    tested = keys.select("key", F.lit(True).alias("there")).unionByName(absent.select("key", F.lit(False).alias("there")))
    return bloom.test(tested, "key", f).groupBy("there", "might_contain").count()


# ---- ring ----


def _ring_sql(name: str, nodes: list[str]) -> str:
    return f"{name} AS (SELECT node, v::INTEGER AS vnode, substr(sha256(node || '#' || v), 1, 16) AS pos FROM (SELECT unnest({nodes!r}) AS node), range(128) t(v))"


def _owner_sql(name: str, keys: str, ring_name: str) -> str:
    return f"""{name} AS (SELECT k.key, coalesce(r.node, (SELECT arg_min(node, pos) FROM {ring_name})) AS owner
  FROM (SELECT *, substr(sha256(key), 1, 16) AS h FROM {keys}) k ASOF LEFT JOIN {ring_name} r ON k.h <= r.pos)"""


KEYS_SQL = "keys AS (SELECT DISTINCT 'customer-' || o_custkey AS key FROM orders)"


def _keys(spark, sf):
    return table(spark, sf, "orders").select(F.concat(F.lit("customer-"), F.col("o_custkey").cast("string")).alias("key")).distinct()


@query(f"WITH {_ring_sql('ring', NODES)} SELECT * FROM ring")
def ring_positions(spark, sf):
    return ring.ring(spark, NODES)


@query(f"WITH {_ring_sql('ring', NODES)}, {KEYS_SQL}, {_owner_sql('owned', 'keys', 'ring')} SELECT * FROM owned")
def owner_of(spark, sf):
    return ring.owners(_keys(spark, sf), ring.ring(spark, NODES))


@query(f"WITH {_ring_sql('ring', NODES)}, {KEYS_SQL}, {_owner_sql('owned', 'keys', 'ring')} SELECT owner, count(*) AS keys FROM owned GROUP BY owner")
def keys_per_node(spark, sf):
    return ring.keys_per_node(ring.owners(_keys(spark, sf), ring.ring(spark, NODES)))


def _moved_sql(before: list[str], after: list[str]) -> str:
    return f"""WITH {_ring_sql('r1', before)}, {_ring_sql('r2', after)}, {KEYS_SQL}, {_owner_sql('o1', 'keys', 'r1')}, {_owner_sql('o2', 'keys', 'r2')}
SELECT key, o1.owner AS before, o2.owner AS after FROM o1 JOIN o2 USING (key) WHERE o1.owner <> o2.owner"""


@query(_moved_sql(NODES, MORE))
def moved_keys_add(spark, sf):
    return ring.moved(_keys(spark, sf), ring.ring(spark, NODES), ring.ring(spark, MORE))


@query(_moved_sql(MORE, NODES))
def moved_keys_remove(spark, sf):
    return ring.moved(_keys(spark, sf), ring.ring(spark, MORE), ring.ring(spark, NODES))


@query(f"""WITH {LIVE_SQL}, {_ring_sql('r1', NODES)}, {_ring_sql('r2', MORE)}, {_owner_sql('o1', 'live', 'r1')}, {_owner_sql('o2', 'live', 'r2')},
m AS (SELECT key, o1.owner AS b, o2.owner AS a FROM o1 JOIN o2 USING (key) WHERE o1.owner <> o2.owner)
SELECT a AS node, 'PUT' AS op, key, value, 1 AS step FROM m JOIN live USING (key) UNION ALL SELECT b, 'DELETE', key, NULL, 2 FROM m""")
def migration_log(spark, sf):
    return ring.migration(state.live_state(_log(spark, sf)), ring.ring(spark, NODES), ring.ring(spark, MORE))


ROUTED_SQL = f"WITH {LOG_SQL}, {_ring_sql('ring', NODES)}, keys AS (SELECT DISTINCT key FROM log), {_owner_sql('owned', 'keys', 'ring')}"


@query(f"{ROUTED_SQL} SELECT owner, op, count(*) AS ops FROM log JOIN owned USING (key) GROUP BY owner, op")
def routed_ops(spark, sf):
    return ring.owners(_log(spark, sf), ring.ring(spark, NODES)).groupBy("owner", "op").agg(F.count(F.lit(1)).alias("ops"))


@query(f"{ROUTED_SQL} SELECT seq, key, owner, 6 AS error FROM log JOIN owned USING (key) WHERE owner <> 'node-a'")
def not_owner_errors(spark, sf):
    return ring.gate_ownership(_log(spark, sf), ring.ring(spark, NODES), "node-a").where("error <> 0").select("seq", "key", "owner", "error")


@query("SELECT s_suppkey, 'term=' || s_suppkey || ' leader=' || CASE WHEN s_suppkey % 3 = 0 THEN 'none' ELSE 'node-' || s_suppkey END AS message, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'node-' || s_suppkey END AS redirect FROM supplier")
def leader_redirect(spark, sf):
    k = F.col("s_suppkey").cast("string")
    message = F.concat(F.lit("term="), k, F.lit(" leader="), F.when(F.col("s_suppkey") % 3 == 0, "none").otherwise(F.concat(F.lit("node-"), k)))
    return table(spark, sf, "supplier").select("s_suppkey", message.alias("message")).withColumn("redirect", ring.redirect(F.col("message")))


# ---- replication ----

ARRIVALS_SQL = """arrivals AS (
  SELECT 'follower-' || (event_id % 4) AS follower, event_id * 2 + c AS arrival, event_id // 4 + 1 + CASE WHEN event_id // 4 >= 1500 AND event_id % 4 = 3 THEN 1 ELSE 0 END AS seq
  FROM events, range(2) t(c) WHERE c = 0 OR event_id % 5 = 0)"""
OUTCOMES_SQL = f"""{ARRIVALS_SQL}, t AS (SELECT *, greatest(0, coalesce(max(seq) OVER (PARTITION BY follower ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS top FROM arrivals),
o AS (SELECT follower, arrival, seq, CASE WHEN seq = top + 1 THEN 'APPLIED' WHEN seq <= top THEN 'ALREADY_APPLIED' ELSE 'GAP_DETECTED' END AS outcome FROM t),
g AS (SELECT *, coalesce(count(*) FILTER (outcome = 'GAP_DETECTED') OVER (PARTITION BY follower ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gaps FROM o)"""


def _arrivals(spark, sf):
    e = table(spark, sf, "events")
    rows = e.withColumn("c", F.explode(F.when(F.col("event_id") % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    seq = F.expr("event_id DIV 4 + 1 + CASE WHEN event_id DIV 4 >= 1500 AND event_id % 4 = 3 THEN 1 ELSE 0 END")
    return rows.select(F.concat(F.lit("follower-"), (F.col("event_id") % 4).cast("string")).alias("follower"), (F.col("event_id") * 2 + F.col("c")).alias("arrival"), seq.alias("seq"))


@query(f"WITH {LOG_SQL} SELECT * FROM log WHERE seq >= {CUT}")
def catchup_backlog(spark, sf):
    return replication.backlog(_log(spark, sf), CUT)


@query("SELECT seq FROM (SELECT event_id + 1 AS seq FROM events) WHERE seq % 3 = 0")
def missing_records(spark, sf):
    rows = _log(spark, sf).select("seq")
    return replication.missing(rows, rows.where("seq % 3 <> 0"))


@query("""WITH a AS (SELECT 'follower-' || (user_id % 5) AS follower, event_id AS arrival, event_id - user_id % 7 AS acked FROM events)
SELECT follower, arg_max(acked, arrival) AS acked, (SELECT max(event_id) + 2 FROM events) - arg_max(acked, arrival) AS lag FROM a GROUP BY follower""")
def replica_lag(spark, sf):
    acks = table(spark, sf, "events").select(F.concat(F.lit("follower-"), (F.col("user_id") % 5).cast("string")).alias("follower"), F.col("event_id").alias("arrival"), (F.col("event_id") - F.col("user_id") % 7).alias("acked"))
    return replication.replica_lag(acks, log.next_sequence(_log(spark, sf)))


@query(f"WITH {OUTCOMES_SQL} SELECT follower, arrival, seq, outcome FROM g WHERE gaps = 0")
def replication_outcomes(spark, sf):
    return replication.apply_outcomes(_arrivals(spark, sf))


@query(f"WITH {OUTCOMES_SQL} SELECT follower, arrival, seq FROM g WHERE gaps = 0 AND outcome = 'APPLIED'")
def apply_until_gap(spark, sf):
    return replication.apply_until_gap(_arrivals(spark, sf))


@query(f"WITH {LOG_SQL} SELECT * FROM log")
def dedup_live_tail(spark, sf):
    rows = _log(spark, sf)
    live = rows.where(f"seq > {CUT - 500}")
    return replication.exactly_once(rows.where(f"seq <= {CUT}"), live.unionByName(live.where("seq % 5 = 0")), CUT)


@query(f"WITH {LIVE_SQL.replace('FROM log)', f'FROM log WHERE seq <= {CUT})')} SELECT key, value FROM live")
def snapshot_at(spark, sf):
    return replication.snapshot(_log(spark, sf), CUT)


@query("SELECT 0::BIGINT AS mismatches")
def bootstrap_converges(spark, sf):
    rows = _log(spark, sf)
    a, b = replication.bootstrap(replication.snapshot(rows, CUT), rows, CUT), state.live_state(rows).select("key", "value")
    return a.exceptAll(b).unionByName(b.exceptAll(a)).agg(F.count(F.lit(1)).alias("mismatches"))


@query("SELECT * FROM (SELECT event_id AS arrival, event_id + 1 AS seq, 0 AS copy FROM events UNION ALL SELECT event_id, event_id + 1, 1 FROM events WHERE event_id % 10 = 0) WHERE arrival % 7 <> 0")
def fault_drop_duplicate(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_id").alias("arrival"), (F.col("event_id") + 1).alias("seq"))
    return replication.drop_every(replication.duplicate_every(rows, 10), 7)


# ---- leadership ----


@query("""SELECT o_orderkey, CASE WHEN t > 9223372036 THEN 9223372036854775807 ELSE t * 1000000000 END AS band_start, o_orderkey * 12345678 // 1000000000 AS implied_term
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN 9223372036 + o_orderkey ELSE o_orderkey END AS t FROM orders)""")
def epoch_bands(spark, sf):
    o = table(spark, sf, "orders").withColumn("t", F.when(F.col("o_orderkey") % 50 == 0, F.lit(9223372036) + F.col("o_orderkey")).otherwise(F.col("o_orderkey")))
    return o.select("o_orderkey", leadership.band_start(F.col("t")).alias("band_start"), leadership.implied_term(F.col("o_orderkey") * F.lit(12345678).cast("long")).alias("implied_term"))


@query("SELECT o_orderkey, o_custkey % 2 = 0 AND s > 1 AND s // 1000000000 < 3 AS resync FROM (SELECT *, o_orderkey * 1000000 AS s FROM orders)")
def needs_resync(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", replication.needs_resync(F.col("o_orderkey") * F.lit(1000000).cast("long"), F.lit(3).cast("long"), F.col("o_custkey") % 2 == 0).alias("resync"))


VOTES_SQL = "votes AS (SELECT o_orderkey // 7 AS term, o_custkey % 5 AS voter, 'node-' || (o_custkey % 3) AS candidate FROM orders)"


@query(f"WITH {VOTES_SQL} SELECT term, candidate, count(DISTINCT voter) AS votes FROM votes GROUP BY term, candidate HAVING count(DISTINCT voter) >= 3")
def quorum_winner(spark, sf):
    votes = table(spark, sf, "orders").select(F.expr("o_orderkey DIV 7").alias("term"), (F.col("o_custkey") % 5).alias("voter"), F.concat(F.lit("node-"), (F.col("o_custkey") % 3).cast("string")).alias("candidate"))
    return leadership.election_winners(votes, 5)


@query("""SELECT o_orderkey, (o_orderkey % 4 >= o_custkey % 4) AND (o_orderkey % 4 > o_custkey % 4 OR o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH')
  AND (o_orderkey % 3 > o_custkey % 3 OR (o_orderkey % 3 = o_custkey % 3 AND o_orderkey % 11 >= o_custkey % 11)) AS granted FROM orders""")
def vote_rule(spark, sf):
    o = table(spark, sf, "orders")
    mod = lambda c, n: F.col(c) % n
    free = F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(None)).when(F.col("o_orderpriority") == "2-HIGH", F.lit("me")).otherwise(F.lit("other"))
    granted = leadership.grants_vote(
        mod("o_orderkey", 4), mod("o_custkey", 4), free, F.lit("me"), F.struct(mod("o_orderkey", 3).alias("t"), mod("o_orderkey", 11).alias("i")), F.struct(mod("o_custkey", 3).alias("t"), mod("o_custkey", 11).alias("i"))
    )
    return o.select("o_orderkey", F.coalesce(granted, F.lit(False)).alias("granted"))


COMMIT_SQL = """entries AS (SELECT o_orderkey + 1 AS idx, (o_orderkey // 5000)::BIGINT AS term FROM orders), peers AS (SELECT s_suppkey AS peer, s_suppkey * 97 % 6000 AS match_idx FROM supplier)"""


@query(f"""WITH {COMMIT_SQL} SELECT coalesce(max(idx), 0)::BIGINT AS commit_index FROM entries
WHERE term = 0 AND (1 + (SELECT count(*) FROM peers WHERE match_idx >= idx)) * 2 > (SELECT count(*) + 1 FROM peers)""")
def commit_index(spark, sf):
    entries = table(spark, sf, "orders").select((F.col("o_orderkey") + 1).alias("idx"), F.expr("o_orderkey DIV 5000").alias("term"))
    peers = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("peer"), (F.col("s_suppkey") * 97 % 6000).alias("match_idx"))
    return leadership.commit_index(entries, peers, peers.count() + 1, 0)


LEASE_SQL = "acks AS (SELECT o_custkey % 40 AS term, o_orderkey % 4 AS peer, bool_or(o_orderstatus = 'F' AND o_orderkey % 101 = 0) AS acked_within FROM orders GROUP BY 1, 2), lease AS (SELECT term, count(*) FILTER (acked_within) AS acked FROM acks GROUP BY term)"


def _lease(spark, sf):
    acks = table(spark, sf, "orders").groupBy((F.col("o_custkey") % 40).alias("term"), (F.col("o_orderkey") % 4).alias("peer")).agg(F.bool_or((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 101 == 0)).alias("acked_within"))
    return leadership.lease_valid(acks, 5)


@query(f"WITH {LEASE_SQL} SELECT term, acked, (acked + 1) * 2 > 5 AS lease FROM lease")
def lease_valid(spark, sf):
    return _lease(spark, sf)


@query(f"""WITH {LEASE_SQL}, {LOG_SQL} SELECT seq, op, op = 'GET' OR (key <> 'user-3' AND seq >= 100 AND (acked + 1) * 2 > 5) AS accepted
FROM (SELECT seq, key, CASE WHEN seq % 2 = 0 THEN 'GET' ELSE op END AS op FROM log) l JOIN lease ON seq % 40 = term""")
def write_accepted(spark, sf):
    ops = _log(spark, sf).select("seq", "key", F.when(F.col("seq") % 2 == 0, "GET").otherwise(F.col("op")).alias("op"))
    joined = ops.join(F.broadcast(_lease(spark, sf)), F.col("seq") % 40 == F.col("term"))
    role = F.when(F.col("key") != "user-3", "LEADER").otherwise("FOLLOWER")
    return joined.select("seq", "op", leadership.write_accepted(F.col("op"), leadership.authoritative(role, F.col("seq"), F.lit(100), F.col("lease"))).alias("accepted"))


# ---- membership: users are nodes, events are heartbeats, a tick every 6 hours ----

SUSPECT, DEAD = 12 * 60 * MINUTE, 36 * 60 * MINUTE
TICKS_SQL = "ticks AS (SELECT unnest(generate_series(date_trunc('day', min(ts)), max(ts), INTERVAL 6 HOUR)) AS tick FROM events)"
STATES_SQL = f"""{TICKS_SQL}, nodes AS (SELECT DISTINCT user_id FROM events), dealt AS (SELECT user_id, tick FROM nodes, ticks),
s AS (SELECT 'user-' || d.user_id AS node, d.tick, e.ts AS last_beat, date_diff('microsecond', e.ts, d.tick) AS elapsed_us FROM dealt d ASOF JOIN events e ON d.user_id = e.user_id AND d.tick >= e.ts),
states AS (SELECT *, CASE WHEN elapsed_us >= {DEAD} THEN 'DEAD' WHEN elapsed_us >= {SUSPECT} THEN 'SUSPECT' ELSE 'ALIVE' END AS state FROM s)"""


def _beats(spark, sf):
    e = table(spark, sf, "events").select(F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("node"), "ts")
    joined = e.groupBy("node").agg(F.min("ts").alias("ts")).select("node", "ts", F.lit("JOIN").alias("kind"))
    return e.select("node", "ts", F.lit("BEAT").alias("kind")).unionByName(joined)


def _states(spark, sf):
    ticks = table(spark, sf, "events").agg(F.explode(F.sequence(F.date_trunc("day", F.min("ts")).cast("timestamp_ntz"), F.max("ts"), F.expr("INTERVAL 6 HOURS"))).alias("ts"))
    return membership.at_ticks(_beats(spark, sf), ticks, SUSPECT, DEAD)


@query(f"WITH {STATES_SQL} SELECT * FROM states")
def member_state_at_ticks(spark, sf):
    return _states(spark, sf)


@query(f"""WITH {STATES_SQL}, b AS (SELECT *, CASE WHEN lag(last_beat) OVER w = last_beat THEN lag(state) OVER w ELSE 'ALIVE' END AS previous FROM states WINDOW w AS (PARTITION BY node ORDER BY tick))
SELECT node, tick, previous, state AS current FROM b WHERE previous <> state""")
def member_transitions(spark, sf):
    return membership.transitions(_states(spark, sf))


@query(f"""SELECT 'user-' || user_id AS node, ts AS down_from, up_at FROM (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS up_at FROM events)
WHERE date_diff('microsecond', ts, up_at) >= {DEAD}""")
def outages(spark, sf):
    return membership.outages(_beats(spark, sf).where("kind = 'BEAT'"), DEAD)


# ---- measures ----

STATS_SQL = "count(value) AS n, avg(value) AS avg, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, max(value) AS max"


@query(f"SELECT {STATS_SQL} FROM events")
def latency_stats(spark, sf):
    return measures.latency_stats(table(spark, sf, "events"), "value")


@query(f"SELECT event_type, {STATS_SQL} FROM events GROUP BY event_type")
def latency_by_op(spark, sf):
    return measures.latency_stats(table(spark, sf, "events"), "value", ["event_type"])


@query("""SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS ops, date_diff('microsecond', min(ts), max(ts)) / 1e6 AS seconds,
CASE WHEN min(ts) < max(ts) THEN count(*) / (date_diff('microsecond', min(ts), max(ts)) / 1e6) END AS ops_per_sec FROM events GROUP BY 1""")
def throughput_by_day(spark, sf):
    e = table(spark, sf, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return measures.throughput(e, "ts", "ts", ["day"])


FAILOVER_SQL = "CASE event_type WHEN 'error' THEN 'KILLED' WHEN 'signup' THEN 'ELECTED' WHEN 'view' THEN 'READY' WHEN 'purchase' THEN 'FIRST_WRITE' ELSE 'OTHER' END"


@query(f"""WITH t AS (SELECT user_id AS run, {FAILOVER_SQL} AS event, ts FROM events), k AS (SELECT run, min(ts) AS killed FROM t WHERE event = 'KILLED' GROUP BY run)
SELECT run, date_diff('microsecond', any_value(killed), min(ts) FILTER (event = 'ELECTED')) / 1e6 AS election_s, date_diff('microsecond', any_value(killed), min(ts) FILTER (event = 'READY')) / 1e6 AS transition_s,
  date_diff('microsecond', any_value(killed), min(ts) FILTER (event = 'FIRST_WRITE')) / 1e6 AS first_write_s FROM t JOIN k USING (run) WHERE ts >= killed GROUP BY run""")
def failover_times(spark, sf):
    return measures.failover(table(spark, sf, "events").select(F.col("user_id").alias("run"), F.expr(FAILOVER_SQL).alias("event"), "ts"))


@query("SELECT i, 'PUT' AS op, printf('w-%010d', i) AS key FROM range(1000) t(i)")
def workload_keys(spark, sf):
    return measures.puts(spark, "w", 1000, 100).select("i", "op", "key")


@query("SELECT i, 'GET' AS op, printf('w-%010d', (i + 17) % 300) AS key FROM range(1000) t(i)")
def workload_gets(spark, sf):
    return measures.round_robin_gets(spark, "w", 1000, 300, 17)


@query("SELECT i, 'DELETE' AS op, printf('w-%010d', i + 40) AS key FROM range(500) t(i)")
def workload_deletes(spark, sf):
    return measures.deletes(spark, "w", 500, 40)


@query("""WITH RECURSIVE r(n, s) AS (SELECT 0, xor(42::BIGINT, 25214903917::BIGINT) UNION ALL SELECT n + 1, ((s::HUGEINT * 25214903917 + 11) % 281474976710656)::BIGINT FROM r WHERE n < 2000),
d AS (SELECT a.n // 2 AS k, ((a.s >> 22) * 134217728 + (b.s >> 21))::DOUBLE / 9007199254740992 AS x FROM r a JOIN r b ON b.n = a.n + 1 WHERE a.n % 2 = 1)
SELECT (a.k // 2)::BIGINT AS i, CASE WHEN b.x < 0.8 THEN 'GET' ELSE 'PUT' END AS op, printf('w-%010d', floor(a.x * 500)::BIGINT) AS key FROM d a JOIN d b ON b.k = a.k + 1 WHERE a.k % 2 = 0""")
def mixed_mix(spark, sf):
    return measures.mixed(spark, "w", 500, 500, 0.8, 42)


@query(f"""WITH {LOG_SQL} SELECT seq, (CASE op WHEN 'PUT' THEN '01' ELSE '02' END) || printf('%016X', seq) || printf('%08X', strlen(key)) || hex(encode(key))
|| printf('%08X', CASE op WHEN 'PUT' THEN strlen(value) ELSE 0 END) || (CASE op WHEN 'PUT' THEN hex(encode(value)) ELSE '' END) AS frame FROM log""")
def replication_frames(spark, sf):
    return _log(spark, sf).select("seq", F.hex(codecs.replication_frame(F.col("seq"), F.col("op"), F.col("key"), F.col("value"))).alias("frame"))


@query(f"""WITH {WINNERS_SQL}, answers AS (SELECT key, CASE op WHEN 'PUT' THEN '0100' ELSE '0000' END AS head, CASE op WHEN 'PUT' THEN value ELSE '' END AS body FROM winners)
SELECT key, printf('%08X', strlen(body) + 6) || head || printf('%08X', strlen(body)) || hex(encode(body)) AS frame FROM answers""")
def response_frames(spark, sf):
    found = state.winners(_log(spark, sf))
    live = F.col("op") == "PUT"
    frame = codecs.response_frame(F.when(live, "PRESENT").otherwise("ABSENT"), F.lit(0), F.when(live, F.col("value")))
    return found.select("key", F.hex(frame).alias("frame"))


@query(f"WITH {LOG_SQL} SELECT seq, key FROM log WHERE key <> 'user-3' AND op = 'PUT'")
def listener_records(spark, sf):
    records = _log(spark, sf).withColumn("origin", F.when(F.col("key") == "user-3", "REPLICATED").otherwise("LOCAL"))
    return replication.fan_out(records).where("op = 'PUT'").select("seq", "key")


@query(f"WITH {LOG_SQL} SELECT min(seq) - 1 AS gap_after, count(*) AS refused FROM log WHERE seq >= 3000")
def partition_gap(spark, sf):
    arrived = replication.partition(_log(spark, sf).withColumn("arrival", F.col("seq")), 2000, 3000)
    return arrived.where("arrival >= 3000").agg((F.min("seq") - 1).alias("gap_after"), F.count(F.lit(1)).alias("refused"))


# ---- text commands: users are sessions ----

COMMANDS_SQL = """script AS (SELECT user_id AS session, event_id AS line_no,
  CASE event_id % 6 WHEN 0 THEN 'put k' || (event_id % 5) || ' ' || event_type || ' x' WHEN 1 THEN 'GET k' || (event_id % 5) WHEN 2 THEN ' delete k' || (event_id % 5) || ' ' WHEN 3 THEN 'PUT k' WHEN 4 THEN '' ELSE 'nope ' || event_type END AS line FROM events)"""


@query(f"""WITH {COMMANDS_SQL}, p AS (SELECT *, CASE event_id_mod WHEN 0 THEN 'PUT' WHEN 1 THEN 'GET' WHEN 2 THEN 'DELETE' END AS c, CASE WHEN event_id_mod < 3 THEN 'k' || (line_no % 5) END AS k FROM (SELECT *, line_no % 6 AS event_id_mod FROM script)),
l AS (SELECT *, last_value(CASE WHEN c IN ('PUT', 'DELETE') THEN line_no END IGNORE NULLS) OVER (PARTITION BY session, k ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS w FROM p)
SELECT l.session, l.line_no, CASE event_id_mod
  WHEN 0 THEN CASE WHEN e.event_id % 6 = 0 THEN 'OK (previous value replaced)' ELSE 'OK' END
  WHEN 1 THEN CASE WHEN e.event_id % 6 = 0 THEN e.event_type || ' x' ELSE '(nil)' END
  WHEN 2 THEN CASE WHEN e.event_id % 6 = 0 THEN 'OK (removed)' ELSE 'OK (not found)' END
  WHEN 3 THEN 'PUT requires a key and a value.' WHEN 4 THEN '' ELSE 'Unknown command: NOPE. Type HELP for a list of commands.' END AS answer
FROM l LEFT JOIN events e ON l.w = e.event_id""")
def repl_transcript(spark, sf):
    n, t = F.col("event_id"), F.col("event_type")
    k = (n % 5).cast("string")
    line = (
        F.when(n % 6 == 0, F.concat(F.lit("put k"), k, F.lit(" "), t, F.lit(" x")))
        .when(n % 6 == 1, F.concat(F.lit("GET k"), k))
        .when(n % 6 == 2, F.concat(F.lit(" delete k"), k, F.lit(" ")))
        .when(n % 6 == 3, "PUT k")
        .when(n % 6 == 4, "")
        .otherwise(F.concat(F.lit("nope "), t))
    )
    script = table(spark, sf, "events").select(F.col("user_id").alias("session"), n.alias("line_no"), line.alias("line"))
    return shell.transcript(script, ["session"])
