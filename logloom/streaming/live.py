"""Streams: replicated records applied per follower, heartbeats watched with timers, and live state kept up to date."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from logloom.operators.generations import Store
from logloom.operators.replication import ALREADY, APPLIED, GAP, fan_out


def apply_replicated(arrivals: DataFrame, next_seq: int = 1) -> DataFrame:
    """A stream of (follower, arrival, seq) with outcomes; a gap is refused and changes nothing.

    State is one number for each follower. Rows of one micro-batch are taken in
    order of arrival.
    """

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        want = state.get[0] if state.exists else next_seq
        pdf = pd.concat(list(pdfs)).sort_values("arrival")
        out = []
        for seq in pdf["seq"]:
            out.append(APPLIED if seq == want else ALREADY if seq < want else GAP)
            want += seq == want
        state.update((int(want),))
        yield pd.DataFrame({"follower": key[0], "arrival": pdf["arrival"], "seq": pdf["seq"], "outcome": out})

    return arrivals.select("follower", "arrival", "seq").groupBy("follower").applyInPandasWithState(step, "follower string, arrival long, seq long, outcome string", "next_seq long", "append", GroupStateTimeout.NoTimeout)


def watch_heartbeats(beats: DataFrame, suspect_ms: int, dead_ms: int, watermark: str = "0 seconds") -> DataFrame:
    """A stream of (node, ts) -> (node, state, at): changes of state in event time.

    A timer stands at the next limit; a heartbeat moves it and makes the node
    alive at once, without a record, as in the batch operator.
    """
    if not 0 < suspect_ms <= dead_ms:
        raise ValueError("0 < suspect <= dead is needed")

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last, was = state.get
            now = "DEAD" if was == "SUSPECT" or suspect_ms == dead_ms else "SUSPECT"
            state.update((last, now))
            if now == "SUSPECT":
                state.setTimeoutTimestamp(max(last + dead_ms, state.getCurrentWatermarkMs() + 1))
            yield pd.DataFrame({"node": [key[0]], "state": [now], "at": [pd.Timestamp(last + (dead_ms if now == "DEAD" else suspect_ms), unit="ms")]})
        else:
            newest = max(int(p["ts"].max().timestamp() * 1000) for p in pdfs)
            last = max(newest, state.get[0]) if state.exists else newest
            state.update((last, "ALIVE"))
            state.setTimeoutTimestamp(max(last + suspect_ms, state.getCurrentWatermarkMs() + 1))

    rows = beats.select("node", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", watermark)
    return rows.groupBy("node").applyInPandasWithState(step, "node string, state string, at timestamp", "last long, state string", "append", GroupStateTimeout.EventTimeTimeout)


def keep_store(log: DataFrame, store: Store, checkpoint: str):
    """A writer that flushes each micro-batch of a log stream as a generation and compacts when there are four.

    The manifest holds the number of the last batch, so one that is repeated after
    a failure is skipped, and records that arrive late are not.
    """

    def flush(batch: DataFrame, number: int) -> None:
        done = store.flush(batch, number)
        if len(done["generations"]) >= 4:
            store.compact(keep_tombstones=True)  # a late record may be older than a tombstone

    return log.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint)


def tell_listeners(log: DataFrame, listeners: list, checkpoint: str, failed: list | None = None):
    """A writer that gives each micro-batch of local records to all listeners; one that raises stops neither the others nor the stream.

    failed: gets (listener's number, batch, error) of each that raised.
    """

    def tell(batch: DataFrame, number: int) -> None:
        local = fan_out(batch)
        for i, listener in enumerate(listeners):
            try:
                listener(local, number)
            except Exception as e:  # noqa: BLE001  any error of a listener is its own
                if failed is not None:
                    failed.append((i, number, str(e)))

    return log.writeStream.foreachBatch(tell).option("checkpointLocation", checkpoint)
