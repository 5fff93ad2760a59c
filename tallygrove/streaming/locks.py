"""Session locks in a stream: one live session a key, held by one client, expiring by event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FIELDS = ("client", "at", "tie")


class SessionLocks(StatefulProcessor):
    """Holds heartbeats until the watermark has passed them, then judges them in the order of time and tie.

    State of a key: its live session (client, expires) and the heartbeats that wait. A timer is set for the earliest heartbeat that waits, as it
    judges all that the watermark has passed, and for the session's end; ends that no heartbeat has put off are put out as expired, once.
    """

    def __init__(self, key: str, key_type: str, ttl: int):
        self.key, self.key_type, self.ttl = key, key_type, ttl * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", "client string, expires long")
        self.waiting = handle.getListState("waiting", "client string, at long, tie string")

    def _timed(self, micros: int) -> None:
        self.handle.registerTimer(-(-micros // 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [r for frame in rows for r in zip(*(frame[c].tolist() for c in FIELDS), strict=True)]
        self.waiting.appendList(new)
        if new:
            self._timed(min(r[1] for r in new))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000  # all that the watermark has passed
        waiting = list(self.waiting.get()) if self.waiting.exists() else []
        due = sorted((tuple(r) for r in waiting if r[1] <= now), key=lambda r: (r[1], r[2]))
        later = [tuple(r) for r in waiting if r[1] > now]
        owner, expires = self.session.get() if self.session.exists() else (None, None)
        out = []
        for client, at, tie in due:
            if owner is not None and expires <= at:
                out.append((owner, expires, None, False, "expired"))
                owner = None
            locked = owner is not None and client != owner
            out.append((client, at, tie, locked, "heartbeat"))
            if not locked:
                owner, expires = client, at + self.ttl
        if owner is not None and expires <= now:
            out.append((owner, expires, None, False, "expired"))
            owner = None
        if due:
            if later:
                self.waiting.put(later)
                self._timed(min(r[1] for r in later))
            else:
                self.waiting.clear()
        if owner is None:
            self.session.clear()
        else:
            self.session.update((owner, expires))
            self._timed(expires)
        if out:
            frame = pd.DataFrame(out, columns=["client", "at", "tie", "locked", "event"])
            frame.insert(0, "key", key[0])
            yield frame

    def close(self) -> None:
        pass


def lock_stream(heartbeats: DataFrame, key: str, client: str, time: str, tie: str, ttl: int = 300, late: str = "300 seconds") -> DataFrame:
    """key, client, time, tie, locked and event of a stream's heartbeats, as service.session_locks judges them, and of sessions' ends.

    event is heartbeat, or expired where a session of ttl seconds ended without a heartbeat of its client. A heartbeat is put out when the watermark, late
    behind the latest time, has passed it, so those that come late but not too late are judged in their place; ties are ordered as text padded with zeros. The session's state store
    becomes RocksDB, which state with timers needs.
    """
    spark, types = heartbeats.sparkSession, dict(heartbeats.dtypes)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    order = F.lpad(F.col(tie).cast("string"), 20, "0")
    rows = heartbeats.withWatermark(time, late).where(F.col(time).isNotNull())
    rows = rows.select(F.col(key).alias("key"), F.col(client).cast("string").alias("client"), F.unix_micros(F.col(time)).alias("at"), order.alias("tie"), F.col(time).alias("_time"))
    judged = rows.groupBy("key").transformWithStateInPandas(SessionLocks(key, types[key], ttl), f"key {types[key]}, client string, at long, tie string, locked boolean, event string", "append", "EventTime")
    return judged.select(F.col("key").alias(key), F.col("client").alias(client), F.timestamp_micros("at").alias(time), F.col("tie").cast(types[tie]).alias(tie), "locked", "event")
