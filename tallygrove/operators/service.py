"""Sessions and usage logs as tables; the same functions serve batch and streaming frames."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import feature_code


def latest_session(sessions: DataFrame, now: Column, key: str = "api_key_id") -> DataFrame:
    """The live session of each key with the newest heartbeat."""
    w = Window.partitionBy(key).orderBy(F.desc("last_heartbeat_at"), F.desc("created_at"), F.desc("id"))
    return sessions.where(F.col("expires_at") > now).withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def purge_expired(sessions: DataFrame, now: Column) -> DataFrame:
    """Sessions that are still live."""
    return sessions.where(F.col("expires_at") > now)


def valid_keys(requests: DataFrame, keys: DataFrame, now: Column, secret: str = "secret") -> DataFrame:
    """Requests whose secret's prefix and SHA-256 belong to an active key that hasn't expired."""
    live = keys.where((F.col("status") == "active") & (F.col("expires_at").isNull() | (F.col("expires_at") > now))).select("key_prefix", "key_hash")
    hashed = requests.withColumns({"key_prefix": F.substring(secret, 1, 8), "key_hash": F.sha2(F.col(secret), 256)})
    return hashed.join(live, ["key_prefix", "key_hash"], "left_semi").drop("key_prefix", "key_hash")


def sessions(heartbeats: DataFrame, key: str, time: str, ttl: str = "300 seconds", late: str | None = None) -> DataFrame:
    """key, start, end, beats: heartbeats no further apart than ttl are one session. late sets a watermark for streams."""
    rows = heartbeats.withWatermark(time, late) if late else heartbeats
    found = rows.groupBy(key, F.session_window(time, ttl).alias("w")).agg(F.count(F.lit(1)).alias("beats"))
    return found.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "beats")


def session_locks(heartbeats: DataFrame, key: str, client: str, time: str, tie: str, ttl: int = 300) -> DataFrame:
    """key, client, time, tie, locked: whether a heartbeat meets a live session of another client of its key.

    A heartbeat that isn't locked takes or keeps the session for ttl seconds; one at the very end finds it expired. What a
    heartbeat finds depends on all before it, so a key's rows are read in order by one task, as a stream that holds
    one session, never as a group.
    """
    types = dict(heartbeats.dtypes)
    rows = heartbeats.select(key, client, time, tie, F.unix_micros(F.col(time).cast("timestamp")).alias("_at")).where(F.col("_at").isNotNull())
    rows = rows.repartition(F.col(key)).sortWithinPartitions(key, "_at", tie)

    def judged(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at_key, owner, expires = object(), None, 0
        for frame in frames:
            locked = []
            for k, who, at in zip(frame[key].tolist(), frame[client].tolist(), frame["_at"].tolist(), strict=True):
                if k != at_key:
                    at_key, owner, expires = k, None, at
                locked.append(at < expires and who != owner)
                if not locked[-1]:
                    owner, expires = who, at + ttl * 1_000_000
            yield frame.drop(columns="_at").assign(locked=locked)

    return rows.mapInPandas(judged, ", ".join([*(f"`{c}` {types[c]}" for c in (key, client, time, tie)), "locked boolean"]))


def usage_rollup(log: DataFrame, time: str = "created_at", window: str = "1 minute", late: str | None = None) -> DataFrame:
    """feature, start, requests, errors, mean latency by window."""
    rows = log.withWatermark(time, late) if late else log
    found = rows.groupBy(feature_code(F.col("endpoint")).alias("feature"), F.window(time, window).alias("w")).agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(F.col("status_code") >= 400).alias("errors"), F.avg("response_time_ms").alias("mean_ms")
    )
    return found.select("feature", F.col("w.start").alias("start"), "requests", "errors", "mean_ms")


def over_limit(log: DataFrame, key: str, time: str, minute: int = 60, daily: int = 1000) -> DataFrame:
    """key, period, start, n of the minutes and days with more requests than allowed."""
    out = None
    for period, unit, most in (("minute", "1 minute", minute), ("day", "1 day", daily)):
        part = log.groupBy(key, F.window(time, unit).alias("w")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(key, F.lit(period).alias("period"), F.col("w.start").alias("start"), "n")
        out = part if out is None else out.union(part)
    return out


def latest_rows(log: DataFrame, time: str, tie: str, n: int = 200) -> DataFrame:
    """The n newest rows."""
    return log.orderBy(F.desc(time), F.desc(tie)).limit(n)
