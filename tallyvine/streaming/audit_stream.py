"""Audit event streams: hourly rollup and throttle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyvine.operators.audit import THROTTLE_SCHEMA


def hourly_rollup(events: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Events per hour and action, for a batch or a stream.

    ``events`` has ``action`` and ``ts`` (UTC milliseconds). On a stream an hour
    is final once the watermark has passed its end; hours before that do not come
    out in append mode, and later events are dropped. ``rollup_batch`` has neither limit.
    """
    timed = events.withColumn("event_time", F.timestamp_millis("ts"))
    if events.isStreaming:
        timed = timed.withWatermark("event_time", lateness)
    counts = timed.groupBy(F.window("event_time", "1 hour"), "action").agg(F.count("*").alias("events"))
    return counts.select(F.unix_millis("window.start").alias("hour_ms"), "action", "events")


def rollup_batch(folder: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer: the hourly counts of one batch, of which a repeat replaces what it stored."""

    def write(batch: DataFrame, batch_id: int) -> None:
        hourly_rollup(batch).write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")

    return write


def stored_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Events per hour and action over all batches that ``rollup_batch`` stored.

    No state and no watermark: hours still open are there, and events count however late they come.
    """
    parts = spark.read.schema("hour_ms bigint, action string, events bigint, batch_id bigint").parquet(folder)
    return parts.groupBy("hour_ms", "action").agg(F.sum("events").alias("events"))


def throttle_stream(events: DataFrame, capacity: int, per_seconds: int) -> DataFrame:
    """Token-bucket verdicts on a stream ``(key, event_id, ts)``; every event gets one.

    The bucket of a key is its state: tokens and the time of the last event, two numbers
    a key. There is no watermark, which would drop late events, and so no timeout: state
    grows with the number of keys, not of events. Events of one batch are put in time
    order; an event older than the bucket refills nothing.
    """
    rate = capacity / float(per_seconds)

    def walk(
        key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (float(capacity), None)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        allowed, retry = [], []
        for ts in rows["ts"]:
            if last is not None:
                tokens = min(float(capacity), tokens + max(0, ts - last) / 1000.0 * rate)
            last = int(ts) if last is None else max(last, int(ts))
            ok = tokens >= 1.0
            allowed.append(ok)
            retry.append(None if ok else int(max(1.0, (1.0 - tokens) / rate)))
            if ok:
                tokens -= 1.0
        state.update((tokens, last))
        yield pd.DataFrame({
            "key": key[0], "event_id": rows["event_id"], "ts": rows["ts"],
            "allowed": allowed, "retry_after": pd.array(retry, dtype="Int64"),
        })

    return events.groupBy("key").applyInPandasWithState(
        walk, THROTTLE_SCHEMA, "tokens double, last bigint", "append",
        GroupStateTimeout.NoTimeout,
    )
