"""Structured Streaming jobs: incremental ingest, unique observations, change feed, rate limit."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gleaner.sources.store import DatasetStore


def ingest(
    stream: DataFrame,
    store: DatasetStore,
    prepare: Callable[[DataFrame], DataFrame],
    clock: Callable[[int], str],
    checkpoint: str,
    run_prefix: str = "batch",
    policy: Mapping[str, Any] | None = None,
    strict: bool = False,
) -> DataStreamWriter:
    """Each micro-batch is a run.  A replayed batch keeps its id, and the store
    ignores ids it has committed, so restarts add nothing twice.  A blocked run is
    listed in ``store.blocked_runs()`` and the stream goes on, unless ``strict``."""

    def commit(batch: DataFrame, batch_id: int) -> None:
        result = store.commit(prepare(batch), f"{run_prefix}-{batch_id}", clock(batch_id), policy)
        if strict and result.blocked:
            raise RuntimeError(f"run {result.run_id} is blocked: {result.reason}")

    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def unique_observations(stream: DataFrame, time: str = "observed_at", delay: str = "1 day") -> DataFrame:
    """One observation per (run, key); the watermark only bounds the state."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(["run_id", "natural_key"])


def requests_per_minute(stream: DataFrame, limit: int, token: str = "token_id", time: str = "ts", delay: str = "2 minutes") -> DataFrame:
    """Requests and rejections per token and UTC minute."""
    counted = stream.withWatermark(time, delay).groupBy(token, F.window(time, "1 minute").alias("w")).agg(
        F.count(F.lit(1)).alias("requests")
    )
    return counted.select(
        token,
        F.col("w.start").alias("bucket_start"),
        F.least("requests", F.lit(limit)).alias("accepted"),
        F.greatest(F.col("requests") - limit, F.lit(0)).alias("rejected"),
    )


def changed_payloads(stream: DataFrame, key: str, digest: str, order: str, delay: str | None = None, idle: str | None = None) -> DataFrame:
    """Emit a key's newest payload digest of a micro-batch when it differs from the last one.

    Event order counts, not arrival: the state of a key is its newest (order, digest), and rows that
    are not after it change nothing, in whatever batch they come.  Equal orders go by digest.

    With ``delay``, ``order`` is an event time and bounds the state: rows at or before the watermark are dropped, and
    a key without newer rows for ``idle`` (default: ``delay``) of event time is forgotten; its next row
    is emitted as a first one.  What is forgotten lies before the watermark, so no late row can come after it.

    Each task first keeps only the newest row per key of its Arrow batches, so a
    busy key reaches the state function as a few rows.
    """
    key_type, order_type = (stream.schema[c].dataType.simpleString() for c in (key, order))
    timed = order_type.startswith("timestamp")
    if delay is not None and order_type != "timestamp":
        raise ValueError("a delay needs a timestamp as order")
    # One comparable number, or the value itself, whatever the time zone of a worker.
    at = F.unix_micros(F.col(order).cast("timestamp")) if timed else F.col(order)
    at_type = "bigint" if timed else order_type

    def combine(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.sort_values(["at", digest], kind="stable").drop_duplicates(key, keep="last")

    columns = f"{key} {key_type}, {digest} string, at {at_type}"
    source = stream.where(F.col(order).isNotNull()).select(key, F.coalesce(F.col(digest), F.lit("")).alias(digest), at.alias("at"))
    reduced = source.mapInPandas(combine, columns)
    timeout, keep_ms = GroupStateTimeout.NoTimeout, 0
    if delay is not None:
        # The watermark moves with the rows that reach the state.
        reduced = reduced.withColumn("event_time", F.timestamp_micros("at")).withWatermark("event_time", delay)
        timeout, keep_ms = GroupStateTimeout.EventTimeTimeout, int(pd.Timedelta(idle or delay).total_seconds() * 1000)

    def emit(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        watermark = state.getCurrentWatermarkMs() if delay is not None else 0
        before = tuple(state.get) if state.exists else None
        newest = before
        for frame in frames:
            for found in zip(frame["at"].tolist(), frame[digest].tolist(), strict=True):
                late = delay is not None and found[0] <= watermark * 1000
                if not late and (newest is None or found > newest):
                    newest = found
        if newest is not None and newest != before:
            state.update(newest)
            if before is None or newest[1] != before[1]:
                yield pd.DataFrame({key: [keys[0]], digest: [newest[1]]})
        if delay is not None and state.exists:
            state.setTimeoutTimestamp(max(newest[0] // 1000 + keep_ms, watermark + 1))

    return reduced.groupBy(key).applyInPandasWithState(
        emit, f"{key} {key_type}, {digest} string", f"at {at_type}, {digest} string", "update", timeout
    )
