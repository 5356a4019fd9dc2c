"""Structured Streaming form of the windowed request rollup.

File source -> request view (NTZ time cast to timestamp, required by the
watermark) -> watermark -> tumbling-window aggregate -> append-mode sink.
A window is emitted once the watermark passes its end, so late events within
the delay are counted and events later than that are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tenure.operators.telemetry import window_metrics
from tenure.sources.fixture import request_events

EVENTS_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming request events from a directory of ``events``-shaped parquet files."""
    reader = spark.readStream.schema(EVENTS_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return request_events(reader.parquet(path))


def windowed_metrics_stream(events: DataFrame, window: str = "1 hour", watermark: str = "2 hours") -> DataFrame:
    """The batch ``window_metrics`` plan on a stream, bounded by an event-time watermark."""
    return window_metrics(events.withWatermark("ts", watermark), window)


def start_to_parquet(df: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Run the rollup into a parquet directory (exactly-once file sink with its own checkpoint)."""
    writer = df.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="15 seconds")
    return writer.start(path)


# --- active sessions as a stateful stream -------------------------------------------------

SESSION_OUT = "user_id long, active boolean, last_ts timestamp, ended boolean"
SESSION_STATE = "last_ts timestamp, last_id long, last_ok boolean"


def session_tracker(idle_ms: int):
    """Per-user state function for ``applyInPandasWithState``.

    The state holds the latest event of each user: time, id (the larger one wins a tie, as in the
    batch gauge) and success.
    An event-time timeout ends a session that saw no event for ``idle_ms``;
    it is emitted once as ended and its state is dropped, so state size
    follows the live users only.
    """

    def track(key, batches, state):
        import pandas as pd

        (user_id,) = key
        if state.hasTimedOut:
            last_ts = state.get[0]
            state.remove()
            yield pd.DataFrame({"user_id": [user_id], "active": [False], "last_ts": [last_ts], "ended": [True]})
            return
        last_ts, last_id, last_ok = state.get if state.exists else (None, None, None)
        for pdf in batches:
            row = pdf.sort_values(["ts", "event_id"]).iloc[-1]
            if last_ts is None or (row["ts"], row["event_id"]) >= (last_ts, last_id):
                last_ts, last_id, last_ok = row["ts"], int(row["event_id"]), bool(row["success"])
        state.update((last_ts, last_id, last_ok))
        state.setTimeoutTimestamp(int(pd.Timestamp(last_ts).timestamp() * 1000) + idle_ms)
        yield pd.DataFrame({"user_id": [user_id], "active": [last_ok], "last_ts": [last_ts], "ended": [False]})

    return track


def active_sessions_stream(events: DataFrame, watermark: str = "2 hours", idle_minutes: int = 30) -> DataFrame:
    """Streaming T6: one row per user whenever their session state changes (update mode).

    A user is active while their latest request succeeded; ``ended`` rows mark
    sessions idle for ``idle_minutes`` of event time. The gauge at any moment
    is the count of active, not-ended users in the sink's latest rows.
    """
    return (
        events.withWatermark("ts", watermark)
        .select("user_id", "ts", "event_id", "success")
        .groupBy("user_id")
        .applyInPandasWithState(
            session_tracker(idle_minutes * 60 * 1000), SESSION_OUT, SESSION_STATE, "update", "EventTimeTimeout"
        )
    )


def start_updates_to_parquet(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Update-mode results appended per micro-batch with the batch id (replays overwrite the same batch)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        from pyspark.sql import functions as F

        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        df.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
        .foreachBatch(write).trigger(availableNow=True).start()
    )
