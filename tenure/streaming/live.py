"""Live request telemetry: p95 of windows, the active-connection gauge, statement rates and slow samples as streams.

Each has a batch form in ``operators.telemetry`` that it equals for what the watermark has closed, in whatever order
the files come. State is bounded: a quantile summary a window and type, three values a live user, the open
intervals of a statement, ``max_samples`` rows a type and open window.
"""

from __future__ import annotations

import heapq

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tenure.operators.telemetry import MAX_SAMPLES, MICRO, SLOW_TRACE_MS, micro_ratio, statement_id, window_metrics
from tenure.sources.tables import missing_path

ACCURACY = 1000  # rank error of the streamed percentile: at most 1 / ACCURACY of a window's requests


def windowed_p95_stream(events: DataFrame, window: str = "15 seconds", watermark: str = "1 minute", p: float = 0.95, accuracy: int = ACCURACY) -> DataFrame:
    """``request_metrics_windowed_p95`` on a stream; the percentile comes from a mergeable summary kept as state.

    It is a duration whose rank is within ``1 / accuracy`` of the window's requests from ``p``.
    """
    return window_metrics(events.withWatermark("ts", watermark), window, p, accuracy)


# --- T6: the gauge -----------------------------------------------------------------------------

CHANGE_OUT = "user_id long, change int"
CHANGE_STATE = "last_ts timestamp, last_id long, last_ok boolean"


def _signed_changes(idle_ms: int):
    """State function: +1 when a user's latest request turns out successful, -1 when it no longer is or the user is idle."""

    def track(key, batches, state):
        import pandas as pd

        last_ts, last_id, was = state.get if state.exists else (None, None, False)
        if state.hasTimedOut:
            state.remove()
            now = False
        else:
            now = was
            for pdf in batches:
                row = pdf.sort_values(["ts", "event_id"]).iloc[-1]
                if last_ts is None or (row["ts"], row["event_id"]) >= (last_ts, last_id):
                    last_ts, last_id, now = row["ts"], int(row["event_id"]), bool(row["success"])
            state.update((last_ts, last_id, now))
            state.setTimeoutTimestamp(max(int(pd.Timestamp(last_ts).timestamp() * 1000) + idle_ms, state.getCurrentWatermarkMs() + 1))
        if now != was:
            yield pd.DataFrame({"user_id": [key[0]], "change": [int(now) - int(was)]})

    return track


def session_changes_stream(events: DataFrame, watermark: str = "2 hours", idle_minutes: int = 30) -> DataFrame:
    """Signed changes of the number of active users (update mode)."""
    return (
        events.withWatermark("ts", watermark).select("user_id", "ts", "event_id", "success").groupBy("user_id")
        .applyInPandasWithState(_signed_changes(idle_minutes * 60_000), CHANGE_OUT, CHANGE_STATE, "update", "EventTimeTimeout")
    )


def start_gauge(changes: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """One row (active_connections) for every trigger: the gauge before and the sum of the trigger's changes.

    A trigger writes ``<path>/batch=<id>`` and reads the latest one before it, so a replayed trigger writes the same row.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        try:
            rows = spark.read.schema("active_connections long, batch long").parquet(path).filter(F.col("batch") < batch_id)
            before = rows.agg(F.max_by("active_connections", "batch")).first()[0] or 0
        except AnalysisException as e:
            if not missing_path(e):
                raise
            before = 0
        gauge = batch.agg((F.coalesce(F.sum("change"), F.lit(0)) + F.lit(before)).cast("long").alias("active_connections"))
        gauge.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = changes.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="15 seconds")).start()


# --- T7: statement rates -----------------------------------------------------------------------

SAMPLE_OUT = "queryid int, sample_ts timestamp, calls long, rows long, secs double, micro long, timed long"
SAMPLE_STATE = "last long, micro long, timed long, ends array<long>, counts array<array<long>>"


def _samples(interval_us: int):
    """State function: counts of a statement's open intervals; each closed one is a sample, set against the last one."""

    def track(key, batches, state):
        import pandas as pd

        last, micro, timed, ends, counts = state.get if state.exists else (None, 0, 0, [], [])
        held = {e: list(c) for e, c in zip(ends, counts)}
        if not state.hasTimedOut:
            for pdf in batches:
                end = (pdf["us"] // interval_us + 1) * interval_us
                for e, g in pdf.groupby(end)[["calls", "ok", "micro", "timed"]].sum().iterrows():
                    if last is None or e > last:  # later than the watermark: the interval is out already
                        held[int(e)] = [x + int(y) for x, y in zip(held.get(int(e), [0] * 4), g)]
        closed, out = state.getCurrentWatermarkMs() * 1000, []
        for e in sorted(e for e in held if e <= closed):
            calls, rows, m, n = held.pop(e)
            micro, timed = micro + m, timed + n
            out.append((key[0], pd.Timestamp(e, unit="us"), calls, rows, None if last is None else (e - last) / 1e6, micro, timed))
            last = e
        state.update((last, micro, timed, sorted(held), [held[e] for e in sorted(held)]))
        if held:
            state.setTimeoutTimestamp(max(min(held) // 1000, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["queryid", "sample_ts", "calls", "rows", "secs", "micro", "timed"])

    return track


def statement_rates_stream(events: DataFrame, interval_seconds: int = 3600, watermark: str = "2 hours") -> DataFrame:
    """``statement_rates`` on a stream (append mode).

    Events come in any order within the watermark: a statement's state holds the counts of its open intervals, and
    the watermark closes them in order, each against the last sample. A statement's counts are running totals, so nothing
    is lost when a statement rests.
    """
    ev = events.withWatermark("ts", watermark).select(
        statement_id().alias("queryid"), "ts", F.unix_micros("ts").alias("us"), F.lit(1).alias("calls"), F.col("success").cast("int").alias("ok"),
        F.coalesce(F.round(F.col("duration") * MICRO).cast("long"), F.lit(0)).alias("micro"), F.col("duration").isNotNull().cast("int").alias("timed"),
    )
    out = ev.groupBy("queryid").applyInPandasWithState(_samples(interval_seconds * 1_000_000), SAMPLE_OUT, SAMPLE_STATE, "append", "EventTimeTimeout")
    secs = F.when(~F.isnan("secs"), F.col("secs"))
    return out.select(
        "queryid", F.col("sample_ts").cast("timestamp_ntz").alias("sample_ts"), F.round(F.col("calls") / secs, 6).alias("calls_rate"),
        F.round(F.col("rows") / secs, 6).alias("rows_rate"), micro_ratio(F.col("micro"), F.lit(1)).alias("total_exec_time"),
        micro_ratio(F.col("micro"), F.col("timed")).alias("mean_exec_time"),
    )


# --- T8: slow samples --------------------------------------------------------------------------

SLOW_OUT = "window_start timestamp, queryType string, event_id long, ts timestamp, duration double, sample_rank int"
SLOW_STATE = "duration array<double>, event_id array<long>, ts array<timestamp>"


def _slowest(most: int, window_ms: int):
    """State function: the ``most`` slowest requests of a type and window, given out when the window is over."""

    def track(key, batches, state):
        import pandas as pd

        heap = list(zip(*state.get)) if state.exists else []
        start = pd.Timestamp(key[0])
        if state.hasTimedOut:
            state.remove()
            rows = [(start, key[1], e, t, d, i) for i, (d, e, t) in enumerate(heap, 1)]
            yield pd.DataFrame(rows, columns=["window_start", "queryType", "event_id", "ts", "duration", "sample_rank"])
            return
        for pdf in batches:
            rows = zip(pdf["duration"].tolist(), pdf["event_id"].tolist(), pdf["ts"].tolist())
            heap = heapq.nsmallest(most, [*heap, *rows], key=lambda r: (-r[0], r[1]))
        state.update(tuple(list(c) for c in zip(*heap)))
        end = int(start.timestamp() * 1000) + window_ms
        state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))

    return track


def slow_samples_stream(events: DataFrame, threshold_ms: float = SLOW_TRACE_MS, window_seconds: int = 60, watermark: str = "2 hours", max_samples: int = MAX_SAMPLES) -> DataFrame:
    """``slow_requests_windowed`` on a stream: the slowest requests of each harvest window, when the watermark passes its end."""
    slow = events.withWatermark("ts", watermark).filter(F.col("duration") >= threshold_ms)
    keyed = slow.withColumn("window_start", F.window("ts", f"{window_seconds} seconds").getField("start"))
    return (
        keyed.select("window_start", "queryType", "event_id", "ts", "duration").groupBy("window_start", "queryType")
        .applyInPandasWithState(_slowest(max_samples, window_seconds * 1000), SLOW_OUT, SLOW_STATE, "append", "EventTimeTimeout")
    )
