"""The streaming rollup equals the batch rollup for every window the watermark has closed."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from conftest import SF_SMALL
from tenure.operators.telemetry import window_metrics
from tenure.session import scratch_path
from tenure.sources.fixture import request_events
from tenure.streaming.telemetry_stream import event_stream, start_to_parquet, windowed_metrics_stream


def _write_parts(spark, events, n_parts, path):
    ordered = events.orderBy("ts")
    rows = ordered.withColumn("_part", F.ntile(n_parts).over(__import__("pyspark.sql").sql.Window.orderBy("ts")))
    for i in range(1, n_parts + 1):
        rows.filter(F.col("_part") == i).drop("_part").coalesce(1).write.parquet(f"{path}/part{i:03d}")


def test_stream_equals_batch_for_closed_windows(spark):
    events = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    src = scratch_path(spark, "events-src")
    _write_parts(spark, events, 3, src)
    stream = windowed_metrics_stream(event_stream(spark, f"{src}/*", max_files_per_trigger=1), "1 hour", "2 hours")
    out, ck = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-ck")
    q = start_to_parquet(stream, out, ck)
    q.awaitTermination(300)
    got = spark.read.parquet(out)
    batch = window_metrics(request_events(events), "1 hour")
    emitted_until = got.agg(F.max("window_end")).first()[0]
    want = batch.filter(F.col("window_end") <= emitted_until)
    assert got.count() > 0
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_event_later_than_watermark_is_dropped(spark):
    """Late-event filtering uses the watermark of the previous micro-batch, so the late file comes third."""
    base = dt.datetime(2024, 1, 1, 10, 0, 0)
    h = dt.timedelta(hours=1)
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    files = [
        [(1, base, 1, "view", 1.0, "{}"), (2, base + 5 * h, 1, "view", 1.0, "{}")],
        [(3, base + 6 * h, 1, "view", 1.0, "{}")],
        [(4, base + dt.timedelta(minutes=10), 1, "view", 1.0, "{}"), (5, base + 10 * h, 1, "view", 1.0, "{}")],
    ]
    src = scratch_path(spark, "late-src")
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{src}/f{i}")
    stream = windowed_metrics_stream(event_stream(spark, f"{src}/*", max_files_per_trigger=1), "1 hour", "2 hours")
    out, ck = scratch_path(spark, "late-out"), scratch_path(spark, "late-ck")
    start_to_parquet(stream, out, ck).awaitTermination(300)
    got = {r.window_start.hour: r.requests for r in spark.read.parquet(out).collect()}
    assert got.get(10) == 1  # the 10:10 event came after the watermark passed 13:00: dropped


def test_active_sessions_stream_matches_batch_latest_state(spark):
    from pyspark.sql import Window

    from tenure.operators.telemetry import active_sessions
    from tenure.sources.tables import Tables
    from tenure.streaming.telemetry_stream import active_sessions_stream, start_updates_to_parquet

    events = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    src = scratch_path(spark, "sess-src")
    _write_parts(spark, events, 2, src)
    stream = active_sessions_stream(event_stream(spark, f"{src}/*", max_files_per_trigger=1), "2 hours", 10**6)
    out, ck = scratch_path(spark, "sess-out"), scratch_path(spark, "sess-ck")
    start_updates_to_parquet(stream, out, ck).awaitTermination(300)
    rows = spark.read.parquet(out)
    latest = rows.withColumn("_r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("batch_id").desc())))
    latest = latest.filter("_r = 1")
    got = latest.filter("active AND NOT ended").count()
    want = active_sessions(Tables({"request_events": request_events(events)})).first().active_connections
    assert got == want and latest.count() == events.select("user_id").distinct().count()


def test_idle_session_ends_on_event_time_timeout(spark):
    from tenure.streaming.telemetry_stream import active_sessions_stream, start_updates_to_parquet

    base = dt.datetime(2024, 1, 1, 10, 0, 0)
    h = dt.timedelta(hours=1)
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    files = [[(1, base, 1, "view", 1.0, "{}")], [(2, base + 4 * h, 2, "view", 1.0, "{}")],
             [(3, base + 8 * h, 2, "view", 1.0, "{}")]]
    src = scratch_path(spark, "idle-src")
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{src}/f{i}")
    stream = active_sessions_stream(event_stream(spark, f"{src}/*", max_files_per_trigger=1), "1 hour", 30)
    out, ck = scratch_path(spark, "idle-out"), scratch_path(spark, "idle-ck")
    start_updates_to_parquet(stream, out, ck).awaitTermination(300)
    ended = {r.user_id for r in spark.read.parquet(out).filter("ended").collect()}
    assert 1 in ended  # user 1 was idle far longer than 30 minutes of event time
