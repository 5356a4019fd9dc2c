"""Live telemetry streams against their batch forms, on files that come in shuffled order with late events."""

from __future__ import annotations

from pyspark.sql import functions as F

from conftest import SF_SMALL
from tenure.operators import telemetry
from tenure.session import scratch_path
from tenure.sources.fixture import request_events
from tenure.sources.tables import Tables
from tenure.streaming import live
from tenure.streaming.telemetry_stream import event_stream, start_to_parquet


def _files(spark, events, n, path):
    """``n`` files in time order, each with its rows shuffled; a tenth of a file's rows come in the next file, late."""
    first, last = (x.timestamp() for x in events.agg(F.min("ts"), F.max("ts")).first())
    part = F.floor((F.unix_seconds(F.col("ts").cast("timestamp")) - first) / ((last - first) / n + 1)).cast("int")
    late = F.when(F.xxhash64("event_id") % 10 == 0, 1).otherwise(0)
    rows = events.withColumn("_part", F.greatest(F.least(part + late, F.lit(n - 1)), F.lit(0))).cache()
    for i in range(n):
        rows.filter(F.col("_part") == i).drop("_part").orderBy(F.xxhash64("event_id")).coalesce(1).write.parquet(f"{path}/part{i:03d}")
    span = (last - first) / n
    return f"{int(2.2 * span)} seconds"  # a watermark that no late event misses


def _run(spark, name, make, n=4):
    events = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    src, out = scratch_path(spark, f"{name}-src"), scratch_path(spark, f"{name}-out")
    watermark = _files(spark, events, n, src)
    stream = make(event_stream(spark, f"{src}/*", max_files_per_trigger=1), watermark)
    start_to_parquet(stream, out, scratch_path(spark, f"{name}-ck")).awaitTermination(300)
    return spark.read.parquet(out), Tables({"request_events": request_events(events)})


def _same(got, want):
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_p95_of_closed_windows_is_within_the_rank_error(spark):
    accuracy = 20
    got, t = _run(spark, "p95", lambda e, w: live.windowed_p95_stream(e, "6 hours", w, accuracy=accuracy))
    until = got.agg(F.max("window_end")).first()[0]
    ev = t["request_events"].withColumn("window_start", F.window("ts", "6 hours").getField("start").cast("timestamp_ntz"))
    ranks = got.join(ev, ["window_start", "queryType"]).groupBy("window_start", "queryType").agg(
        F.first("requests").alias("n"), F.count(F.lit(1)).alias("all"), F.count_if(F.round("duration", 4) < F.col("p95_duration")).alias("below"), F.count_if(F.round("duration", 4) <= F.col("p95_duration")).alias("upto"))
    rows = ranks.collect()
    assert len(rows) > 5
    for r in rows:
        assert r.n == r["all"]
        assert r.below <= (0.95 + 1 / accuracy) * r.n + 1 and r.upto >= (0.95 - 1 / accuracy) * r.n - 1
    exact = telemetry.window_metrics(t["request_events"], "6 hours").filter(F.col("window_end") <= F.lit(until))
    _same(got.drop("p95_duration"), exact)


def test_gauge_equals_the_batch_after_every_trigger(spark):
    events = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    src, out = scratch_path(spark, "gauge-src"), scratch_path(spark, "gauge-out")
    _files(spark, events, 4, src)
    stream = live.session_changes_stream(event_stream(spark, f"{src}/*", max_files_per_trigger=1), "2 hours", 10**6)
    live.start_gauge(stream, out, scratch_path(spark, "gauge-ck")).awaitTermination(300)
    got = {r.batch: r.active_connections for r in spark.read.parquet(out).collect()}
    seen, want = None, []
    for i in range(4):
        part = spark.read.parquet(f"{src}/part{i:03d}")
        seen = part if seen is None else seen.unionByName(part)
        want.append(telemetry.active_sessions(Tables({"request_events": request_events(seen)})).first().active_connections)
    assert [got[i] for i in range(4)] == want and len(set(want)) > 1


def test_rates_equal_the_batch_for_closed_intervals(spark):
    got, t = _run(spark, "rates", lambda e, w: live.statement_rates_stream(e, 3600, w))
    until = got.agg(F.max("sample_ts")).first()[0]
    assert got.count() > 10
    _same(got, telemetry.statement_rates(t).filter(F.col("sample_ts") <= F.lit(until)).select(got.columns))


def test_slow_samples_equal_the_batch_for_closed_windows(spark):
    got, t = _run(spark, "slow", lambda e, w: live.slow_samples_stream(e, 50.0, 3600, w, 3))
    got = got.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "queryType", "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "duration", "sample_rank")
    until = got.agg(F.max("window_start")).first()[0]
    assert got.count() > 10
    _same(got, telemetry.slow_requests_windowed(t, 50.0, "1 hour", 3).filter(F.col("window_start") <= F.lit(until)))
