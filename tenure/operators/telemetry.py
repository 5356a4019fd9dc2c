"""Request-telemetry rollups over ``request_events`` (batch; see ``tenure.streaming`` for the stream).

Columns: queryType, duration (ms), success, statusCode, virtualUsers, user_id,
ts (timestamp), props (JSON text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenure.functions.dialect import ratio
from tenure.functions.quantiles import percentile_cont, percentile_narrowed, percentile_small
from tenure.sources.tables import Tables

# Fixed values of the source workload (thresholds, metric name, weights).
ERROR_RATE_MAX = 0.1  # errors: rate < 0.1
P95_MAX_MS = 2000.0  # http_req_duration p(95) < 2000
P95_MAX_MS_MYSQL = 8000.0  # the same threshold of the MySQL stack
SLOW_TRACE_MS = 500.0  # transaction tracer explain threshold
SLOW_STATEMENT_MS = 1000.0  # log_min_duration_statement
MAX_SAMPLES = 10  # slow_sql max_samples
METRIC_NAME = "PostgresLoadTest"
ENDPOINT_WEIGHTS = {
    "slow_query": 0.2,
    "slow_query_force_table_scan": 0.2,
    "lock_contention": 0.15,
    "lock_contention_salaries": 0.15,
    "memory_pressure": 0.15,
    "memory_pressure_generate_memory_pressure": 0.15,
}
SCRIPT_WEIGHTS = {"complex": 0.4, "lock": 0.3, "stats": 0.3}  # the load script's own mix
# The given events name no endpoint: each event type stands for one endpoint of a mix.
ENDPOINT_OF_TYPE = {
    "view": "slow_query",
    "click": "slow_query_force_table_scan",
    "purchase": "lock_contention",
    "error": "lock_contention_salaries",
    "signup": "memory_pressure",
}
SCRIPT_ENDPOINT_OF_TYPE = {"view": "complex", "click": "complex", "purchase": "lock", "error": "lock", "signup": "stats"}


def _failures() -> Column:
    return F.count_if(~F.col("success"))


# Durations are summed as exact integers of 1e-4 ms (0.1 microsecond), so averages
# do not depend on summation order and round identically everywhere. A long sum
# stays fast (no wide decimals in the aggregation buffer); it holds ~9e11 requests
# of one second per group, and ANSI mode fails loudly rather than wrap beyond that.
MICRO = 10**4


def micro_sum(c: str = "duration") -> Column:
    return F.sum(F.round(F.col(c) * MICRO).cast("long"))


def micro_ratio(total: Column, n: Column, digits: int = 4) -> Column:
    """``round(total_units / (n * 1e4), digits)`` exactly."""
    return ratio(total, n.cast("long") * MICRO, digits)


def request_metrics(t: Tables, p: float = 0.95, exact: bool = True, narrow: bool = False) -> DataFrame:
    """Per queryType: requests, failures, error rate, average and p95 duration.

    ``exact=True`` ranks rows exactly from counts of distinct values (no group in one task);
    ``narrow=True`` also holds when all durations crowd into one unit. ``exact=False`` uses Spark's bounded-memory sketch.
    """
    ev = t["request_events"]
    base = ev.groupBy("queryType").agg(
        F.count(F.lit(1)).alias("requests"),
        _failures().alias("failures"),
        micro_ratio(micro_sum(), F.count("duration")).alias("avg_duration"),
        F.max("duration").alias("max_duration"),
    ).withColumn("error_rate", ratio("failures", "requests", 4))
    if exact:
        p95 = (percentile_narrowed if narrow else percentile_cont)(ev, ["queryType"], "duration", p, "p95_duration")
    else:
        p95 = ev.groupBy("queryType").agg(F.percentile_approx("duration", p, 10000).alias("p95_duration"))
    return base.join(p95, "queryType", "left").select(
        "queryType", "requests", "failures", "error_rate", "avg_duration", F.round("p95_duration", 4).alias("p95_duration"),
        "max_duration",
    )


def window_metrics(df: DataFrame, window: str = "1 hour", p: float | None = None, accuracy: int | None = None) -> DataFrame:
    """Tumbling-window rollup; works on a batch or a streaming DataFrame (append mode after a watermark).

    ``p`` adds that percentile of the durations of each window (short windows: its values meet in one task);
    with ``accuracy`` it comes from a summary of bounded size instead, a rank at most 1 / accuracy off.
    """
    quantile = F.percentile_approx("duration", p, accuracy) if accuracy else percentile_small("duration", p) if p else None
    more = [F.round(quantile, 4).alias(f"p{round(100 * p)}_duration")] if p else []
    agg = df.groupBy(F.window("ts", window).alias("w"), "queryType").agg(
        F.count(F.lit(1)).alias("requests"),
        _failures().alias("failures"),
        micro_sum().alias("total_micro"),
        F.max("duration").alias("max_duration"),
        *more,
    )
    return agg.select(
        F.col("w.start").cast("timestamp_ntz").alias("window_start"),
        F.col("w.end").cast("timestamp_ntz").alias("window_end"),
        "queryType", "requests", "failures", ratio("failures", "requests", 4).alias("error_rate"),
        micro_ratio(F.col("total_micro"), F.col("requests")).alias("avg_duration"), "max_duration", *agg.columns[6:],
    )


def request_metrics_windowed(t: Tables, window: str = "1 hour") -> DataFrame:
    """Batch form of the windowed rollup (the stream must produce the same rows)."""
    return window_metrics(t["request_events"], window)


def request_metrics_windowed_p95(t: Tables, window: str = "15 seconds", p: float = 0.95) -> DataFrame:
    """The windowed rollup with the exact p95 of each window (the source samples every 15 seconds).

    A window of seconds holds few requests, so its percentile is an aggregate beside the others: one pass, one shuffle.
    """
    return window_metrics(t["request_events"], window, p)


def slo_run(t: Tables, error_rate_max: float = ERROR_RATE_MAX, p95_max_ms: float = P95_MAX_MS) -> DataFrame:
    """The verdict over the whole run, where the thresholds of the source apply (one row)."""
    run = t["request_events"].withColumn("queryType", F.lit("all"))
    return slo_check(t.with_tables(request_events=run), error_rate_max, p95_max_ms)


def slo_check(t: Tables, error_rate_max: float = ERROR_RATE_MAX, p95_max_ms: float = P95_MAX_MS) -> DataFrame:
    """Threshold verdicts per queryType: error rate and p95 latency against the targets."""
    m = request_metrics(t)
    ok_err = F.col("error_rate") < error_rate_max
    ok_p95 = F.col("p95_duration") < p95_max_ms
    return m.select(
        "queryType", "error_rate", "p95_duration", ok_err.alias("error_rate_ok"), ok_p95.alias("p95_ok"),
        (ok_err & ok_p95).alias("passed"),
    )


def gauge_records(t: Tables, name: str = METRIC_NAME) -> DataFrame:
    """One gauge metric record per request as JSON text (nested attributes)."""
    ev = t["request_events"]
    rec = F.struct(
        F.lit(name).alias("name"),
        F.lit("gauge").alias("type"),
        F.col("duration").alias("value"),
        F.unix_millis(F.col("ts")).alias("timestamp"),
        F.struct("queryType", "success", "statusCode", "virtualUsers").alias("attributes"),
    )
    return ev.select("event_id", F.to_json(rec).alias("payload"))


def statement_id() -> Column:
    """Statement key of an event: the ``k`` field of its props JSON."""
    return F.get_json_object(F.col("props"), "$.k").cast("int")


def top_statements(t: Tables, n: int = 10) -> DataFrame:
    """Per statement: calls, total and mean time, rows (successful calls); the ``n`` costliest."""
    ev = t["request_events"].withColumn("queryid", statement_id())
    agg = ev.groupBy("queryid").agg(
        F.count(F.lit(1)).alias("calls"),
        micro_ratio(micro_sum(), F.lit(1)).alias("total_exec_time"),
        micro_ratio(micro_sum(), F.count("duration")).alias("mean_exec_time"),
        F.count_if(F.col("success")).alias("rows"),
    )
    return agg.orderBy(F.col("total_exec_time").desc(), "queryid").limit(n)


def active_sessions(t: Tables) -> DataFrame:
    """Sessions (users) whose latest request succeeded, counted as active; one gauge row."""
    last = t["request_events"].groupBy("user_id").agg(
        F.max_by("success", F.struct("ts", "event_id")).alias("last_ok")
    )
    return last.agg(F.count_if(F.col("last_ok")).alias("active_connections"))


def counter_rate(series: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """Per-second rate of a cumulative counter between consecutive samples of a series.

    A negative delta is a counter reset: the rate is then value / interval. Two
    samples at the same instant have no rate (NULL).
    """
    w = Window.partitionBy(key).orderBy(ts)
    prev_v, prev_t = F.lag(value).over(w), F.lag(ts).over(w)
    micros = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(prev_t.cast("timestamp"))
    secs = F.nullif(micros, F.lit(0)) / F.lit(1e6)
    delta = F.col(value) - prev_v
    rate = F.when(delta < 0, F.col(value) / secs).otherwise(delta / secs)
    return series.select(key, ts, value, F.round(rate, 6).alias("rate"))


def request_counter_rate(t: Tables, interval: str = "1 hour") -> DataFrame:
    """Calls counter per queryType sampled at each interval end, and its rate (requests per second).

    The counter is the running sum of per-interval counts: aggregate first
    (one row per interval and type), then a window over that small series.
    """
    per = t["request_events"].groupBy(F.window("ts", interval).alias("w"), "queryType").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("queryType").orderBy("sample_ts").rowsBetween(Window.unboundedPreceding, 0)
    series = per.select("queryType", F.col("w.end").cast("timestamp_ntz").alias("sample_ts"), "n").withColumn(
        "calls_total", F.sum("n").over(w)
    )
    return counter_rate(series, "queryType", "sample_ts", "calls_total")


def statement_rates(t: Tables, interval: str = "1 hour") -> DataFrame:
    """Per statement and interval: calls and rows as rates per second, execution times as gauges.

    Rates are over the time since the statement's previous sample (NULL for the first); total and mean
    execution time are those of all calls up to the sample. Events are aggregated before any window.
    """
    ev = t["request_events"].withColumn("queryid", statement_id())
    per = ev.groupBy(F.window("ts", interval).alias("w"), "queryid").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if("success").alias("rows"),
        micro_sum().alias("micro"), F.count("duration").alias("timed"),
    ).withColumn("sample_ts", F.col("w.end"))
    w = Window.partitionBy("queryid").orderBy("sample_ts")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    secs = (F.unix_micros("sample_ts") - F.unix_micros(F.lag("sample_ts").over(w))) / F.lit(1e6)
    return per.select(
        "queryid", F.col("sample_ts").cast("timestamp_ntz").alias("sample_ts"),
        F.round(F.col("calls") / secs, 6).alias("calls_rate"), F.round(F.col("rows") / secs, 6).alias("rows_rate"),
        F.sum("micro").over(upto).alias("_m"), F.sum("timed").over(upto).alias("_n"),
    ).select(
        "queryid", "sample_ts", "calls_rate", "rows_rate", micro_ratio(F.col("_m"), F.lit(1)).alias("total_exec_time"),
        micro_ratio(F.col("_m"), F.col("_n")).alias("mean_exec_time"),
    )


def slow_requests(t: Tables, threshold_ms: float = SLOW_TRACE_MS, max_samples: int = MAX_SAMPLES) -> DataFrame:
    """Requests at or above a threshold, at most ``max_samples`` slowest per queryType.

    ``row_number() <= k`` gets a partial WindowGroupLimit before the shuffle.
    """
    ev = t["request_events"].filter(F.col("duration") >= threshold_ms)
    w = Window.partitionBy("queryType").orderBy(F.col("duration").desc(), "event_id")
    return ev.withColumn("sample_rank", F.row_number().over(w)).filter(F.col("sample_rank") <= max_samples).select(
        "queryType", "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "duration", "sample_rank"
    )


def slow_requests_windowed(t: Tables, threshold_ms: float = SLOW_TRACE_MS, window: str = "1 minute", max_samples: int = MAX_SAMPLES) -> DataFrame:
    """``slow_requests`` of each harvest window: at most ``max_samples`` of a queryType and window."""
    ev = t["request_events"].filter(F.col("duration") >= threshold_ms)
    ev = ev.withColumn("window_start", F.window("ts", window).getField("start").cast("timestamp_ntz"))
    w = Window.partitionBy("window_start", "queryType").orderBy(F.col("duration").desc(), "event_id")
    return ev.withColumn("sample_rank", F.row_number().over(w)).filter(F.col("sample_rank") <= max_samples).select(
        "window_start", "queryType", "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "duration", "sample_rank"
    )


def request_log(t: Tables, service: str = "hr-portal", method: str = "GET") -> DataFrame:
    """Formatted request log lines: ``service | METHOD /path | Status: code | <ms>ms[ | Error: ...]``."""
    ev = t["request_events"]
    err = F.when(~F.col("success"), F.concat(F.lit(" | Error: HTTP "), F.col("statusCode").cast("string"))).otherwise("")
    line = F.concat(
        F.lit(f"{service} | {method} /"), F.col("queryType"), F.lit(" | Status: "), F.col("statusCode").cast("string"),
        F.lit(" | "), F.col("duration").cast("string"), F.lit("ms"), err,
    )
    return ev.select("event_id", line.alias("line"))


def _literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def endpoint_mix(t: Tables, weights: dict[str, float] | None = None, endpoint_of: dict[str, str] | None = None) -> DataFrame:
    """Observed share of each queryType against its declared weight.

    ``weights`` maps queryType to its declared share (e.g. ``ENDPOINT_WEIGHTS``);
    without it every observed type is declared equally likely. ``endpoint_of`` names the endpoint
    that an event's type stands for; a type it does not name stands for itself. Full outer
    join: a declared type never seen, or a seen type never declared, shows.
    """
    ev = t["request_events"]
    if endpoint_of:
        ev = ev.withColumn("queryType", F.coalesce(F.try_element_at(_literal_map(endpoint_of), F.col("queryType")), "queryType"))
    counts = ev.groupBy("queryType").agg(F.count(F.lit(1)).alias("requests"))
    total = F.broadcast(counts.agg(F.sum("requests").alias("_total"), F.count(F.lit(1)).alias("_types")))  # one row
    obs = counts.crossJoin(total)
    if weights is None:
        out = obs.withColumn("declared_weight", F.lit(1.0) / F.col("_types"))
    else:
        declared = ev.sparkSession.range(1).select(F.explode(_literal_map(weights)).alias("queryType", "declared_weight"))
        out = obs.join(declared, "queryType", "full_outer")
    share = F.coalesce(ratio("requests", "_total", 4), F.lit(0.0))
    return out.select(
        "queryType", F.coalesce("requests", F.lit(0)).alias("requests"), share.alias("observed_share"),
        F.round("declared_weight", 4).alias("declared_weight"),
        F.round(share - F.coalesce("declared_weight", F.lit(0.0)), 4).alias("deviation"),
    )
