"""Sinks: conflict-ignoring insert, range-partitioned tables, snapshot refresh, paged export, metric JSON.

Every writer produces a new directory (a table version); readers switch to it
afterwards, which is how a change becomes atomic on immutable files.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tenure.schema import SALARY_ERA_BOUNDARY
from tenure.sources.tables import Tables, missing_path

MAX_FILE_ROWS = 20_000_000


def insert_if_absent(target: DataFrame, incoming: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """``INSERT ... ON CONFLICT (keys) DO NOTHING`` as a new table version.

    Within the batch the first row per key wins (by ``order``; the loader
    keeps the first one it sends). That pick is a ``min_by`` aggregate,
    so a key repeated many times is combined map-side instead of being
    sorted in one task. Keys already in ``target`` are dropped by a left
    anti join.
    """
    cols = [c for c in incoming.columns]
    rest = [c for c in cols if c not in keys]
    if rest:
        rank = F.struct(*[F.col(c) for c in (order or rest)])
        firsts = incoming.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("_r"))
        firsts = firsts.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])
    else:
        firsts = incoming.select(*keys).distinct()
    new = firsts.join(target.select(*keys), keys, "left_anti")
    return target.unionByName(new.select(*target.columns))


def era(col: str | Column, boundaries: list[dt.date] | None = None) -> Column:
    """Range-partition label of a date: index of the first boundary above it (0 = before the first)."""
    c = F.col(col) if isinstance(col, str) else col
    bounds = boundaries or [SALARY_ERA_BOUNDARY]
    out = F.lit(len(bounds))
    for i, b in reversed(list(enumerate(bounds))):
        out = F.when(c < F.lit(b), F.lit(i)).otherwise(out)
    return out


def write_range_partitioned(
    df: DataFrame, path: str, date_col: str = "from_date", boundaries: list[dt.date] | None = None,
    partition_col: str = "era", spread_cols: tuple[str, ...] = ("emp_no",),
) -> None:
    """Write ``df`` partitioned by date ranges, so predicates on the era prune whole directories.

    Dynamic partition overwrite replaces only the eras present in ``df``.
    """
    out = df.withColumn(partition_col, era(date_col, boundaries))
    # The spread columns cut a date that holds very many rows into several ranges.
    spread = [c for c in spread_cols if c in df.columns]
    out = out.repartitionByRange(partition_col, date_col, *spread)
    writer = out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", MAX_FILE_ROWS)
    writer.partitionBy(partition_col).parquet(path)


def refresh_snapshot(df: DataFrame, base: str, version: int | None = None) -> str:
    """Recompute a materialized result into a new snapshot directory and return its path."""
    spark = df.sparkSession
    v = version if version is not None else _next_version(spark, base)
    path = f"{base.rstrip('/')}/v={v}"
    df.write.mode("errorifexists").parquet(path)
    return path


def latest_snapshot(spark: SparkSession, base: str) -> DataFrame:
    """The most recent snapshot written by ``refresh_snapshot``."""
    after = _next_version(spark, base)
    if not after:
        raise FileNotFoundError(f"no snapshot below {base}")
    return spark.read.parquet(f"{base.rstrip('/')}/v={after - 1}")


def _next_version(spark: SparkSession, base: str) -> int:
    """Next version number, from the listed file paths (no data is read)."""
    try:
        files = spark.read.parquet(base).inputFiles()
    except AnalysisException as e:
        if not missing_path(e):
            raise
        return 0  # no snapshot yet
    vs = {int(m.group(1)) for f in files if (m := re.search(r"/v=(\d+)/", f))}
    return max(vs, default=-1) + 1


def write_verified(df: DataFrame, path: str, not_null: list[str]) -> tuple[int, dict[str, int]]:
    """Write ``df`` and return what went through the writer: the row count and the NULL count of each ``not_null`` column.

    The counts are observed while the rows are written, so a load is verified without a second scan. Nothing
    is shuffled between the observation and the files: Spark counts each written partition once, also after a lost executor.
    """
    seen = Observation()
    nulls = [F.count_if(F.col(c).isNull()).alias(c) for c in not_null]
    # An aggregate's name cannot clash with a column's: the nulls are one struct.
    seen_rows = df.observe(seen, F.count(F.lit(1)).alias("row_count"), F.struct(F.lit(0).alias("_"), *nulls).alias("nulls"))
    seen_rows.write.mode("errorifexists").parquet(path)
    found = seen.get
    return found["row_count"], {c: found["nulls"][c] for c in not_null}


def write_pages(indexed: DataFrame, path: str, page_col: str = "page_no", block: int = 1000) -> None:
    """Paged export: rows sorted by page inside files, grouped into page blocks of ``block`` pages.

    Page reads filter on the page number; parquet row-group statistics skip
    other pages, and the block directory bounds the number of directories.
    """
    out = indexed.withColumn("page_block", F.floor(F.col(page_col) / block))
    out.repartitionByRange("page_block", page_col).sortWithinPartitions(page_col).write.mode("overwrite").partitionBy(
        "page_block"
    ).parquet(path)


def read_page(spark: SparkSession, path: str, page: int, page_col: str = "page_no", block: int = 1000) -> DataFrame:
    return spark.read.parquet(path).filter((F.col("page_block") == page // block) & (F.col(page_col) == page))


def write_metric_json(records: DataFrame, path: str, payload_col: str = "payload") -> None:
    """Metric payloads as JSON lines (the source posts them over HTTP; here they land in files)."""
    records.select(F.col(payload_col).alias("value")).write.mode("overwrite").text(path)


def materialize_tables(t: Tables, path: str, names: list[str] | None = None) -> Tables:
    """Write tables to ``path/<name>`` and return them read back (stored tables, lineage cut).

    HR fact tables are written sorted by ``emp_no`` within files, so parquet
    row-group statistics let point and range lookups on the key skip data.
    """
    spark = next(iter(t.values())).sparkSession
    out = {}
    for name in names or list(t):
        df = t[name]
        target = f"{path.rstrip('/')}/{name}"
        w = df.sortWithinPartitions("emp_no") if "emp_no" in df.columns else df
        w.write.mode("overwrite").parquet(target)
        out[name] = spark.read.parquet(target)
    return Tables(out)


def store_bucketed(t: Tables, path: str, buckets: int, prefix: str, names: list[str] | None = None) -> Tables:
    """Store the ``emp_no``-keyed tables bucketed (and sorted) by ``emp_no`` as catalog tables.

    Tables bucketed the same way join on ``emp_no`` without any shuffle: the
    current-state joins of every report then run bucket by bucket. Other
    tables are stored plainly. Data lives under ``path`` (external tables),
    so the location follows the shared storage the caller names.
    """
    spark = next(iter(t.values())).sparkSession
    out = {}
    for name in names or list(t):
        df = t[name]
        table = f"{prefix}_{name}"
        w = df.write.mode("overwrite").option("path", f"{path.rstrip('/')}/{name}")
        if "emp_no" in df.columns:
            w = w.bucketBy(buckets, "emp_no").sortBy("emp_no")
        w.saveAsTable(table)
        out[name] = spark.table(table)
    return Tables(out)
