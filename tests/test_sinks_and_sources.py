from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tenure.operators import changes, quality
from tenure.operators.reports_admin import admin_data_export
from tenure.plans.inspect import plan_text
from tenure.schema import OPEN_END
from tenure.session import scratch_path
from tenure.sources.generate import generate_hr
from tenure.sources.sinks import (
    insert_if_absent, latest_snapshot, read_page, refresh_snapshot, write_metric_json, write_pages,
    write_range_partitioned,
)
from tenure.operators.views import dept_stats
from tenure.operators.telemetry import gauge_records


def test_range_partitioned_write_prunes(spark, tables):
    path = scratch_path(spark, "eras")
    s = tables["salaries"].withColumn("from_date", F.date_add("from_date", 9000))  # some rows past 2020
    write_range_partitioned(s, path)
    back = spark.read.parquet(path)
    assert sorted(r.era for r in back.select("era").distinct().collect()) == [0, 1]
    q = back.filter((F.col("era") == 1) & (F.col("from_date") >= dt.date(2021, 1, 1)))
    assert "PartitionFilters: [isnotnull(era" in plan_text(q)
    assert back.count() == s.count()


def test_snapshot_refresh_versions(spark, tables):
    base = scratch_path(spark, "dept_stats")
    p0 = refresh_snapshot(dept_stats(tables), base)
    p1 = refresh_snapshot(dept_stats(tables), base)
    assert p0.endswith("v=0") and p1.endswith("v=1")
    assert latest_snapshot(spark, base).count() == dept_stats(tables).count()


def test_paged_export_pages_are_contiguous(spark, tables):
    exp = admin_data_export(tables, page_size=20)
    rows = exp.orderBy("emp_no", "title", "dept_name", "salary").collect()
    assert [r.page_no for r in rows] == [i // 20 for i in range(len(rows))]
    path = scratch_path(spark, "pages")
    write_pages(exp, path, block=3)
    assert read_page(spark, path, 4, block=3).count() == 20


def test_metric_json_sink(spark, tables):
    path = scratch_path(spark, "gauges")
    write_metric_json(gauge_records(tables), path)
    back = spark.read.json(path)
    assert back.count() == tables["request_events"].count()
    assert set(back.columns) == {"name", "type", "value", "timestamp", "attributes"}


def test_generator_shape_and_load(spark):
    g = generate_hr(spark, 2000, seed=7)
    e, s, de = g["employees"], g["salaries"], g["dept_emp"]
    assert e.count() == 2000 and de.count() == 2000
    n = s.count()
    assert 2000 <= n <= 8000
    assert s.agg(F.min("salary"), F.max("salary")).first() >= (30000, 0)
    assert g["departments"].count() == 5
    empty = spark.createDataFrame([], e.schema)
    loaded = insert_if_absent(empty, e, ["emp_no"])
    assert quality.duplicate_keys(loaded, ["emp_no"]).count() == 0
    assert loaded.count() == e.select("emp_no").distinct().count()
    assert generate_hr(spark, 2000, seed=7)["salaries"].exceptAll(s).count() == 0  # deterministic


def test_changes_keep_one_open_row_per_key(spark, tables):
    def open_per_key(df, keys):
        return df.filter(F.col("to_date") == OPEN_END).groupBy(*keys).count().filter("count > 1").count()

    before = open_per_key(tables["dept_emp"], ["emp_no"])
    assert open_per_key(changes.transfer(tables), ["emp_no"]) <= before
    assert open_per_key(changes.update_salary(tables, emp_no=10003, salary=1), ["emp_no"]) == 0
    assert open_per_key(changes.salary_adjust(tables), ["emp_no"]) == 0
    new_titles = changes.bulk_title_update(tables)
    assert open_per_key(new_titles, ["emp_no", "title"]) == 0
    t2 = tables.with_tables(salaries=changes.update_salary(tables, emp_no=10003, salary=1))
    assert quality.dq_interval_overlaps(t2, "salaries").count() == 0
    bad = tables.with_tables(salaries=tables["salaries"].withColumn("to_date", F.lit(OPEN_END)))
    assert quality.dq_interval_overlaps(bad, "salaries").count() > 0


def test_update_salary_seeded_pick_is_reproducible(spark, tables):
    a = changes.update_salary(tables, emp_no=None, salary=None, seed=3)
    b = changes.update_salary(tables, emp_no=None, salary=None, seed=3)
    base = tables["salaries"].select("emp_no", "salary", "from_date", "to_date")
    new_a, new_b = a.exceptAll(base).collect(), b.exceptAll(base).collect()
    opened = [r for r in new_a if r.to_date.year == 9999]
    assert sorted(new_a) == sorted(new_b) and len(opened) == 1 and opened[0].from_date == dt.date(2001, 8, 1)


def test_log_maintenance_appends_with_duration(spark):
    from tenure.schema import MAINTENANCE_LOG

    log = spark.createDataFrame([], MAINTENANCE_LOG)
    t0, t1 = dt.datetime(2024, 1, 1, 0, 0), dt.datetime(2024, 1, 1, 0, 5)
    log = changes.log_maintenance(log, "Data Load", t0, t1, True)
    log = changes.log_maintenance(log.drop("duration"), "Vacuum", t0)
    rows = sorted(log.collect(), key=lambda r: r.id)
    assert [(r.id, r.operation, r.success) for r in rows] == [(1, "Data Load", True), (2, "Vacuum", False)]
    assert rows[0].duration == dt.timedelta(minutes=5) and rows[1].duration is None
