"""Key ranges at the scan, and loads that are counted while they are written."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tenure.functions.keyfilter import in_ranges, ranges_of, ranges_of_list
from tenure.operators.reports_pay import pay_lookup_many
from tenure.plans.inspect import pushed_filters
from tenure.session import scratch_path
from tenure.sources.sinks import materialize_tables, write_verified


@given(st.lists(st.integers(-(2**31), 2**31 - 1), max_size=200), st.integers(1, 20))
@settings(max_examples=200, deadline=None)
def test_ranges_hold_every_key_and_are_apart(keys, most):
    ranges = ranges_of_list(keys, most)
    assert len(ranges) <= most and all(any(a <= k <= b for a, b in ranges) for k in keys)
    assert all(b < c for (_, b), (c, _) in zip(ranges, ranges[1:]))
    if len(set(keys)) <= most:
        assert sum(b - a + 1 for a, b in ranges) == len(set(keys))


@pytest.mark.parametrize("keys", [[], [None], [5], [5, 5, None, 6], [-(2**63), 2**63 - 1], list(range(0, 5000, 7))])
def test_ranges_of_a_column(spark, keys):
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    ranges = ranges_of(df, "k", 8)
    known = [k for k in keys if k is not None]
    assert len(ranges) <= 8 and all(any(a <= k <= b for a, b in ranges) for k in known) and bool(ranges) == bool(known)
    assert df.filter(in_ranges("k", ranges)).count() == len(known)


def _rows_scanned(df):
    """Rows that came out of the file scans of an executed query."""
    df.collect()
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        elif kind == "FileSourceScanExec":
            total += node.metrics().get("numOutputRows").get().value()
        else:
            children = node.children()
            todo += [children.apply(i) for i in range(children.size())]
    return total


def test_row_groups_outside_the_ranges_are_not_read(spark):
    path = scratch_path(spark, "sorted")
    n = 400_000
    spark.range(n).select(F.col("id").cast("int").alias("emp_no"), F.hash("id").alias("x")).coalesce(1).write.option(
        "parquet.block.size", 64 * 1024).option("parquet.page.size", 8 * 1024).parquet(path)
    table = spark.read.parquet(path)
    few = ranges_of_list([7, 200_000, 399_999])
    assert _rows_scanned(table.filter(in_ranges("emp_no", few))) < n / 4
    many = spark.range(100_000).selectExpr("if(id < 50000, id, id + 300000) as k")  # both ends, not the middle
    got = table.filter(in_ranges("emp_no", ranges_of(many, "k")))
    assert _rows_scanned(got) < n / 2 and got.count() == 100_000


def test_lookup_pushes_ranges_into_both_scans(spark, tables):
    stored = materialize_tables(tables, scratch_path(spark, "lookup"), ["employees", "salaries"])
    for ids in (None, spark.range(10001, 10021), [10001, 10005, 2**40]):
        df = pay_lookup_many(stored, emp_nos=ids)
        assert sum("emp_no" in p and "1000" in p for p in pushed_filters(df)) >= 2
        want = [10001, 10005] if isinstance(ids, list) else list(range(10001, 10021))
        assert df.select("emp_no").distinct().count() == tables["employees"].filter(F.col("emp_no").isin(want)).join(
            stored["salaries"].filter("to_date = date'9999-01-01'"), "emp_no", "left_semi").count()
    assert pay_lookup_many(stored, emp_nos=[]).count() == 0


def test_a_load_is_counted_while_it_is_written(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (None, None)], "row_count int, nulls string")  # clashing names
    path = scratch_path(spark, "verified")
    assert write_verified(df, path, ["row_count", "nulls"]) == (3, {"row_count": 2, "nulls": 1})
    assert write_verified(df.limit(0), path + "-empty", ["nulls"]) == (0, {"nulls": 0})
    assert spark.read.parquet(path).count() == 3
    with pytest.raises(AnalysisException):
        write_verified(df, path, [])
