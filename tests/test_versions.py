"""Changed rows, and stored tables that rewrite only the buckets a change touches."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.errors import AnalysisException

from tenure.operators import changes
from tenure.plans.inspect import plan_text
from tenure.session import scratch_path
from tenure.sources.versions import BucketedTable

SCHEMA = "emp_no int, salary int"


def _rows(df):
    return Counter(map(tuple, df.collect()))


def _files(df):
    return set(df.inputFiles())


@pytest.mark.parametrize("name", sorted(changes.CHANGES))
def test_old_rows_less_changes_are_the_new_version(tables, name):
    change, table = changes.CHANGES[name]
    new, rows = change(tables), change.changes(tables)
    cols = new.columns
    old = tables[table]
    if "last_modified" in cols:
        old = old.selectExpr("*", "cast(null as timestamp_ntz) as last_modified")
    got = _rows(old.select(*cols))
    got.subtract(_rows(rows.filter("kind <> 'insert'").select(*[f"old_{c}" for c in cols])))
    assert min(got.values()) >= 0
    got.update(_rows(rows.select(*[f"new_{c}" for c in cols])))
    assert +got == _rows(new) 
    assert name == "bulk_title_update" or not rows.isEmpty()  # sf0.001 has no such title


def test_changed_rows_join_only_the_marked_ones(tables):
    text = plan_text(changes.transfer.changes(tables), "simple")
    assert "LeftOuter" not in text


def test_apply_rewrites_touched_buckets_only(spark):
    table = BucketedTable(spark, scratch_path(spark, "cow"), ["emp_no"], buckets=8)
    assert table.version() == -1
    table.create(spark.createDataFrame([(i, i) for i in range(200)] + [(7, 7)], SCHEMA))
    before = _files(table.read())
    delta = spark.createDataFrame(
        [("update", 7, 7, 7, 70), ("insert", None, None, 7, 71), ("delete", 7, 7, None, None)],
        "kind string, old_emp_no int, old_salary int, new_emp_no int, new_salary int",
    )
    assert table.apply(delta, batch="a") == 1
    assert _rows(table.read()) == Counter({**{(i, i): 1 for i in range(200) if i != 7}, (7, 70): 1, (7, 71): 1})
    after = _files(table.read())
    bucket = spark.createDataFrame([(7,)], "emp_no int").select(table.bucket_of()).first()[0]
    assert all(f"/bucket={bucket}/" in f for f in before ^ after) and before & after
    assert _rows(table.read(0))[(7, 7)] == 2  # the old version is still there
    assert table.apply(delta, batch="a") == 1  # a replayed batch is a no-op
    assert table.apply(delta.limit(0), batch="b") == 2 and _files(table.read()) == after
    assert _files(table.read(buckets={bucket})) < after


def test_insert_if_absent_adds_new_keys_once(spark):
    table = BucketedTable(spark, scratch_path(spark, "load"), ["emp_no"], buckets=8)
    table.create(spark.createDataFrame([], SCHEMA))
    assert table.read().count() == 0
    batch = spark.createDataFrame([(1, 5), (1, 4), (2, 6), (2, 6)], SCHEMA)
    assert table.insert_if_absent(batch, order=["salary"], batch="x") == 1
    assert table.insert_if_absent(batch, order=["salary"], batch="x") == 1
    first = _files(table.read())
    assert table.insert_if_absent(spark.createDataFrame([(1, 1), (3, 3)], SCHEMA), batch="y") == 2
    assert _rows(table.read()) == Counter({(1, 4): 1, (2, 6): 1, (3, 3): 1})
    assert first < _files(table.read())
    with pytest.raises(FileExistsError):
        table.create(batch)


def test_two_writers_of_a_version_collide(spark):
    table = BucketedTable(spark, scratch_path(spark, "race"), ["emp_no"], buckets=2)
    table.create(spark.createDataFrame([(1, 1)], SCHEMA))
    table._publish(1, {(0, 0)}, None)
    with pytest.raises(AnalysisException):
        table._publish(1, {(0, 0)}, None)
