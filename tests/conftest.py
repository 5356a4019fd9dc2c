from __future__ import annotations

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tenure.catalog import tables_for  # noqa: E402
from tenure.session import local_session  # noqa: E402
from tenure.sources.tables import DRIVER_TABLES  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_MED = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = local_session(cores="*", shuffle_partitions=8, app="tenure-tests")
    yield s


@pytest.fixture(scope="session")
def tables(spark):
    return tables_for(spark, SF_SMALL)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    return con
