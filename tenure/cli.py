"""Run registered reports as a Spark job: ``spark-submit --py-files tenure.zip tenure/cli.py`` or ``python -m tenure.cli``.

Examples::

    python -m tenure.cli --tables /data/hr --out /data/reports pay_department_avg dept_stats
    python -m tenure.cli --fixture /root/testdata/sf0.01 --out /tmp/reports --all

Each report is written as parquet under ``<out>/<report>``; nothing is
collected to the driver.
"""

from __future__ import annotations

import argparse
import datetime as dt
import inspect
import sys

from pyspark.sql import SparkSession

from tenure.catalog import REPORTS
from tenure.session import apply_defaults, ensure_checkpoint_dir
from tenure.sources.fixture import hr_tables
from tenure.sources.tables import stored_tables


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tenure", description=__doc__.splitlines()[0])
    src = p.add_mutually_exclusive_group(required=True)
    src.add_argument("--tables", help="directory holding <name>/ parquet tables")
    src.add_argument("--fixture", help="driver-table directory to derive the HR tables from")
    p.add_argument("--out", required=True, help="output directory (one sub-directory per report)")
    p.add_argument("--as-of", default=None, help="report date YYYY-MM-DD (default 2001-08-01)")
    p.add_argument("--format", default="parquet", choices=["parquet", "json", "csv"])
    p.add_argument("--all", action="store_true", help="run every registered report")
    p.add_argument("reports", nargs="*")
    a = p.parse_args(argv)
    names = list(REPORTS) if a.all else a.reports
    unknown = [n for n in names if n not in REPORTS]
    if unknown or not names:
        p.error(f"unknown or missing reports: {unknown or 'none given'}")
    spark = SparkSession.builder.appName("tenure").getOrCreate()
    apply_defaults(spark)
    ensure_checkpoint_dir(spark)
    t = hr_tables(spark, a.fixture) if a.fixture else stored_tables(spark, a.tables)
    for name in names:
        fn = REPORTS[name]
        kwargs = {}
        if a.as_of and "as_of" in inspect.signature(fn).parameters:
            kwargs["as_of"] = dt.date.fromisoformat(a.as_of)
        df = fn(t, **kwargs)
        df.write.mode("overwrite").format(a.format).option("header", "true").save(f"{a.out.rstrip('/')}/{name}")
        print(f"{name}: written", file=sys.stderr)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
