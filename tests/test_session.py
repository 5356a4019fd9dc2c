"""The checkpoint folder comes from the session; without one, a folder is picked on the SparkContext only."""

from __future__ import annotations

import os
import subprocess
import sys
import tempfile
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").getOrCreate()
import __spark_entry__ as e
assert spark.conf.get("spark.checkpoint.dir", None) is None
print("export", e.queries()["admin_data_export"](spark, "/root/testdata/sf0.001").count())
"""


def test_queries_run_without_a_configured_checkpoint_folder():
    env = dict(os.environ, SPARK_CONF_DIR=tempfile.mkdtemp(prefix="no-spark-defaults-"))
    out = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=str(REPO))], env=env, capture_output=True,
                         text=True, timeout=600)
    assert "export" in out.stdout, out.stderr[-2000:]
