"""Spark session defaults and the shared checkpoint location."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings the library relies on. On a cluster, the deployment owns them; we
# only fill in what is unset.
SESSION_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "tenure") -> SparkSession:
    """A local session for tests and the bench (never used on a cluster)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in SESSION_DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def apply_defaults(spark: SparkSession) -> SparkSession:
    """Set library defaults on an existing session where the key is unset."""
    for k, v in SESSION_DEFAULTS.items():
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder: ``spark.checkpoint.dir`` from the session.

    On a cluster the deployment sets it to a shared filesystem and we use it
    as is. Only when it is unset (local tests) do we pick a folder, and then
    only on this SparkContext (the setting itself cannot change at run time).
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: the server owns checkpointing
        if not path:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the server and all executors share") from None
        return path
    current = sc.getCheckpointDir()
    if path:
        if not current:
            sc.setCheckpointDir(path)
        return path
    if current:
        return current
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = _fallback_dir()
    sc.setCheckpointDir(path)
    return path


_FALLBACK: list[str] = []


def _fallback_dir() -> str:
    if not _FALLBACK:
        _FALLBACK.append(tempfile.mkdtemp(prefix="tenure-ckpt-"))
    return _FALLBACK[0]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint location for written tables."""
    base = ensure_checkpoint_dir(spark)
    sub = f"{name}-{os.getpid()}-{next(_counter)}"
    return base.rstrip("/") + "/" + sub


def _count():
    i = 0
    while True:
        i += 1
        yield i


_counter = _count()
