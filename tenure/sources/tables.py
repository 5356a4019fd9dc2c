"""Table access: a dict of DataFrames with cached, proven size bounds."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

DRIVER_TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one parquet table by name (column pruning and filters reach the scan)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


class Tables(dict):
    """Named DataFrames plus memoised row-count bounds.

    ``rows_at_most(name, n)`` runs one early-stopping job (``limit(n + 1).count()``)
    per table and threshold, so broadcast decisions rest on a checked size and
    never on a guess.
    """

    def __init__(self, frames: Mapping[str, DataFrame] | None = None):
        super().__init__(frames or {})
        self._bounds: dict[tuple[str, int], bool] = {}

    def rows_at_most(self, name: str, n: int) -> bool:
        key = (name, n)
        if key not in self._bounds:
            self._bounds[key] = self[name].limit(n + 1).count() <= n
        return self._bounds[key]

    def with_tables(self, **frames: DataFrame) -> "Tables":
        """A copy with some tables replaced (a new table version)."""
        out = Tables({**self, **frames})
        out._bounds = {k: v for k, v in self._bounds.items() if k[0] not in frames}
        return out


def missing_path(e: AnalysisException) -> bool:
    """Whether a read failed because its path is absent or holds no data yet."""
    return e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


HR_TABLES = ("employees", "departments", "dept_emp", "salaries", "titles", "dept_manager", "request_events")


def stored_tables(spark: SparkSession, path: str, names: tuple[str, ...] = HR_TABLES) -> Tables:
    """HR tables stored as ``<path>/<name>`` parquet directories (those present are loaded).

    ``salaries_multi`` (the hierarchy report's input) defaults to ``salaries``.
    """
    out = {}
    for name in names:
        try:
            out[name] = spark.read.parquet(f"{path.rstrip('/')}/{name}")
        except AnalysisException as e:
            if not missing_path(e):
                raise  # present but unreadable
    if "salaries" in out:
        out.setdefault("salaries_multi", out["salaries"])
    return Tables(out)
