"""Small shared helpers: table access, the shared scratch folder, free column names."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenure.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """Table ``name`` under ``sf_dir`` (any path Spark reads), only ``cols`` when given."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*cols) if cols else df


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    name = f"__{stem}"
    while name.lower() in taken:
        name += "_"
    return name


def held_out_fold(doc_id: Column | str, folds: int, fold: int = 2) -> Column:
    """True where crc32 of the id as text falls in ``fold`` of ``folds``; a null id is in no fold."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % F.lit(folds) == F.lit(fold), F.lit(False))


def staged(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """``df`` written to the shared folder and read back: later steps start from the files.

    The folder is ``spark.checkpoint.dir``, which every executor sees, so a lost
    executor costs only its running tasks.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_parts(spark: SparkSession) -> int:
    """The session's shuffle width: how many parts hash- or range-partitioned work is cut into."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
