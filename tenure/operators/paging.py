"""Distributed global row numbering (for paged export and LIMIT/OFFSET pages).

``row_number()`` over an un-partitioned window would pull every row into one
task. Instead: range-partition and sort by the order keys, number rows inside
each partition, add the row count of all earlier partitions. The per-partition
counts are one row per partition, so that table is bounded by the partition
count. The numbered data is checkpointed to the shared checkpoint folder so
both uses of it see the same partition layout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenure.session import ensure_checkpoint_dir

_LOCAL_BITS = 33  # monotonically_increasing_id = partition_id << 33 | row position


def with_row_index(df: DataFrame, order: list[str], partitions: int | None = None) -> DataFrame:
    """``df`` plus ``row_index`` (0-based) in the total order ``order``."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    # Range partitions follow the deployment's shuffle width (sized to the data like every
    # other shuffle); callers with a better estimate pass ``partitions``.
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    mid = F.monotonically_increasing_id()
    numbered = ranged.withColumn("_mid", mid).select(
        "*",
        F.shiftright("_mid", _LOCAL_BITS).alias("_pid"),
        (F.col("_mid") - F.shiftleft(F.shiftright("_mid", _LOCAL_BITS), _LOCAL_BITS)).alias("_pos"),
    ).drop("_mid").checkpoint(eager=True)
    counts = numbered.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition: a bounded table, so a global window over it is cheap.
    offsets = counts.select(
        "_pid",
        F.coalesce(
            F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_off"),
    )
    return numbered.join(F.broadcast(offsets), "_pid").select(
        *[c for c in df.columns], (F.col("_off") + F.col("_pos")).alias("row_index")
    )
