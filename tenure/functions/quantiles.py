"""Exact per-group percentiles (``percentile_cont``: linear interpolation between ranks).

Three forms with the same result: ``percentile_narrowed`` narrows the range of values in which the wanted ranks lie, round
after round, so no task orders a group or a crowded range, at the price of jobs while the query is built;
``percentile_cont`` is one lazy plan over ranges of width 1, for values that spread; ``percentile_small`` is Spark's own aggregate, for groups
that are small by their definition (it holds a count of each distinct value of a group in one task).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenure.session import ensure_checkpoint_dir

RANGES = 1024  # histogram ranges of a group and round
MOST = 4096  # distinct values of a range that are ordered
ROUNDS = 64


def percentile_small(value: str | Column, p: float) -> Column:
    """The aggregate for groups with few distinct values each."""
    return F.percentile(value, p)


def _histogram(values: DataFrame, group: list[str], bounds: DataFrame) -> DataFrame:
    """Per group and range of its bounds: rows, distinct values, smallest and largest value (sums on the map side)."""
    keyed = values.join(bounds, group)
    width = (F.col("_high") - F.col("_low")) / F.lit(float(RANGES))
    place = F.when(width > 0, F.least(F.floor((F.col("_v") - F.col("_low")) / width), F.lit(RANGES - 1))).otherwise(F.lit(0))
    inside = keyed.filter((F.col("_v") >= F.col("_low")) & (F.col("_v") <= F.col("_high"))).withColumn("_range", place)
    return inside.groupBy(*group, "_range").agg(F.sum("_c").alias("_c"), F.count(F.lit(1)).alias("_values"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))


def _narrowed(histogram: DataFrame, group: list[str], state: DataFrame) -> DataFrame:
    """The bounds of the next round: the range that holds the wanted rank, and the rows below it.

    A group has at most ``RANGES`` rows here, which are put in order as one array.
    """
    cells = histogram.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("_range", "_c", "_values", "_min", "_max"))).alias("_cells"))
    joined = cells.join(state.select(*group, "_rank", "_before"), group)
    walked = F.aggregate(
        "_cells", F.struct(F.col("_before").alias("upto"), F.col("_before").alias("before"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(0).cast("long").alias("values")),
        lambda a, c: F.struct(
            (a["upto"] + c["_c"]).alias("upto"),
            F.when(a["upto"] <= F.col("_rank"), a["upto"]).otherwise(a["before"]).alias("before"),
            F.when(a["upto"] <= F.col("_rank"), c["_min"]).otherwise(a["low"]).alias("low"),
            F.when(a["upto"] <= F.col("_rank"), c["_max"]).otherwise(a["high"]).alias("high"),
            F.when(a["upto"] <= F.col("_rank"), c["_values"]).otherwise(a["values"]).alias("values"),
        ),
    )
    w = joined.select(*group, "_rank", walked.alias("_w"))
    return w.select(*group, "_rank", F.col("_w.before").alias("_before"), F.col("_w.low").alias("_low"), F.col("_w.high").alias("_high"), F.col("_w.values").alias("_values"))


def percentile_narrowed(df: DataFrame, group: list[str], value: str, p: float, name: str) -> DataFrame:
    """Per group: the ``p`` quantile of ``value`` with linear interpolation (NULLs ignored).

    Rows are counted by distinct value once. A round cuts the range that holds the wanted rank (all values, at
    first) into ``RANGES`` equal ranges, counts them, and keeps the one with the rank, shrunk to the values in
    it; so a skewed range narrows like any other, until it holds at most ``MOST`` distinct values. Only
    those are ordered, and the next value above them is found by a minimum. The rounds are jobs over the counts,
    checkpointed; groups need not be few, only the bounds of each are kept.
    """
    if not group:
        return percentile_narrowed(df.withColumn("_all", F.lit(1)), ["_all"], value, p, name).drop("_all")
    # Null group keys must meet in joins, so a group goes by its values as text.
    ensure_checkpoint_dir(df.sparkSession)
    keyed = df.filter(F.col(value).isNotNull()).select(F.struct(*group).alias("_group"), F.col(value).cast("double").alias("_v"))
    keyed = keyed.withColumn("_key", F.to_json("_group", {"ignoreNullFields": "false"}))
    values = keyed.groupBy("_key", "_v").agg(F.count(F.lit(1)).alias("_c"), F.first("_group").alias("_group")).checkpoint()
    state = values.groupBy("_key").agg(F.sum("_c").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.count(F.lit(1)).alias("_values"), F.first("_group").alias("_group"))
    names = state.select("_key", "_group", "_n")
    pos = (F.col("_n") - 1) * F.lit(p)
    state = state.select("_key", F.floor(pos).alias("_rank"), F.lit(0).cast("long").alias("_before"), "_low", "_high", "_values")
    for _ in range(ROUNDS):
        state = state.checkpoint()
        if state.filter(F.col("_values") > MOST).isEmpty():
            break
        wide = state.filter(F.col("_values") > MOST)
        found = _narrowed(_histogram(values, ["_key"], wide.select("_key", "_low", "_high")), ["_key"], wide)
        state = state.filter(F.col("_values") <= MOST).unionByName(found)
    # The few values of the last range, in order; beyond them the next larger value of the group.
    near = values.join(state, "_key").filter(F.col("_v") >= F.col("_low"))
    last = near.groupBy("_key").agg(
        F.sort_array(F.collect_list(F.when(F.col("_v") <= F.col("_high"), F.struct("_v", "_c")))).alias("_few"),
        F.min(F.when(F.col("_v") > F.col("_high"), F.col("_v"))).alias("_next"), F.first("_rank").alias("_rank"), F.first("_before").alias("_before"),
    )

    def at(rank: Column) -> Column:
        walk = F.aggregate(
            "_few", F.struct(F.col("_before").alias("upto"), F.lit(None).cast("double").alias("v")),
            lambda a, x: F.struct((a["upto"] + x["_c"]).alias("upto"), F.when((a["upto"] <= rank) & (rank < a["upto"] + x["_c"]), x["_v"]).otherwise(a["v"]).alias("v")),
        )
        return F.coalesce(walk["v"], F.col("_next"))

    out = last.join(names, "_key").withColumn("_lo", at(F.col("_rank"))).withColumn("_hi", F.coalesce(at(F.col("_rank") + 1), F.col("_lo")))
    return out.select(*[F.col(f"_group.{g}").alias(g) for g in group], (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (pos - F.floor(pos))).alias(name))


def percentile_cont(df: DataFrame, group: list[str], value: str, p: float, name: str) -> DataFrame:
    """Per group: the ``p`` quantile of ``value`` with linear interpolation (NULLs ignored).

    One lazy plan: counts by distinct value, then by whole number, and only the whole numbers of the wanted ranks are ordered.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_c"))
    counts = counts.withColumn("_range", F.floor(value))
    whole = Window.partitionBy(*group)
    before = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    pos = (F.sum("_c").over(whole) - 1) * F.lit(p)
    ranges = counts.groupBy(*group, "_range").agg(F.sum("_c").alias("_c")).select(
        *group, "_range", F.col("_c").alias("_size"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_start"), pos.alias("_pos"))
    ranges = ranges.select("*", F.floor("_pos").alias("_lo"), F.ceil("_pos").alias("_hi"), (F.col("_pos") - F.floor("_pos")).alias("_frac"))
    ranges = ranges.filter((F.col("_lo") < F.col("_start") + F.col("_size")) & (F.col("_hi") >= F.col("_start")))
    near = counts.join(ranges, [*group, "_range"])
    upto = Window.partitionBy(*group, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("_end", F.col("_start") + F.sum("_c").over(upto))

    def at(rank: str):
        return F.max(F.when((F.col(rank) < F.col("_end")) & (F.col(rank) >= F.col("_end") - F.col("_c")), F.col(value)))

    lo, hi = at("_lo"), at("_hi")
    return near.groupBy(*group).agg((lo + (hi - lo) * F.first("_frac")).alias(name))
