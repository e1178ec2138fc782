"""Dense global numbering without a single-partition window.

The rows are range-sorted once and written with ``(part, loc)``: the sorted partition and the place in
it. A dense number is the place plus the count of all earlier partitions; those counts are one row per
partition (and group), so the offset table is small whatever the data size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import stage

_LOCAL_BITS = 33  # layout of monotonically_increasing_id


def sequence_table(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Stage ``df`` in the given total order with its position as ``part`` and ``loc``."""
    placed = df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id())
    placed = placed.select(
        *df.columns,
        F.shiftright("_mid", _LOCAL_BITS).alias("part"),
        F.col("_mid").bitwiseAND((1 << _LOCAL_BITS) - 1).alias("loc"),
    )
    return stage(placed, name)


def with_dense_number(seq: DataFrame, name: str, base: Column | int = 0) -> DataFrame:
    """Add ``name`` = 1, 2, 3 … over the whole sequence table, plus ``base``."""
    counts = seq.groupBy("part").count()
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_off"))
    base = F.lit(base) if isinstance(base, int) else base
    return (
        seq.join(F.broadcast(offsets), "part")
        .withColumn(name, F.col("_off") + F.col("loc") + 1 + base)
        .drop("_off")
    )


def with_group_number(seq: DataFrame, group: str, name: str) -> DataFrame:
    """Add ``name`` = 1, 2, 3 … inside each ``group`` value, in sequence order.

    The window key holds the sorted partition as well, so one hot group is spread over all partitions.
    """
    counts = seq.groupBy("part", group).count()
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "part", group, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_off")
    )
    local = Window.partitionBy("part", group).orderBy("loc")
    return (
        seq.withColumn("_rn", F.row_number().over(local))
        .join(F.broadcast(offsets), ["part", group])
        .withColumn(name, F.col("_off") + F.col("_rn"))
        .drop("_off", "_rn")
    )
