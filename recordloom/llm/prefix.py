"""Running sums over a global order, without a window that gathers all rows or all rows of one group in a task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.session import cut_lineage


def running_sum(df: DataFrame, order: list[str | Column], value: str, name: str, group: str | None = None) -> DataFrame:
    """Append the sum of `value` over all rows up to and including this one in the order of `order`, within `group`.

    Rows are range-partitioned by the order and kept in the shared folder, so that the ranges are the same for both reads. One
    sum per range and group gives the offsets, a table of at most ranges + groups rows; a running sum inside each
    range gives the rest. A group of any size is spread over as many ranges as it needs. Rows that tie in the whole order
    may change places among themselves.
    """
    keys = ([F.col(group)] if group else []) + [F.col(k) if isinstance(k, str) else k for k in order]
    ranged = cut_lineage(df.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()))
    part = ["_range"] + ([group] if group else [])
    sums = ranged.groupBy(*part).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*([group] if group else [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        F.col("_range").alias("_at"), *([F.col(group).alias("_of")] if group else []), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset")
    )
    # A null group is a group.
    match = (F.col("_range") == F.col("_at")) & (F.col(group).eqNullSafe(F.col("_of")) if group else F.lit(True))
    inside = Window.partitionBy(*part).orderBy(*keys[1 if group else 0:]).rowsBetween(Window.unboundedPreceding, 0)
    return (
        ranged.withColumn("_inside", F.sum(value).over(inside))
        .join(offsets, match)
        .withColumn(name, F.col("_inside") + F.col("_offset"))
        .drop("_inside", "_offset", "_range", "_at", "_of")
    )
