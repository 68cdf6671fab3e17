"""Exact positions in a global order without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from recordloom.session import cut_lineage


def _hashable(kind: DataType) -> bool:
    if isinstance(kind, ArrayType):
        return _hashable(kind.elementType)
    if isinstance(kind, StructType):
        return all(_hashable(f.dataType) for f in kind.fields)
    return not isinstance(kind, (MapType, VariantType))


def content_hash(df: DataFrame) -> Column:
    """A hash of all columns; maps and dynamic values count by their JSON text."""
    parts = [F.col(f"`{f.name}`") if _hashable(f.dataType) else F.to_json(F.struct(F.col(f"`{f.name}`"))) for f in df.schema.fields]
    return F.xxhash64(*parts) if parts else F.lit(0)


def with_ordinal(df: DataFrame, keys: list[str | Column], name: str = "ordinal") -> DataFrame:
    """Append the 0-based position of every row in the order of ``keys``.

    Rows are range-partitioned and sorted once and kept in the shared folder,
    since the sampled ranges of a second run could differ.  Only one count per
    partition is then summed up; that small table (bounded by the number of
    partitions) gives each partition its offset.  Rows with equal keys are put
    in order by a hash of all they hold, so ranges are cut inside a hot key
    too, and a second run gives every row its position again (rows that are
    equal in all columns may swap theirs).
    """
    order = [*keys, F.col("_tie")]
    ordered = (
        df.withColumn("_tie", content_hash(df))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .drop("_tie")
        .withColumn("_at", F.monotonically_increasing_id())
    )
    ordered = cut_lineage(ordered)
    part = F.shiftright(F.col("_at"), 33)
    counts = ordered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset"))
    local = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        ordered.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, local + F.col("_offset"))
        .drop("_at", "_part", "_offset")
    )
