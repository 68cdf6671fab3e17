"""Row checks: unknown columns, conversion failures, dead letters, target validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.sources.records import META


class RowError(ValueError):
    """The first bad row of an import that must not continue."""


def unknown_names(columns: list[str], rec: str | Column = "rec") -> Column:
    return F.array_except(F.map_keys(rec), F.array(*[F.lit(c) for c in columns]))


def column_error(what: str, names: Column) -> Column:
    return F.concat(
        F.lit("line "), F.col("line_no").cast("string"), F.lit(f" {what}: "), F.array_join(names, ", ")
    )


def reject_unknown_columns(records: DataFrame, columns: list[str]) -> DataFrame:
    """Set ``error`` on records with keys the target does not have."""
    extra = unknown_names(columns)
    found = F.when(F.size(extra) > 0, column_error("has columns the target lacks", extra))
    return records.withColumn("error", F.coalesce(F.col("error"), found))


def first_failure(records: DataFrame) -> DataFrame:
    """At most one row: the error of the first bad record in file order."""
    return (
        records.filter(F.col("error").isNotNull())
        .agg(F.min(F.struct(*META, "error")).alias("first"))
        .filter(F.col("first").isNotNull())
        .select("first.*")
    )


def fail_fast(records: DataFrame) -> DataFrame:
    """Return the records unchanged, or raise the first error there is."""
    found = first_failure(records).head()
    if found is not None:
        raise RowError(found["error"])
    return records


def split_good(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good records and dead letters ``(file, line_no, row_idx, column_name, error)``."""
    good = records.filter(F.col("error").isNull()).drop("error", "error_column")
    column = F.col("error_column") if "error_column" in records.columns else F.lit(None).cast("string")
    dead = records.filter(F.col("error").isNotNull()).select(
        *META, column.alias("column_name"), "error"
    )
    return good, dead


def validate_target(requested: DataFrame, targets: DataFrame, catalog_aliases: DataFrame | None = None) -> DataFrame:
    """``(target, name)`` pairs that a request names but its target does not have.

    ``catalog_aliases(alias, target)`` lets a request use either the name of a
    target or one of its aliases.
    """
    if catalog_aliases is not None:
        resolved = requested.join(
            catalog_aliases.select(F.col("alias"), F.col("target").alias("real")),
            requested["target"] == F.col("alias"),
            "left",
        ).select(F.coalesce("real", "target").alias("target"), "name")
    else:
        resolved = requested.select("target", "name")
    return resolved.join(targets.select("target", "name").distinct(), ["target", "name"], "left_anti")
