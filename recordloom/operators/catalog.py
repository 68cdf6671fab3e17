"""Catalog listings, counts and previews."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREVIEW_DEFAULT = 20
PREVIEW_MAX = 1000


def tables_with_columns(
    relations: DataFrame,
    namespaces: DataFrame,
    columns: DataFrame,
    system_schemas: list[str] | None = None,
) -> DataFrame:
    """``(schema, table_name, estimated_rows, columns)``.

    ``relations(table_id, namespace_id, table_name, kind, estimated_rows)``,
    ``namespaces(namespace_id, schema)``, ``columns(table_id, ordinal, name, type)``.
    Views, system schemas and internal tables are left out; an unknown estimate
    is negative and becomes NULL; tables without columns stay.
    """
    shown = relations.filter((F.col("kind") == "table") & ~F.col("table_name").like("sqlite\\_%"))
    spaces = namespaces
    if system_schemas:
        spaces = spaces.filter(~F.col("schema").isin(*system_schemas))
    tables = shown.join(spaces, "namespace_id", "inner")
    # Bounded by the width of one table.
    grouped = columns.groupBy("table_id").agg(
        F.array_sort(F.collect_list(F.struct("ordinal", "name", "type"))).alias("columns")
    )
    return tables.join(grouped, "table_id", "left").select(
        "schema",
        "table_name",
        F.when(F.col("estimated_rows") >= 0, F.col("estimated_rows")).alias("estimated_rows"),
        "columns",
    )


def primary_key_flag(columns: DataFrame, constraints: DataFrame, usage: DataFrame) -> DataFrame:
    """``columns`` with ``is_pk``: is there a primary key that uses the column?

    ``constraints(schema, table_name, constraint_name, constraint_type)`` and
    ``usage(schema, table_name, constraint_name, column_name)``.
    """
    link = ["schema", "table_name", "constraint_name"]
    used = (
        constraints.filter(F.col("constraint_type") == "PRIMARY KEY")
        .join(usage, link)
        .select("schema", "table_name", F.col("column_name").alias("name"), F.lit(True).alias("_pk"))
        .distinct()
    )
    return (
        columns.join(used, ["schema", "table_name", "name"], "left")
        .withColumn("is_pk", F.coalesce("_pk", F.lit(False)))
        .drop("_pk")
    )


def is_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: whether ``keys`` identify the rows, from the data."""
    counts = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        F.coalesce(F.max("n") <= 1, F.lit(True)).alias("is_unique"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.count(F.lit(1)).alias("keys"),
    )


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Exact ``(table_name, rows)``; nothing but the row count is read."""
    counted = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counted)


def label_counts(nodes: DataFrame) -> DataFrame:
    """Nodes per label; a node counts under each of its labels."""
    return nodes.select(F.explode("_labels").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("nodes"))


def edge_type_counts(edges: DataFrame) -> DataFrame:
    """Relationships per type; lines that are none are left out where the frame says so."""
    good = edges.filter("error IS NULL") if "error" in edges.columns else edges
    return good.groupBy(F.col("_type").alias("type")).agg(F.count(F.lit(1)).alias("edges"))


def index_listing(stats: DataFrame, aliases: DataFrame, fields: DataFrame) -> DataFrame:
    """Index statistics with their aliases and fields.

    ``stats(index, health, docs, size)`` has numbers as text, which become
    numbers or NULL; ``aliases(index, alias)``, ``fields(index, name, type)``.
    """
    alias_lists = (
        aliases.filter((F.length("index") > 0) & (F.length("alias") > 0))
        .groupBy("index")
        .agg(F.array_sort(F.collect_list("alias")).alias("aliases"))
    )
    field_lists = fields.groupBy("index").agg(
        F.array_sort(F.collect_list(F.struct("name", "type"))).alias("fields")
    )
    number = lambda c: F.when(F.length(F.trim(c)) > 0, F.col(c).try_cast("double"))
    return (
        stats.select("index", "health", number("docs").alias("docs"), number("size").alias("size"))
        .join(alias_lists, "index", "left")
        .join(field_lists, "index", "left")
        .withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))
        .withColumn("fields", F.coalesce("fields", F.array().cast("array<struct<name:string,type:string>>")))
    )


def clamp_preview(n: float | None) -> int:
    if n is None or not math.isfinite(n):
        return PREVIEW_DEFAULT
    return max(1, min(int(n), PREVIEW_MAX))


def preview(df: DataFrame, n: float | None = None, order: list | None = None) -> DataFrame:
    """The first rows, 1 to 1000 of them, in a given order if there is one."""
    rows = df.orderBy(*order) if order else df
    return rows.limit(clamp_preview(n))


def recent_topk(df: DataFrame, by: str, k: int = 5, ties: list | None = None) -> DataFrame:
    """The ``k`` newest rows; ties in the given order."""
    return df.orderBy(F.col(by).desc(), *(ties or [])).limit(k)


def count_by_type(df: DataFrame, column: str) -> DataFrame:
    """``(type, n)`` per value and a ``*total*`` row."""
    return df.rollup(column).agg(F.count(F.lit(1)).alias("n"), F.grouping(column).alias("_g")).select(
        F.when(F.col("_g") == 1, "*total*").otherwise(F.col(column)).alias("type"), "n"
    )
