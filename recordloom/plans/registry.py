"""Named queries over the sample tables, each with the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} exists")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def lines_of(df: DataFrame, number: Column | str, text: Column | None = None, file: Column | None = None) -> DataFrame:
    """The rows of a table as JSON lines with a line number taken from a column."""
    value = F.to_json(F.struct("*"), {"ignoreNullFields": "false"}) if text is None else text
    number = F.col(number) if isinstance(number, str) else number
    return df.select(
        (F.lit("table") if file is None else file).alias("file"),
        number.cast("bigint").alias("line_no"),
        value.alias("value"),
    )


def get(name: str, ddl: str, rec: str = "rec") -> Column:
    """Typed value of a record key."""
    return F.try_variant_get(F.try_element_at(rec, F.lit(name)), "$", ddl)
