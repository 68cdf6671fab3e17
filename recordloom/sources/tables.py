"""Table, metastore and CSV scans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_SLICES = 32


def read_csv_table(spark: SparkSession, path: str | list[str], line_breaks: bool = False) -> DataFrame:
    """CSV (RFC 4180) with a header; every value stays text, short rows end in NULL.

    Quotes inside a quoted field are doubled.  A quoted empty field is empty text, an unquoted one NULL.  ``line_breaks`` allows line
    breaks inside quotes, at a cost: a file is then one task, so large inputs should come as many files.
    """
    return (
        spark.read.option("header", True)
        .option("mode", "PERMISSIVE")
        .option("inferSchema", False)
        .option("enforceSchema", True)
        .option("multiLine", line_breaks)
        .option("quote", '"')
        .option("escape", '"')
        .option("nullValue", "\0")
        .option("emptyValue", "")
        .csv(path)
    )


def jdbc_options(
    url: str,
    table: str,
    key: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int | None = None,
    fetch_rows: int = 10_000,
    **extra: str,
) -> dict[str, str]:
    """Reader options for one table, split by ``key`` over ``bounds`` when given."""
    options = {"url": url, "dbtable": table, "fetchsize": str(fetch_rows), **extra}
    if partitions and partitions > 1:
        if key is None or bounds is None:
            raise ValueError("a partitioned scan needs a key and its bounds")
        options |= {
            "partitionColumn": key,
            "lowerBound": str(bounds[0]),
            "upperBound": str(bounds[1]),
            "numPartitions": str(partitions),
        }
    return options


def scan_table(
    spark: SparkSession,
    source: str,
    fmt: str = "parquet",
    where: str | None = None,
    columns: list[str] | None = None,
    options: dict[str, str] | None = None,
) -> DataFrame:
    """Full scan of a table with the filter and the columns pushed to the source.

    ``fmt='jdbc'`` takes its options from :func:`jdbc_options`.
    """
    reader = spark.read.format(fmt).options(**(options or {}))
    df = reader.load() if fmt == "jdbc" else reader.load(source)
    if where and where.strip():
        df = df.filter(F.expr(where))
    return df.select(*columns) if columns else df


def _is_nested(dt: T.DataType) -> bool:
    return isinstance(dt, (T.ArrayType, T.MapType, T.StructType, T.VariantType))


def normalise_for_export(df: DataFrame) -> DataFrame:
    """Big integers to text, nested values to JSON text, the rest unchanged."""

    def column(field: T.StructField) -> Column:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.LongType):
            return c.cast("string").alias(field.name)
        if _is_nested(field.dataType):
            return F.to_json(c, {"ignoreNullFields": "false"}).alias(field.name)
        return c

    return df.select(*[column(f) for f in df.schema.fields])


def scan_metastore_table(
    spark: SparkSession, table: str, where: str | None = None, columns: list[str] | None = None
) -> DataFrame:
    df = spark.table(table)
    if where and where.strip():
        df = df.filter(F.expr(where))
    if columns:
        df = df.select(*columns)
    return normalise_for_export(df)


def slice_of(key: Column, n: int) -> Column:
    if not 1 <= n <= MAX_SLICES:
        raise ValueError(f"slices must be between 1 and {MAX_SLICES}")
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def sliced_scan(df: DataFrame, n: int, key: str, slice_expr: Column | None = None) -> DataFrame:
    """The same rows with the disjoint slice ``0..n-1`` each belongs to.

    The slice is a narrow column: nothing is shuffled until a sink asks for
    one folder per slice with ``partitionBy('slice')``.
    """
    chosen = slice_of(F.col(key), n) if slice_expr is None else slice_expr
    return df.withColumn("slice", chosen)


def scan_many(tables: dict[str, DataFrame]) -> DataFrame:
    """One row ``(table_name, rows, bytes)`` per table plus a ``*total*`` row.

    ``bytes`` is the size of the rows as JSON lines, newline included.  Each
    table is reduced to one row where it is read before the union.
    """

    def stats(name: str, df: DataFrame) -> DataFrame:
        line = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
        return df.agg(
            F.count(F.lit(1)).alias("rows"),
            F.coalesce(F.sum(F.octet_length(line) + 1), F.lit(0)).cast("bigint").alias("bytes"),
        ).select(F.lit(name).alias("table_name"), "rows", "bytes")

    each = reduce(DataFrame.unionByName, [stats(n, d) for n, d in tables.items()])
    return each.rollup("table_name").agg(
        F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes")
    ).select(F.coalesce("table_name", F.lit("*total*")).alias("table_name"), "rows", "bytes")
