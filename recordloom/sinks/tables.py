"""Metastore appends, many-table writes and direct copies."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.functions.names import UNSAFE_FILE_CHARS, UNSAFE_GRAPH_CHARS
from recordloom.sinks.lines import record_lines, write_lines


def _fitted(df: DataFrame, schema: T.StructType) -> tuple[dict[str, Column], Column]:
    """The cell of each table column, and the names of the columns whose value is there but does not fit."""
    have = {c.lower(): c for c in df.columns}
    unknown = [c for c in df.columns if c.lower() not in {f.name.lower() for f in schema.fields}]
    if unknown:
        raise ValueError(f"columns the table lacks: {', '.join(unknown)}")
    cells, misfits = {}, []
    for f in schema.fields:
        if f.name.lower() not in have:
            cells[f.name] = F.lit(None).cast(f.dataType)
            continue
        value = F.col(f"`{have[f.name.lower()]}`")
        cell = value.try_cast(f.dataType)
        if isinstance(f.dataType, T.IntegralType) and isinstance(df.schema[have[f.name.lower()]].dataType, (T.FractionalType, T.StringType)):
            # A cast would cut a fraction.
            cell = F.when(value.try_cast("decimal(38,10)") == cell.cast("decimal(38,10)"), cell)
        cells[f.name] = cell
        misfits.append(F.when(value.isNotNull() & cell.isNull(), F.lit(f.name)))
    return cells, F.array_compact(F.array(*misfits)) if misfits else F.array().cast("array<string>")


def append_misfits(df: DataFrame, table: str) -> DataFrame:
    """The rows of ``df`` that ``metastore_append`` refuses, with ``error``: the dead letters of the append."""
    _, misfits = _fitted(df, df.sparkSession.table(table).schema)
    return df.withColumn("error", F.when(F.size(misfits) > 0, F.concat(F.lit("values that do not fit: "), F.array_join(misfits, ", ")))).filter(
        "error IS NOT NULL"
    )


def metastore_append(df: DataFrame, table: str, misfits: str = "error") -> None:
    """Append by column name; columns the frame lacks become NULL.

    A value that the column's type cannot hold is never stored as NULL: with ``misfits="error"`` it ends the write, with
    ``"skip"`` its row is left out, to be taken from ``append_misfits``.
    """
    if misfits not in ("error", "skip"):
        raise ValueError(f"unknown way with misfits: {misfits}")
    cells, wrong = _fitted(df, df.sparkSession.table(table).schema)
    bad = F.size(wrong) > 0
    if misfits == "skip":
        df = df.filter(~bad)
    else:
        message = F.concat(F.lit("values that do not fit: "), F.array_join(wrong, ", "))
        df = df.filter(F.when(bad, F.raise_error(message).cast("boolean")).otherwise(True))
    df.select(*[c.alias(n) for n, c in cells.items()]).write.insertInto(table)


def file_name(name: str, schema: str | None = None) -> str:
    full = f"{schema}.{name}" if schema else name
    return re.sub(UNSAFE_FILE_CHARS, "_", full) + ".jsonl"


def graph_file_name(kind: str, name: str) -> str:
    prefix = "node" if kind == "node" else "relationship"
    return f"{prefix}_{re.sub(UNSAFE_GRAPH_CHARS, '_', name) or 'unnamed'}.jsonl"


def write_many(tables: dict[str, DataFrame], directory: str, schema: str | None = None) -> dict[str, str]:
    """One folder of record lines per table; returns the paths by table name."""
    paths = {name: f"{directory.rstrip('/')}/{file_name(name, schema)}" for name in tables}
    if len(set(paths.values())) != len(paths):
        raise ValueError("two tables would be written to the same path")
    for name, df in tables.items():
        write_lines(record_lines(df), paths[name])
    return paths


def direct_copy(
    source: DataFrame,
    path: str,
    keys: list[str],
    seq: str,
    existing: DataFrame | None = None,
    columns: list[str] | None = None,
    fmt: str = "parquet",
) -> None:
    """Source to target in one job with no file in between; existing keys are skipped."""
    from recordloom.operators.conflicts import rows_to_append
    from recordloom.operators.project import project_frame

    chosen = project_frame(source, [*columns, *keys, seq] if columns else None)
    if existing is not None:
        chosen = rows_to_append(existing, chosen, keys, seq)
    else:
        chosen = chosen.drop(seq) if seq not in keys else chosen
    chosen.write.mode("append").format(fmt).save(path)


def jdbc_write(df: DataFrame, options: dict[str, str], batch_rows: int = 1000) -> None:
    """Append through the JDBC writer, which binds the values itself."""
    if not 1 <= batch_rows <= 10_000:
        raise ValueError("batch_rows must be between 1 and 10000")
    df.write.format("jdbc").mode("append").options(**options, batchsize=str(batch_rows)).save()
