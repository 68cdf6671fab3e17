"""Column selection on dynamic records and on typed frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.operators.ordinal import with_ordinal
from recordloom.sources.lines import pin


def _names(columns: list[str]) -> Column:
    return F.array(*[F.lit(c) for c in columns])


def project(records: DataFrame, columns: list[str] | None) -> DataFrame:
    """Keep the selected keys in the order of the source; none selected keeps all."""
    if not columns:
        return records
    return records.withColumn("rec", F.map_filter("rec", lambda k, _: k.isin(*columns)))


def project_frame(df: DataFrame, columns: list[str] | None) -> DataFrame:
    """The same for a typed frame: source order, pruned at the scan."""
    if not columns:
        return df
    wanted = set(columns)
    return df.select(*[f"`{c}`" for c in df.columns if c in wanted])


def project_document(records: DataFrame, columns: list[str] | None) -> DataFrame:
    """Keep the selected keys in the order of the request; a record that lacks one gets an error."""
    if not columns:
        return records
    records = require_columns(records, columns)
    values = F.array(*[F.try_element_at("rec", F.lit(c)) for c in columns])
    return records.withColumn(
        "rec", F.when(F.col("rec").isNotNull(), F.map_from_arrays(_names(columns), values))
    )


def missing_columns(columns: list[str], rec: str = "rec") -> Column:
    """Selected names a record has no key for (a null value is fine)."""
    return F.array_except(_names(columns), F.map_keys(rec))


def require_columns(records: DataFrame, columns: list[str] | None, raising: bool = False) -> DataFrame:
    """Flag (or refuse) records that lack one of the selected keys."""
    if not columns:
        return records
    missing = missing_columns(columns)
    message = F.concat(
        F.lit("line "), F.col("line_no").cast("string"), F.lit(" lacks selected columns: "),
        F.array_join(missing, ", "),
    )
    failed = F.col("error").isNull() & (F.size(missing) > 0)
    if raising:
        return records.withColumn(
            "error", F.when(failed, F.raise_error(message).cast("string")).otherwise(F.col("error"))
        )
    return records.withColumn("error", F.when(failed, message).otherwise(F.col("error")))


def rename_skip(records: DataFrame, renames: dict[str, str], skip: list[str] | None = None) -> DataFrame:
    """Rename keys and drop others, order kept."""
    out = F.col("rec")
    if skip:
        out = F.map_filter(out, lambda k, _: ~k.isin(*skip))
    if renames:
        table = F.create_map(*[F.lit(x) for pair in renames.items() for x in pair])
        out = F.transform_keys(out, lambda k, _: F.coalesce(F.try_element_at(table, k), k))
    return records.withColumn("rec", out)


def writable_columns(df: DataFrame, columns: DataFrame) -> list[str]:
    """Names of ``df`` that its column metadata allows to be written or read.

    ``columns`` is the ``(name, generated, hidden)`` metadata frame of one
    table, so collecting its names is bounded by the width of the table.
    """
    blocked = {
        r["name"]
        for r in columns.filter(F.col("generated") | F.col("hidden")).select("name").collect()
    }
    return [c for c in df.columns if c not in blocked]


def select_writable(df: DataFrame, columns: DataFrame) -> DataFrame:
    return df.select(*[f"`{c}`" for c in writable_columns(df, columns)])


def first_record_columns(records: DataFrame) -> DataFrame:
    """``(pos, name)`` of the first record; a wrapped document gives its body's keys."""
    body = F.try_variant_get(F.try_element_at("rec", F.lit("_source")), "$", "map<string,variant>")
    names = F.map_keys(F.coalesce(body, F.col("rec")))
    first = (
        records.filter(F.col("rec").isNotNull())
        .orderBy("file", "line_no", "row_idx")
        .limit(1)
        .select(names.alias("names"))
    )
    return first.select(F.posexplode("names").alias("pos", "name"))


def place(line_no: Column, pos: Column) -> Column:
    """Line and key position as one number of fixed width: 38 digits hold any line number and any position."""
    return line_no.cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(10,0)") + pos.cast("decimal(10,0)")


def first_seen_columns(records: DataFrame) -> DataFrame:
    """``(name, file, at)`` with the place of the first occurrence of every key.

    ``at`` is :func:`place`, so the first aggregation runs on fixed-width
    buffers and shrinks each task's rows to one per key and file before
    anything is shuffled.
    """
    keys = records.filter(F.col("rec").isNotNull()).select(
        "file", "line_no", F.posexplode(F.map_keys("rec")).alias("pos", "name")
    )
    per_file = keys.groupBy("name", "file").agg(F.min(place(F.col("line_no"), F.col("pos"))).alias("at"))
    return (
        per_file.groupBy("name")
        .agg(F.min(F.struct("file", "at")).alias("first"))
        .select("name", "first.file", "first.at")
    )


def union_columns(records: DataFrame) -> DataFrame:
    """All keys over all records in first-seen order, as ``(ordinal, name)``.

    The keys are numbered range by range, so there may be as many as records.
    """
    numbered = with_ordinal(first_seen_columns(records), ["file", "at", "name"], "ordinal")
    return numbered.select(F.col("ordinal").cast("int").alias("ordinal"), "name")


def pin_values(records: DataFrame, **columns: Column) -> DataFrame:
    """Named values of the records, each evaluated once."""
    return pin(records, **columns)
