"""Frames to lines of text: records, envelopes, hits, bulk actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.operators.ordinal import with_ordinal

KEEP_NULLS = {"ignoreNullFields": "false"}


def _row(df: DataFrame, columns: list[str] | None = None) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in (columns or df.columns)])


def record_lines(df: DataFrame) -> DataFrame:
    """One JSON object per row, nulls kept."""
    return df.select(F.to_json(_row(df), KEEP_NULLS).alias("value"))


def json_value(column: Column) -> Column:
    """JSON text of one value of any type."""
    boxed = F.to_json(F.struct(column.alias("v")), KEEP_NULLS)
    return F.substr(boxed, F.lit(6), F.length(boxed) - 6)


def positional(df: DataFrame, columns: list[str]) -> Column:
    """JSON text of a row as a positional array."""
    cells = [json_value(F.col(f"`{c}`")) for c in columns]
    return F.concat(F.lit("["), F.concat_ws(",", *cells), F.lit("]"))


def _names_json(columns: list[str]) -> str:
    import json

    return json.dumps(columns, ensure_ascii=False, separators=(",", ":"))


def _table_json(schema: str | None, name: str, kind: str) -> str:
    import json

    ref = {"database" if kind == "hive" else "schema": schema, "name": name}
    return json.dumps(ref, ensure_ascii=False, separators=(",", ":"))


def envelope_lines(
    df: DataFrame,
    keys: list[str],
    batch: int,
    table: str,
    schema: str | None = None,
    kind: str = "sql",
) -> DataFrame:
    """``(batch_no, value)``: rows in key order, ``batch`` per line, a short last one.

    Positions are exact, hence batches do not depend on the partitioning.  The
    second exchange moves finished lists: rows of a batch already sit together
    and are collected before the shuffle.
    """
    if not 1 <= batch <= 10_000:
        raise ValueError("batch must be between 1 and 10000")
    columns = df.columns
    rows = df.select(*[F.col(f"`{k}`") for k in keys], positional(df, columns).alias("_row"))
    placed = with_ordinal(rows, keys, "_ord")
    grouped = (
        placed.select(F.floor(F.col("_ord") / batch).cast("bigint").alias("batch_no"), "_ord", "_row")
        .groupBy("batch_no")
        .agg(F.array_sort(F.collect_list(F.struct("_ord", "_row"))).alias("rows"))
    )
    head = f'{{"table":{_table_json(schema, table, kind)},"columns":{_names_json(columns)},"rows":['
    body = F.array_join(F.transform("rows", lambda r: r["_row"]), ",")
    return grouped.select("batch_no", F.concat(F.lit(head), body, F.lit("]}")).alias("value"))


def row_envelope_lines(df: DataFrame, table: str) -> DataFrame:
    """``{table, columns, values}`` per row."""
    import json

    head = f'{{"table":{json.dumps(table, ensure_ascii=False)},"columns":{_names_json(df.columns)},"values":'
    return df.select(F.concat(F.lit(head), positional(df, df.columns), F.lit("}")).alias("value"))


def _text_member(name: str, column: Column) -> Column:
    has = F.length(column) > 0
    return F.when(has, F.concat(F.lit(f',"{name}":'), F.to_json(column.cast("variant")))).otherwise(F.lit(""))


def hit_lines(df: DataFrame, source: Column, doc_id: Column | None = None, routing: Column | None = None) -> DataFrame:
    """``{_source, _id?, _routing?}``; empty id and routing are left out."""
    none = F.lit(None).cast("string")
    text = F.concat(
        F.lit('{"_source":'),
        F.to_json(source, KEEP_NULLS),
        _text_member("_id", none if doc_id is None else doc_id),
        _text_member("_routing", none if routing is None else routing),
        F.lit("}"),
    )
    return df.select(text.alias("value"))


def bulk_lines(
    df: DataFrame,
    index: str,
    source: Column,
    policy: str = "overwrite",
    doc_id: Column | None = None,
    routing: Column | None = None,
) -> DataFrame:
    """Action and source as two lines of one value; ``skip`` creates, else indexes."""
    import json

    action = "create" if policy == "skip" else "index"
    none = F.lit(None).cast("string")
    text = F.concat(
        F.lit(f'{{"{action}":{{"_index":{json.dumps(index, ensure_ascii=False)}'),
        _text_member("_id", none if doc_id is None else doc_id),
        _text_member("routing", none if routing is None else routing),
        F.lit("}}\n"),
        F.to_json(source, KEEP_NULLS),
    )
    return df.select(text.alias("value"))


def bulk_outcome(items: DataFrame, action: str) -> DataFrame:
    """Outcome of bulk responses ``(seq, status, error_reason)``.

    A 409 of a ``create`` is a skipped document; any other error fails the
    request, the first one by ``seq`` being reported.  One partial row per task.
    """
    failed = F.col("error_reason").isNotNull()
    skipped = failed & (F.col("status") == 409) & F.lit(action == "create")
    fatal = failed & ~skipped
    first = F.min(F.when(fatal, F.struct("seq", "error_reason")))
    return items.agg(
        F.count(F.lit(1)).alias("items"),
        F.count_if(~failed).alias("written"),
        F.count_if(skipped).alias("skipped"),
        F.count_if(fatal).alias("failed"),
        first.alias("first"),
    ).select(
        "items", "written", "skipped", "failed", F.col("first.error_reason").alias("first_reason")
    )


def bulk_items(responses: DataFrame, column: str = "value") -> DataFrame:
    """Bulk response texts to ``(seq, action, status, error_reason)`` per item."""
    body = F.from_json(F.col(column), "struct<items:array<map<string,struct<status:int,error:variant>>>>")
    items = responses.select("seq", F.posexplode(body["items"]).alias("pos", "item"))
    one = items.select("seq", "pos", F.explode("item").alias("action", "r"))
    detail = F.coalesce(
        F.nullif(F.try_variant_get("r.error", "$.reason", "string"), F.lit("")),
        F.nullif(F.try_variant_get("r.error", "$.type", "string"), F.lit("")),
        F.lit("bulk write failed"),
    )
    return one.select(
        F.struct("seq", "pos").alias("seq"),
        "action",
        F.col("r.status").alias("status"),
        F.when(F.col("r.error").isNotNull(), detail).alias("error_reason"),
    )


def write_lines(lines: DataFrame, path: str, by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Write the ``value`` column, in one folder per ``by`` value when given."""
    writer = lines.select(*(by or []), "value").write.mode(mode)
    (writer.partitionBy(*by) if by else writer).text(path)
