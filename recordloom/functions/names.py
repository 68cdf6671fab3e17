"""Identifier quoting, file names and template placeholders."""

from __future__ import annotations

from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of safe names, identifiers and placeholders.
UNSAFE_FILE_CHARS = r"[^a-zA-Z0-9._-]"
UNSAFE_GRAPH_CHARS = r"[^a-zA-Z0-9_-]"
IDENTIFIER = r"^[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)*$"
PLACEHOLDER = r"\{\{(\w+)\}\}"
# Stands for a placeholder's place while texts are split; not allowed in JSON text.
MARK = "\x00"


def quote_identifier(name: Column, engine: str) -> Column:
    """Double quotes for PostgreSQL, backticks for the others; doubled inside."""
    q = '"' if engine == "postgresql" else "`"
    return F.concat(F.lit(q), F.replace(name, F.lit(q), F.lit(q + q)), F.lit(q))


def qualified_name(schema: Column, table: Column, engine: str) -> Column:
    has = F.length(F.trim(F.coalesce(schema, F.lit("")))) > 0
    return F.concat(
        F.when(has, F.concat(quote_identifier(F.trim(schema), engine), F.lit("."))).otherwise(F.lit("")),
        quote_identifier(table, engine),
    )


def safe_file_name(name: Column) -> Column:
    return F.concat(F.regexp_replace(name, UNSAFE_FILE_CHARS, "_"), F.lit(".jsonl"))


def safe_graph_file_name(kind: Column, name: Column) -> Column:
    safe = F.regexp_replace(name, UNSAFE_GRAPH_CHARS, "_")
    prefix = F.when(kind == "node", "node_").otherwise("relationship_")
    return F.concat(prefix, F.when(F.length(safe) > 0, safe).otherwise("unnamed"), F.lit(".jsonl"))


def valid_identifier(name: Column) -> Column:
    return name.rlike(IDENTIFIER)


def render_template(text: Column, variables: Column) -> Column:
    """Replace ``{{NAME}}`` once; unknown names stay, values are not looked into.

    The text is cut at its placeholders, so a value that contains another
    placeholder is never seen again.
    """
    names = F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(1))
    parts = F.split(F.regexp_replace(text, PLACEHOLDER, MARK), MARK, -1)
    filled = F.transform(
        names,
        lambda n: F.coalesce(F.try_element_at(variables, n), F.concat(F.lit("{{"), n, F.lit("}}"))),
    )
    pairs = F.zip_with(parts, F.concat(filled, F.array(F.lit(""))), lambda p, v: F.concat(p, v))
    return F.when(F.size(names) > 0, F.array_join(pairs, "")).otherwise(text)


def built_in_variables(now: datetime) -> dict[str, str]:
    """TODAY in UTC, NOW in the clock's own zone, TIMESTAMP in epoch seconds."""
    if now.tzinfo is None:
        now = now.replace(tzinfo=timezone.utc)
    return {
        "TODAY": now.astimezone(timezone.utc).strftime("%Y-%m-%d"),
        "NOW": now.strftime("%H:%M:%S"),
        "TIMESTAMP": str(int(now.timestamp())),
    }


def merge_maps(*maps: Column) -> Column:
    """Maps joined so that a later one wins, under any map key policy."""
    def put(earlier: Column, later: Column) -> Column:
        kept = F.map_filter(earlier, lambda k, _: ~F.map_contains_key(later, k))
        return F.map_concat(kept, later)

    return reduce(put, maps)


def variables_map(variables: Column) -> Column:
    """``ARRAY<STRUCT<name, default_value>>`` to a map; no default means empty text.

    The last of two variables with one name wins.
    """
    names = F.array_distinct(F.transform(variables, lambda v: v["name"]))
    last = lambda n: F.element_at(F.filter(variables, lambda v: v["name"] == n), -1)
    values = F.transform(names, lambda n: F.coalesce(last(n)["default_value"], F.lit("")))
    empty = F.create_map().cast("map<string,string>")
    return F.coalesce(F.map_from_arrays(names, values), empty)


def constant_map(values: dict[str, str]) -> Column:
    if not values:
        return F.create_map().cast("map<string,string>")
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
