"""Target definitions from an inferred schema: types, DDL, index mappings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions.names import qualified_name, quote_identifier
from recordloom.operators.infer import LOGICAL_TYPES

# Column type per engine, in the order of LOGICAL_TYPES.
TARGET_TYPES = {
    "postgresql": ("boolean", "bigint", "bigint", "double precision", "timestamptz", "text", "jsonb"),
    "mysql": ("tinyint(1)", "bigint", "bigint", "double", "datetime(6)", "text", "json"),
    "hive": ("boolean", "bigint", "bigint", "double", "timestamp", "string", "string"),
    "elasticsearch": ("boolean", "long", "long", "double", "date", "text", "object"),
}
# What closes a table definition.
DDL_END = {
    "postgresql": "\n);",
    "mysql": "\n) ENGINE=InnoDB DEFAULT CHARSET=utf8mb4;",
    "hive": "\n)\nSTORED AS TEXTFILE;",
}
KEYWORD_LIMIT = 256
MAX_MAPPING_DEPTH = 20


def target_type(engine: str | Column, logical: Column) -> Column:
    """Type name of an engine for a logical type, as a constant map lookup."""
    pairs = [
        (f"{e}/{t}", name)
        for e, names in TARGET_TYPES.items()
        for t, name in zip(LOGICAL_TYPES, names)
    ]
    table = F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    engine = F.lit(engine) if isinstance(engine, str) else engine
    return F.try_element_at(table, F.concat(engine, F.lit("/"), logical))


def with_target_types(columns: DataFrame, engine: str) -> DataFrame:
    if engine not in TARGET_TYPES:
        raise ValueError(f"unknown engine: {engine}")
    return columns.withColumn("target_type", target_type(engine, F.col("logical_type")))


def _ordered(columns: DataFrame, group: list[str], *fields: str) -> DataFrame:
    """Columns of each table as one sorted array; bounded by the width of a table."""
    packed = F.array_sort(F.collect_list(F.struct("ordinal", *fields)))
    return columns.groupBy(*group).agg(packed.alias("cols")) if group else columns.agg(packed.alias("cols"))


def create_table_ddl(
    columns: DataFrame, engine: str, table: str, schema: str | None = None, group: list[str] | None = None
) -> DataFrame:
    """One ``definition`` text for the columns; no columns at all is an error."""
    if engine not in DDL_END:
        raise ValueError(f"no table definition for engine: {engine}")
    typed = with_target_types(columns, engine)
    body = F.array_join(
        F.transform(
            "cols",
            lambda c: F.concat(
                F.lit("  "),
                quote_identifier(c["name"], engine),
                F.lit(" "),
                c["target_type"],
                F.when(c["nullable"], F.lit("")).otherwise(F.lit(" NOT NULL")),
            ),
        ),
        ",\n",
    )
    head = F.concat(
        F.lit("CREATE TABLE IF NOT EXISTS "),
        qualified_name(F.lit(schema).cast("string"), F.lit(table), engine),
        F.lit(" (\n"),
    )
    text = F.when(F.size("cols") > 0, F.concat(head, body, F.lit(DDL_END[engine]))).otherwise(
        F.raise_error(F.lit("no columns to define a table with")).cast("string")
    )
    grouped = _ordered(typed, group or [], "name", "target_type", "nullable")
    return grouped.select(*(group or []), text.alias("definition"))


def spark_table_ddl(columns: list[tuple[str, str]], table: str, fmt: str, location: str | None = None) -> str:
    """The definition that is actually run in a Spark catalog."""
    if not columns:
        raise ValueError("no columns to define a table with")
    body = ", ".join(f"`{n.replace('`', '``')}` {t}" for n, t in columns)
    place = f" LOCATION '{location}'" if location else ""
    return f"CREATE TABLE IF NOT EXISTS {table} ({body}) USING {fmt}{place}"


def index_mapping(columns: DataFrame) -> DataFrame:
    """One ``definition`` text: the index mapping of the columns, in column order."""
    typed = with_target_types(columns, "elasticsearch")
    q = lambda c: F.to_json(c.cast("variant"))
    keyword = f'{{"keyword":{{"type":"keyword","ignore_above":{KEYWORD_LIMIT}}}}}'
    entry = lambda c: F.concat(
        q(c["name"]),
        F.lit(":"),
        F.when(c["logical_type"] == "string", F.lit(f'{{"type":"text","fields":{keyword}}}'))
        .when(c["logical_type"] == "json", F.lit('{"type":"object","enabled":true}'))
        .otherwise(F.concat(F.lit('{"type":'), q(c["target_type"]), F.lit("}"))),
    )
    body = F.array_join(F.transform("cols", entry), ",")
    text = F.when(
        F.size("cols") > 0,
        F.concat(F.lit('{"mappings":{"properties":{'), body, F.lit("}}}")),
    ).otherwise(F.raise_error(F.lit("no columns to define a mapping with")).cast("string"))
    return _ordered(typed, [], "name", "logical_type", "target_type").select(text.alias("definition"))


def _children(node: Column, key: str) -> Column:
    entries = F.map_entries(F.try_variant_get(node, f"$.{key}", "map<string,variant>"))
    return F.coalesce(entries, F.array().cast("array<struct<key:string,value:variant>>"))


def _declared(node: Column) -> Column:
    kind = F.try_variant_get(node, "$.type", "variant")
    return F.when(F.schema_of_variant(kind) == "STRING", F.try_variant_get(kind, "$", "string"))


FIELD_ARRAY = "array<struct<name:string,type:string>>"


def _flatten(entries: Column, prefix: Column, mode: str, depth: int) -> Column:
    """Fields of one level and, inside the same expression, of the levels below."""
    if depth == 0:
        return F.when(
            F.size(entries) > 0, F.raise_error(F.lit("mapping is nested too deeply")).cast(FIELD_ARRAY)
        ).otherwise(F.array().cast(FIELD_ARRAY))

    def fields(entry: Column) -> Column:
        node, name = entry["value"], F.concat(prefix, entry["key"])
        declared = _declared(node)
        below = F.concat(name, F.lit("."))
        if mode == "listing":
            own = F.array(F.struct(name.alias("name"), F.coalesce(declared, F.lit("object")).alias("type")))
            inner = F.when(declared.isin("object", "nested"), _children(node, "properties")).otherwise(
                _children(node, "fields")
            )
            return F.concat(own.cast(FIELD_ARRAY), _flatten(inner, below, mode, depth - 1))
        own = F.when(
            F.length(declared) > 0, F.array(F.struct(name.alias("name"), declared.alias("type")))
        ).otherwise(F.array().cast(FIELD_ARRAY))
        subs = F.transform(
            _children(node, "fields"),
            lambda s: F.struct(F.concat(below, s["key"]).alias("name"), _declared(s["value"]).alias("type")),
        )
        subs = F.filter(subs, lambda s: F.length(s["type"]) > 0)
        nested = _flatten(_children(node, "properties"), below, mode, depth - 1)
        return F.concat(own.cast(FIELD_ARRAY), subs.cast(FIELD_ARRAY), nested)

    return F.flatten(F.transform(entries, fields))


def flatten_mapping(mappings: DataFrame, column: str, mode: str = "listing", depth: int = MAX_MAPPING_DEPTH) -> DataFrame:
    """Property trees (VARIANT) to one row ``(name, type)`` per dotted field.

    ``listing`` shows every node and follows ``properties`` of objects, ``fields``
    of the rest; ``typed`` shows typed nodes only and follows both.  A mapping
    deeper than ``depth`` is an error, never cut short.
    """
    if mode not in ("listing", "typed"):
        raise ValueError(f"unknown mode: {mode}")
    root = F.coalesce(
        F.map_entries(F.try_variant_get(F.col(column), "$", "map<string,variant>")),
        F.array().cast("array<struct<key:string,value:variant>>"),
    )
    rest = [c for c in mappings.columns if c != column]
    exploded = mappings.select(*rest, F.explode(_flatten(root, F.lit(""), mode, depth)).alias("f"))
    return exploded.select(*rest, "f.name", "f.type")


def create_if_missing(
    spark: SparkSession,
    table: str,
    definition: str | None,
    schema: str | None = None,
) -> bool:
    """Run ``definition`` when the table is not there; says whether it did.

    The definition is ignored for an existing table and required for a missing one.
    """
    name = f"{schema}.{table}" if schema else table
    if spark.catalog.tableExists(name):
        return False
    if definition is None:
        raise ValueError(f"table {name} does not exist and no definition was given")
    if not definition.strip():
        raise ValueError("the definition is empty")
    if len(definition) > 20_000:
        raise ValueError("the definition is longer than 20000 characters")
    if schema:
        spark.sql(f"CREATE SCHEMA IF NOT EXISTS `{schema}`")
    spark.sql(definition)
    return True
