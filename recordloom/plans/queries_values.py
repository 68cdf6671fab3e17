"""Queries: conversion, coercion, row quality, inference and target definitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions import engines
from recordloom.functions.convert import FieldRule, Val, coerce_for_search, coerce_value, convert_value, with_values
from recordloom.operators import infer, quality, targets
from recordloom.plans.import_plan import ImportSpec, cast_dry_run, convert_records, run_import
from recordloom.plans.queries_records import customer_hits, ragged_events
from recordloom.plans.registry import lines_of, query, table
from recordloom.session import scratch
from recordloom.sources import records as rec


def _out(val: Val) -> list[Column]:
    return [val.as_text().alias("value"), val.error_or_null().alias("error")]


def _convert(lines: DataFrame, key: str, rule: FieldRule) -> DataFrame:
    staged, found = with_values(rec.records_of(lines), [key], ["line_no"])
    return staged.select("line_no", *_out(convert_value(found[key], rule)))


@query("conv_json", """
SELECT p_partkey AS line_no, '{"name":"' || p_name || '","size":' || p_size || '}' AS value, NULL::VARCHAR AS error FROM part""")
def conv_json(spark, sf):
    p = table(spark, sf, "part")
    text = F.to_json(F.struct(F.struct(F.col("p_name").alias("name"), F.col("p_size").alias("size")).alias("d")))
    return _convert(lines_of(p, "p_partkey", text), "d", FieldRule("d", "json"))


@query("conv_stringify", """
SELECT o_orderkey AS line_no, regexp_replace(CAST(o_totalprice AS VARCHAR), '\\.0$', '') AS value,
       NULL::VARCHAR AS error FROM orders""")
def conv_stringify(spark, sf):
    return _convert(lines_of(table(spark, sf, "orders"), "o_orderkey"), "o_totalprice", FieldRule("o_totalprice", "stringify"))


@query("conv_join_array", """
SELECT p_partkey AS line_no, array_to_string(string_split(p_name, ' '), '|') || '|null|' || p_size AS value,
       NULL::VARCHAR AS error FROM part""")
def conv_join_array(spark, sf):
    p = table(spark, sf, "part")
    words = F.array_join(F.transform(F.split("p_name", " "), lambda w: F.concat(F.lit('"'), w, F.lit('"'))), ",")
    text = F.concat(F.lit('{"a":['), words, F.lit(",null,"), F.col("p_size").cast("string"), F.lit("]}"))
    rule = FieldRule("a", "cast", "array<string>", "text", options={"arrayDelimiter": "|"})
    return _convert(lines_of(p, "p_partkey", text), "a", rule)


@query("conv_map_text", """
SELECT event_id AS line_no, replace(props, ' ', '') AS value, NULL::VARCHAR AS error FROM events""")
def conv_map_text(spark, sf):
    e = table(spark, sf, "events")
    text = F.concat(F.lit('{"m":'), F.col("props"), F.lit("}"))
    return _convert(lines_of(e, "event_id", text), "m", FieldRule("m", "cast", "map<string,int>", "text"))


@query("conv_int_bool", """
SELECT event_id AS line_no,
  CASE WHEN event_type = 'error' THEN NULL WHEN user_id <> 0 THEN 'true' ELSE 'false' END AS value,
  CASE WHEN event_type = 'error' THEN 'column b: int -> boolean: not a finite number' END AS error FROM events""")
def conv_int_bool(spark, sf):
    e = table(spark, sf, "events")
    plain = F.col("user_id").cast("string")
    cell = (
        F.when(F.col("event_type") == "error", F.lit('"many"'))
        .when(F.col("event_type") == "click", F.concat(F.lit('"'), plain, F.lit('"')))
        .otherwise(plain)
    )
    text = F.concat(F.lit('{"b":'), cell, F.lit("}"))
    return _convert(lines_of(e, "event_id", text), "b", FieldRule("b", "cast", "int", "boolean"))


@query("conv_timestamp", """
SELECT event_id AS line_no,
  CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'click' THEN strftime(ts, '%Y-%m-%dT00:00:00.000Z')
       ELSE strftime(ts - INTERVAL 8 HOUR, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' END AS value,
  CASE WHEN event_type = 'error' THEN 'column t: iso-string -> timestamp: not a date and time' END AS error FROM events""")
def conv_timestamp(spark, sf):
    e = table(spark, sf, "events")
    stamp = (
        F.when(F.col("event_type") == "error", F.lit("not-a-date"))
        .when(F.col("event_type") == "click", F.date_format("ts", "yyyy-MM-dd"))
        .otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+08:00'"))
    )
    text = F.to_json(F.struct(stamp.alias("t")))
    return _convert(lines_of(e, "event_id", text), "t", FieldRule("t", "cast", "iso-string", "timestamp"))


@query("conv_passthrough", """
SELECT s_suppkey AS line_no, s_name AS value, NULL::VARCHAR AS error FROM supplier""")
def conv_passthrough(spark, sf):
    s = table(spark, sf, "supplier")
    return _convert(lines_of(s, "s_suppkey"), "s_name", FieldRule("s_name", "cast", "varchar", "uuid"))


def mixed_events(spark, sf):
    """One value per event, its JSON type chosen by the event type."""
    e = table(spark, sf, "events")
    cell = (
        F.when(F.col("event_type") == "click", F.col("value").cast("string"))
        .when(F.col("event_type") == "view", F.concat(F.lit('"'), F.col("user_id").cast("string"), F.lit('"')))
        .when(F.col("event_type") == "error", F.when(F.col("value") > 20, F.lit("true")).otherwise(F.lit("null")))
        .when(F.col("event_type") == "signup", F.col("props"))
        .otherwise(F.concat(F.lit('["'), F.col("event_type"), F.lit('",'), F.col("user_id").cast("string"), F.lit("]")))
    )
    return lines_of(e, "event_id", F.concat(F.lit('{"x":'), cell, F.lit("}")))


def _coerce(spark, sf, target: str) -> DataFrame:
    staged, found = with_values(rec.records_of(mixed_events(spark, sf)), ["x"], ["line_no"])
    return staged.select("line_no", *_out(coerce_value(found["x"], target, "x")))


# Text of the mixed value as DuckDB writes it, and its JSON kind.
NUM = "regexp_replace(CAST(value AS VARCHAR), '\\.0$', '')"
NESTED = """CASE WHEN event_type = 'signup' THEN replace(props, ' ', '') ELSE '["' || event_type || '",' || user_id || ']' END"""
KIND = """CASE event_type WHEN 'click' THEN 'number' WHEN 'view' THEN 'string' WHEN 'error' THEN 'boolean'
  WHEN 'signup' THEN 'object' ELSE 'array' END"""


@query("coerce_string", f"""
SELECT event_id AS line_no, CASE event_type WHEN 'click' THEN {NUM} WHEN 'view' THEN CAST(user_id AS VARCHAR)
  WHEN 'error' THEN CASE WHEN value > 20 THEN 'true' END ELSE {NESTED} END AS value, NULL::VARCHAR AS error FROM events""")
def coerce_string(spark, sf):
    return _coerce(spark, sf, "character varying")


@query("coerce_numeric", f"""
SELECT event_id AS line_no, CASE event_type WHEN 'click' THEN {NUM} WHEN 'view' THEN CAST(user_id AS VARCHAR)
  WHEN 'error' THEN CASE WHEN value > 20 THEN '1' END END AS value,
  CASE WHEN event_type IN ('signup', 'purchase')
    THEN 'column x: ' || {KIND} || ' -> numeric(10,2): not a finite number' END AS error FROM events""")
def coerce_numeric(spark, sf):
    return _coerce(spark, sf, "numeric(10,2)")


@query("coerce_boolean", f"""
SELECT event_id AS line_no, CASE event_type WHEN 'click' THEN CASE WHEN value <> 0 THEN 'true' ELSE 'false' END
  WHEN 'view' THEN CASE user_id WHEN 0 THEN 'false' WHEN 1 THEN 'true' END
  WHEN 'error' THEN CASE WHEN value > 20 THEN 'true' END END AS value,
  CASE WHEN event_type IN ('signup', 'purchase') OR (event_type = 'view' AND user_id > 1)
    THEN 'column x: ' || {KIND} || ' -> bool: not a boolean' END AS error FROM events""")
def coerce_boolean(spark, sf):
    return _coerce(spark, sf, "bool")


@query("coerce_temporal", f"""
WITH w AS (SELECT *, CASE event_type
    WHEN 'click' THEN strftime(epoch_ms(epoch_us(ts) // 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z'
    WHEN 'view' THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' END AS out FROM events)
SELECT event_id AS line_no, out AS value,
  CASE WHEN out IS NULL THEN 'column t: ' || CASE WHEN event_type = 'error' THEN 'boolean' ELSE 'string' END
    || ' -> timestamp with time zone: not a date' END AS error FROM w""")
def coerce_temporal(spark, sf):
    e = table(spark, sf, "events")
    millis = F.unix_millis(F.col("ts").cast("timestamp")).cast("string")
    cell = (
        F.when(F.col("event_type") == "click", millis)
        .when(F.col("event_type") == "view", F.concat(F.lit('"'), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit('"')))
        .when(F.col("event_type") == "error", F.lit("true"))
        .otherwise(F.concat(F.lit('"'), F.date_format("ts", "HH:mm"), F.lit('"')))
    )
    records = rec.records_of(lines_of(e, "event_id", F.concat(F.lit('{"t":'), cell, F.lit("}"))))
    staged, found = with_values(records, ["t"], ["line_no"])
    return staged.select("line_no", *_out(coerce_value(found["t"], "timestamp with time zone", "t")))


@query("coerce_json", f"""
SELECT event_id AS line_no, CASE event_type WHEN 'click' THEN {NUM}
  WHEN 'view' THEN '"' || event_type || '-' || user_id || '"'
  WHEN 'error' THEN '[1, 2]' ELSE {NESTED} END AS value, NULL::VARCHAR AS error FROM events""")
def coerce_json(spark, sf):
    e = table(spark, sf, "events")
    cell = (
        F.when(F.col("event_type") == "click", F.col("value").cast("string"))
        .when(F.col("event_type") == "view", F.concat(F.lit('"view-'), F.col("user_id").cast("string"), F.lit('"')))
        .when(F.col("event_type") == "error", F.lit('"[1, 2]"'))
        .when(F.col("event_type") == "signup", F.col("props"))
        .otherwise(F.concat(F.lit('["'), F.col("event_type"), F.lit('",'), F.col("user_id").cast("string"), F.lit("]")))
    )
    records = rec.records_of(lines_of(e, "event_id", F.concat(F.lit('{"x":'), cell, F.lit("}"))))
    staged, found = with_values(records, ["x"], ["line_no"])
    return staged.select("line_no", *_out(coerce_value(found["x"], "jsonb", "x")))


@query("sink_value_rules", f"""
SELECT event_id AS line_no,
  CASE event_type WHEN 'click' THEN {NUM} WHEN 'view' THEN CAST(user_id AS VARCHAR)
    WHEN 'error' THEN CASE WHEN value > 20 THEN 'true' END ELSE {NESTED} END AS pg,
  CASE event_type WHEN 'click' THEN {NUM} WHEN 'view' THEN CAST(user_id AS VARCHAR)
    WHEN 'error' THEN CASE WHEN value > 20 THEN '1' END ELSE {NESTED} END AS mysql,
  strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS mysql_date, lower(hex(event_type)) AS mysql_bytes
FROM events""")
def sink_value_rules(spark, sf):
    records = rec.records_of(mixed_events(spark, sf))
    x = F.try_element_at("rec", F.lit("x"))
    bound = records.select("line_no", engines.postgres_value(x).alias("pg"), engines.mysql_value(x).alias("mysql"))
    e = table(spark, sf, "events")
    typed = e.select(
        F.col("event_id").alias("line_no"),
        engines.mysql_column(F.col("ts"), e.schema["ts"].dataType).alias("mysql_date"),
        engines.mysql_column(F.encode("event_type", "UTF-8"), engines.T.BinaryType()).alias("mysql_bytes"),
    )
    return bound.join(typed, "line_no")


@query("hive_coerce", f"""
SELECT event_id AS line_no,
  CASE WHEN event_type = 'view' THEN CAST(user_id AS VARCHAR) WHEN event_type = 'click' AND value = floor(value)
    THEN CAST(CAST(value AS BIGINT) AS VARCHAR) WHEN event_type = 'error' AND value > 20 THEN '1' END AS as_int,
  CASE event_type WHEN 'click' THEN {NUM} WHEN 'view' THEN CAST(user_id AS VARCHAR)
    WHEN 'error' THEN CASE WHEN value > 20 THEN '1' END END AS as_double,
  CASE event_type WHEN 'error' THEN CASE WHEN value > 20 THEN 'true' END
    WHEN 'click' THEN CASE WHEN value = 0 THEN 'false' WHEN value = 1 THEN 'true' END END AS as_bool,
  CASE event_type WHEN 'click' THEN {NUM} WHEN 'view' THEN CAST(user_id AS VARCHAR)
    WHEN 'error' THEN CASE WHEN value > 20 THEN 'true' END ELSE {NESTED} END AS as_array,
  CASE WHEN event_type IN ('signup', 'purchase')
    THEN 'column x: ' || {KIND} || ' -> double: not a number' END AS double_error
FROM events""")
def hive_coerce(spark, sf):
    records = rec.records_of(mixed_events(spark, sf))
    staged, found = with_values(records, ["x"], ["line_no"])
    x = found["x"]
    as_type = lambda t: engines.hive_value(x.col, t, "x", x.k, x.t)
    return staged.select(
        "line_no",
        as_type("int").as_text().alias("as_int"),
        as_type("double").as_text().alias("as_double"),
        as_type("boolean").as_text().alias("as_bool"),
        as_type("array<string>").as_text().alias("as_array"),
        as_type("double").error_or_null().alias("double_error"),
    )


@query("graph_normalise", """
SELECT o_orderkey AS line_no, '{"at":{"x":' || o_custkey || ',"y":1.5,"z":null,"srid":7203},"id":'
  || (o_custkey * 4294967296 + o_orderkey) || ',"tags":["' || o_orderstatus || '",{"n":' || o_orderkey || '}],"owner":{"_id":'
  || o_custkey || ',"_labels":["Customer"],"properties":{"p":"' || o_orderpriority || '"}}}' AS value FROM orders""")
def graph_normalise(spark, sf):
    o = table(spark, sf, "orders")
    text = F.format_string(
        '{"at":{"x":{"low":%d,"high":0},"y":1.5,"srid":{"low":7203,"high":0}},"id":{"low":%d,"high":%d},'
        '"tags":["%s",{"n":{"low":%d,"high":0}}],"owner":{"identity":{"low":%d,"high":0},"labels":["Customer"],'
        '"properties":{"p":"%s"}}}',
        "o_custkey", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderkey", "o_custkey", "o_orderpriority",
    )
    return o.select(F.col("o_orderkey").alias("line_no"), engines.graph_json(text).alias("value"))


@query("graph_temporal", """
SELECT o_orderkey AS line_no, CASE WHEN o_orderkey % 7 <> 0 THEN '{"at":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || CASE o_orderkey % 3
  WHEN 0 THEN 'Z","zone":"' WHEN 1 THEN '+01:30","zone":"' ELSE '-02:00","zone":"' END || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')
  || '.000000012[Europe/Paris]","day":"' || strftime(o_orderdate, '%Y-%m-%d') || '","took":"P1M-2DT' || o_custkey || 'S","map":{"year":'
  || year(o_orderdate) || ',"month":13,"day":1}}' END AS value, o_orderkey % 7 = 0 AS bad FROM orders""")
def graph_temporal(spark, sf):
    o = table(spark, sf, "orders")
    day = [F.date_part(F.lit(p), "o_orderdate").cast("int") for p in ("YEAR", "MONTH", "DAY")]
    clock = [F.hour("o_orderdate"), F.minute("o_orderdate"), F.second("o_orderdate")]
    shift = F.element_at(F.array(F.lit(0), F.lit(5400), F.lit(-7200)), (F.col("o_orderkey") % 3 + 1).cast("int"))
    moment = '{"year":%d,"month":%d,"day":{"low":%d,"high":0},"hour":%d,"minute":%d,"second":%d,"nanosecond":'
    text = F.format_string(
        '{"at":' + moment + '0,"timeZoneOffsetSeconds":%d},"zone":' + moment + '12,"timeZoneOffsetSeconds":null,"timeZoneId":"Europe/Paris"},'
        '"day":{"year":%d,"month":%d,"day":%d},"took":{"months":1,"days":-2,"seconds":%d,"nanoseconds":0},"map":{"year":%d,"month":13,"day":1}}',
        *day, *clock, shift, *day, *clock, *day, F.col("o_custkey"), day[0],
    )
    # Every seventh text is cut short.
    given = F.when(F.col("o_orderkey") % 7 == 0, F.expr("left(t, length(t) - 1)")).otherwise(F.col("t"))
    found = o.withColumn("t", text).select("o_orderkey", engines.graph_result(given).alias("r"))
    return found.select(F.col("o_orderkey").alias("line_no"), F.col("r.value").alias("value"), F.col("r.error").isNotNull().alias("bad"))


@query("coerce_search", f"""
SELECT event_id AS line_no, CASE event_type WHEN 'click' THEN {NUM} WHEN 'view' THEN '"' || user_id || '"'
  WHEN 'error' THEN CASE WHEN value > 20 THEN 'true' ELSE 'null' END
  ELSE to_json({NESTED}) END AS as_keyword,
  CASE event_type WHEN 'click' THEN {NUM} WHEN 'view' THEN '"' || user_id || '"'
  WHEN 'error' THEN CASE WHEN value > 20 THEN 'true' ELSE 'null' END ELSE {NESTED} END AS as_long FROM events""")
def coerce_search(spark, sf):
    x = F.try_element_at("rec", F.lit("x"))
    return rec.records_of(mixed_events(spark, sf)).select(
        "line_no",
        F.to_json(coerce_for_search(x, "keyword")).alias("as_keyword"),
        F.to_json(coerce_for_search(x, "long")).alias("as_long"),
    )


@query("cast_dry_run", """
SELECT event_id AS line_no, CASE WHEN event_type = 'view' THEN user_id WHEN event_type = 'error' AND value > 20 THEN 1
  WHEN event_type = 'click' AND value = floor(value) THEN CAST(value AS BIGINT) END AS x,
  CASE WHEN event_type = 'click' AND value <> floor(value) THEN 'line ' || event_id
    || ', column x: number -> bigint: not an integer from -9223372036854775808 to 9223372036854775807'
   WHEN event_type = 'signup' THEN 'line ' || event_id || ', column x: object -> bigint: not an integer from -9223372036854775808 to 9223372036854775807'
   WHEN event_type = 'purchase' THEN 'line ' || event_id || ', column x: array -> bigint: not an integer from -9223372036854775808 to 9223372036854775807' END AS error
FROM events ORDER BY event_id LIMIT 50""")
def dry_run(spark, sf):
    records = rec.records_of(mixed_events(spark, sf))
    return cast_dry_run(records, ImportSpec({"x": "bigint"}), 50).select("line_no", "x", "error")


@query("coerce_integer_widths", """
SELECT o_orderkey AS line_no, CASE WHEN o_orderkey <= 127 THEN o_orderkey END AS small,
  CASE WHEN o_totalprice = floor(o_totalprice) THEN CAST(o_totalprice AS BIGINT) END AS whole,
  CASE WHEN o_orderkey > 127 THEN 'column small: number -> tinyint: not an integer from -128 to 127' END AS small_error,
  o_totalprice <> floor(o_totalprice) AS cut FROM orders""")
def coerce_integer_widths(spark, sf):
    """Fractions and values beyond an integer type are errors."""
    price = F.col("o_totalprice")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("line_no"), F.col("o_orderkey").cast("variant").alias("k"), price.cast("variant").alias("p"))
    small, whole = coerce_value(Val(F.col("k")), "tinyint", "small"), coerce_value(Val(F.col("p")), "bigint", "whole")
    return o.select(
        "line_no", small.as_type("bigint").alias("small"), whole.as_type("bigint").alias("whole"),
        small.error_or_null().alias("small_error"), whole.error_or_null().isNotNull().alias("cut"),
    )


# --- row quality -----------------------------------------------------------------

@query("unknown_columns", """
SELECT event_id + 1 AS line_no, 'line ' || (event_id + 1) || ' has columns the target lacks: '
  || CASE WHEN event_type = 'purchase' THEN 'buyer' ELSE 'props' END AS error
FROM events WHERE event_type IN ('purchase', 'signup')""")
def unknown_columns(spark, sf):
    checked = quality.reject_unknown_columns(rec.records_of(ragged_events(spark, sf)), ["event_id", "value"])
    return checked.filter("error IS NOT NULL").select("line_no", "error")


ORDER_TARGETS = {
    "o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "text", "o_totalprice": "double precision",
    "o_orderdate": "timestamp", "o_orderpriority": "varchar(15)",
}


def damaged_orders(spark, sf):
    """Orders whose urgent rows have a text for a price and whose low ones have a bad date."""
    o = table(spark, sf, "orders")
    urgent, low = F.col("o_orderpriority") == "1-URGENT", F.col("o_orderpriority") == "5-LOW"
    price = F.when(urgent, F.lit("unknown"))
    text = F.to_json(F.struct(
        "o_orderkey", "o_custkey", "o_orderstatus",
        F.coalesce(price, F.col("o_totalprice").cast("string")).alias("o_totalprice"),
        F.when(low, F.lit("soon")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("o_orderdate"),
        "o_orderpriority",
    ))
    return lines_of(o, F.col("o_orderkey") + 1, text)


@query("fail_fast", """
SELECT line_no, 0 AS row_idx, 'line ' || line_no || ', column ' || c AS error FROM (
  SELECT o_orderkey + 1 AS line_no, CASE WHEN o_orderpriority = '1-URGENT'
    THEN 'o_totalprice: string -> double precision: not a finite number'
    ELSE 'o_orderdate: string -> timestamp: not a date' END AS c
  FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') ORDER BY o_orderkey LIMIT 1)""")
def fail_fast(spark, sf):
    converted = convert_records(rec.records_of(damaged_orders(spark, sf)), ImportSpec(ORDER_TARGETS))
    return quality.first_failure(converted).select("line_no", "row_idx", "error")


@query("dead_letter", """
SELECT o_orderkey + 1 AS line_no, CASE WHEN o_orderpriority = '1-URGENT' THEN 'o_totalprice' ELSE 'o_orderdate' END AS column_name,
  'line ' || (o_orderkey + 1) || ', column ' || CASE WHEN o_orderpriority = '1-URGENT'
    THEN 'o_totalprice: string -> double precision: not a finite number'
    ELSE 'o_orderdate: string -> timestamp: not a date' END AS error
FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')""")
def dead_letter(spark, sf):
    _, dead = run_import(rec.records_of(damaged_orders(spark, sf)), ImportSpec(ORDER_TARGETS))
    return dead.select("line_no", "column_name", "error")


@query("import_good_rows", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderpriority
FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '5-LOW')""")
def import_good_rows(spark, sf):
    good, _ = run_import(rec.records_of(damaged_orders(spark, sf)), ImportSpec(ORDER_TARGETS))
    return good.select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderpriority",
    )


@query("validate_target", """
SELECT DISTINCT r.target, r.name FROM (SELECT 'c' || o_custkey AS target, o_orderpriority AS name FROM orders) r
WHERE NOT EXISTS (SELECT 1 FROM orders t WHERE 'c' || t.o_custkey = r.target AND t.o_orderpriority = r.name
  AND t.o_orderstatus = 'F')""")
def validate_target(spark, sf):
    o = table(spark, sf, "orders")
    requested = o.select(F.concat(F.lit("alias-"), "o_custkey").alias("target"), F.col("o_orderpriority").alias("name"))
    existing = o.filter("o_orderstatus = 'F'").select(
        F.concat(F.lit("c"), "o_custkey").alias("target"), F.col("o_orderpriority").alias("name")
    )
    aliases = table(spark, sf, "customer").select(
        F.concat(F.lit("alias-"), "c_custkey").alias("alias"), F.concat(F.lit("c"), "c_custkey").alias("target")
    )
    return quality.validate_target(requested, existing, aliases).distinct()


# --- inference ---------------------------------------------------------------------

@query("infer_value_type", """
SELECT coalesce(CASE event_type WHEN 'click' THEN CASE WHEN value = floor(value) THEN 'integer' ELSE 'number' END
  WHEN 'view' THEN 'string' WHEN 'error' THEN CASE WHEN value > 20 THEN 'boolean' END ELSE 'json' END, 'none') AS logical_type,
  count(*) AS n FROM events GROUP BY 1""")
def infer_value_type(spark, sf):
    x = F.try_element_at("rec", F.lit("x"))
    types = rec.records_of(mixed_events(spark, sf)).select(F.coalesce(infer.infer_value_type(x), F.lit("none")).alias("logical_type"))
    return types.groupBy("logical_type").agg(F.count(F.lit(1)).alias("n"))


LINEITEM_SCHEMA = """
SELECT CAST(o AS INTEGER) AS ordinal, name, t AS logical_type, false AS nullable, (SELECT count(*) FROM lineitem) AS present FROM (VALUES
 (0, 'l_orderkey', 'integer'), (1, 'l_partkey', 'integer'), (2, 'l_suppkey', 'integer'), (3, 'l_linenumber', 'integer'),
 (4, 'l_quantity', 'integer'), (5, 'l_extendedprice', 'number'), (6, 'l_discount', 'number'), (7, 'l_tax', 'number'),
 (8, 'l_returnflag', 'string'), (9, 'l_linestatus', 'string'), (10, 'l_shipdate', 'datetime')) v(o, name, t)"""


@query("infer_schema", LINEITEM_SCHEMA)
def infer_schema(spark, sf):
    li = table(spark, sf, "lineitem")
    return infer.infer_schema(rec.records_of(lines_of(li, "l_orderkey")))


@query("infer_schema_ragged", """
WITH k AS (
  SELECT 'event_id' AS name, 'integer' AS t, min(event_id) AS m, 0 AS p, count(*) AS present FROM events
  UNION ALL SELECT 'value', 'number', min(event_id), 1, count(*) FROM events WHERE event_type <> 'error'
  UNION ALL SELECT 'buyer', 'integer', min(event_id), 2, count(*) FROM events WHERE event_type = 'purchase'
  UNION ALL SELECT 'props', 'string', min(event_id), 3, count(*) FROM events WHERE event_type = 'signup')
SELECT CAST(row_number() OVER (ORDER BY m, p) - 1 AS INTEGER) AS ordinal, name, t AS logical_type,
  present < (SELECT count(*) FROM events) AS nullable, present FROM k""")
def infer_schema_ragged(spark, sf):
    return infer.infer_schema(rec.records_of(ragged_events(spark, sf)))


@query("infer_schema_keyed_by_data", """
SELECT 0 AS ordinal, 'id' AS name, 'integer' AS logical_type, false AS nullable, (SELECT count(*) FROM orders WHERE o_orderpriority <> '5-LOW') AS present
UNION ALL SELECT row_number() OVER (ORDER BY o_orderkey), 'k' || o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'string' ELSE 'integer' END, true, 1
FROM orders WHERE o_orderpriority <> '5-LOW'""")
def infer_schema_keyed_by_data(spark, sf):
    """Records with a key of their own each: as many columns as records; broken lines are handed on beside them."""
    o = table(spark, sf, "orders")
    value = F.when(F.col("o_orderstatus") == "F", F.lit('"x"')).otherwise(F.col("o_custkey").cast("string"))
    whole = F.concat(F.lit('{"id":'), "o_orderkey", F.lit(',"k'), "o_orderkey", F.lit('":'), value, F.lit("}"))
    text = F.when(F.col("o_orderpriority") == "5-LOW", F.lit('{"id":')).otherwise(whole)
    columns, bad = infer.infer_with_errors(rec.records_of(lines_of(o, F.col("o_orderkey") + 1, text)))
    return columns


@query("infer_schema_sample", """
WITH s AS (SELECT * FROM events ORDER BY event_id LIMIT 1000), k AS (
  SELECT 'event_id' AS name, 'integer' AS t, min(event_id) AS m, 0 AS p, count(*) AS present FROM s
  UNION ALL SELECT 'value', 'number', min(event_id), 1, count(*) FROM s WHERE event_type <> 'error'
  UNION ALL SELECT 'buyer', 'integer', min(event_id), 2, count(*) FROM s WHERE event_type = 'purchase'
  UNION ALL SELECT 'props', 'string', min(event_id), 3, count(*) FROM s WHERE event_type = 'signup')
SELECT CAST(row_number() OVER (ORDER BY m, p) - 1 AS INTEGER) AS ordinal, name, t AS logical_type,
  present < 1000 AS nullable, present FROM k""")
def infer_schema_sample(spark, sf):
    return infer.infer_schema_sample(rec.records_of(ragged_events(spark, sf)), 1000)


@query("infer_schema_files", """
SELECT 0 AS ordinal, 'o_orderkey' AS name, 'integer' AS logical_type, false AS nullable, 500 AS present
UNION ALL SELECT 1, 'o_orderpriority', 'string', false, 500
UNION ALL SELECT 2, 'o_clerk', 'string', true, count(*) FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 500) WHERE o_orderstatus = 'F'""")
def infer_schema_files(spark, sf):
    """The first 500 records of a folder of files, of which only the beginning is read."""
    path = scratch(spark, "sampled")
    clerk = F.when(F.col("o_orderstatus") == "F", F.lit("c"))
    text = F.to_json(F.struct("o_orderkey", "o_orderpriority", clerk.alias("o_clerk")))
    o = table(spark, sf, "orders").repartitionByRange(4, "o_orderkey").sortWithinPartitions("o_orderkey")
    o.select(text.alias("value")).write.text(path)
    columns, _ = infer.infer_schema_files(spark, path, 500)
    return columns


@query("infer_schema_hits", """
WITH c AS (SELECT count(*) AS n, count(*) FILTER (c_mktsegment = 'BUILDING') AS flat FROM customer),
f AS (SELECT c_mktsegment = 'BUILDING' AS first_flat FROM customer ORDER BY c_custkey LIMIT 1),
k AS (SELECT '_id' AS name, 'string' AS t, flat AS present, 3 AS p FROM c UNION ALL SELECT '_index', 'string', flat, 4 FROM c
  UNION ALL SELECT 'c_acctbal', 'number', n, 1 FROM c UNION ALL SELECT 'c_name', 'string', n, 2 FROM c)
SELECT CAST(row_number() OVER (ORDER BY p) - 1 AS INTEGER) AS ordinal, name, t AS logical_type,
  present < c.n AS nullable, present FROM k, c""")
def infer_schema_hits(spark, sf):
    return infer.infer_schema_hits(rec.records_of(customer_hits(spark, sf)))


@query("target_types", """
SELECT event_type AS engine_of, CASE event_type WHEN 'click' THEN 'double precision' WHEN 'view' THEN 'double' WHEN 'error' THEN 'timestamp'
  WHEN 'signup' THEN 'object' ELSE 'tinyint(1)' END AS target_type, count(*) AS n FROM events GROUP BY 1, 2""")
def target_types(spark, sf):
    e = table(spark, sf, "events")
    pick = lambda *pairs: F.coalesce(*[F.when(F.col("event_type") == t, F.lit(v)) for t, v in pairs])
    engine = pick(("click", "postgresql"), ("view", "mysql"), ("error", "hive"), ("signup", "elasticsearch"), ("purchase", "mysql"))
    logical = pick(("click", "number"), ("view", "number"), ("error", "datetime"), ("signup", "json"), ("purchase", "boolean"))
    typed = e.select(F.col("event_type").alias("engine_of"), targets.target_type(engine, logical).alias("target_type"))
    return typed.groupBy("engine_of", "target_type").agg(F.count(F.lit(1)).alias("n"))


def _events_schema(spark, sf):
    e = table(spark, sf, "events").select(
        "event_id", "event_type", "value", F.when(F.col("value") > 5, F.col("user_id")).alias("user id"),
        F.from_json("props", "map<string,int>").alias("props"),
    )
    return infer.infer_schema(rec.records_of(lines_of(e, F.col("event_id") + 1)))


@query("create_table_ddl", """
SELECT 'postgresql' AS engine, 'CREATE TABLE IF NOT EXISTS "app"."ev""ents" (' || chr(10) || '  "event_id" bigint NOT NULL,' || chr(10)
 || '  "event_type" text NOT NULL,' || chr(10) || '  "value" double precision NOT NULL,' || chr(10) || '  "user id" bigint,' || chr(10)
 || '  "props" jsonb NOT NULL' || chr(10) || ');' AS definition
UNION ALL SELECT 'mysql', 'CREATE TABLE IF NOT EXISTS `app`.`ev"ents` (' || chr(10) || '  `event_id` bigint NOT NULL,' || chr(10)
 || '  `event_type` text NOT NULL,' || chr(10) || '  `value` double NOT NULL,' || chr(10) || '  `user id` bigint,' || chr(10)
 || '  `props` json NOT NULL' || chr(10) || ') ENGINE=InnoDB DEFAULT CHARSET=utf8mb4;'
UNION ALL SELECT 'hive', 'CREATE TABLE IF NOT EXISTS `app`.`ev"ents` (' || chr(10) || '  `event_id` bigint NOT NULL,' || chr(10)
 || '  `event_type` string NOT NULL,' || chr(10) || '  `value` double NOT NULL,' || chr(10) || '  `user id` bigint,' || chr(10)
 || '  `props` string NOT NULL' || chr(10) || ')' || chr(10) || 'STORED AS TEXTFILE;'""")
def create_table_ddl(spark, sf):
    schema = _events_schema(spark, sf)
    each = [
        targets.create_table_ddl(schema, e, 'ev"ents', "app").select(F.lit(e).alias("engine"), "definition")
        for e in ("postgresql", "mysql", "hive")
    ]
    return each[0].union(each[1]).union(each[2])


@query("index_mapping", """
SELECT '{"mappings":{"properties":{"event_id":{"type":"long"},"event_type":{"type":"text","fields":{"keyword":{"type":"keyword","ignore_above":256}}},'
 || '"value":{"type":"double"},"user id":{"type":"long"},"props":{"type":"object","enabled":true}}}}' AS definition""")
def index_mapping(spark, sf):
    return targets.index_mapping(_events_schema(spark, sf))


@query("flatten_mapping", """
SELECT p_partkey, u.name, u.type FROM part, LATERAL (VALUES ('name', 'text'), ('name.keyword', 'keyword'), ('size', 'integer'),
  ('box', 'nested'), ('box.' || p_type, 'object'), ('box.' || p_type || '.w', 'float'), ('loose', 'object')) u(name, type)""")
def flatten_mapping(spark, sf):
    p = table(spark, sf, "part")
    text = F.concat(
        F.lit('{"name":{"type":"text","fields":{"keyword":{"type":"keyword"}}},"size":{"type":"integer"},'
              '"box":{"type":"nested","properties":{"'), F.col("p_type"),
        F.lit('":{"type":"object","properties":{"w":{"type":"float"}}}}},"loose":{"properties":{"in":{"type":"long"}}}}'),
    )
    mappings = p.select("p_partkey", F.parse_json(text).alias("m"))
    return targets.flatten_mapping(mappings, "m", "listing", depth=6)
