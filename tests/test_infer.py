import json

import pytest
from pyspark.sql import functions as F

from recordloom.operators import infer, targets

PAIRS = [
    ("true", "boolean"), ("42", "integer"), ("1152921504606846976", "bigint"), ("3.5", "number"), ("1e3", "integer"), ("1.0", "integer"), ("1e300", "bigint"),
    ('"2026-09-27T12:00:00Z"', "datetime"), ('"2026-09-27"', "datetime"), ('"2026-09-27x"', "string"), ('"hello"', "string"), ('{"a":1}', "json"),
    ("[1,2]", "json"), ("null", None),
]


@pytest.mark.parametrize("text, want", PAIRS)
def test_value_types(spark, text, want):
    assert spark.range(1).select(infer.infer_value_type(F.parse_json(F.lit(text)))).collect()[0][0] == want


@pytest.mark.parametrize(
    "a, b, want",
    [("integer", "bigint", "bigint"), ("bigint", "number", "number"), ("integer", "number", "number"), ("string", "datetime", "string"),
     ("boolean", "integer", "string"), ("json", "string", "string"), ("json", "json", "json"), ("number", "datetime", "string"), ("boolean", "number", "string")],
)
def test_merge(spark, a, b, want):
    both = spark.range(1).select(infer.merge_types(F.lit(a), F.lit(b)), infer.merge_types(F.lit(b), F.lit(a))).collect()[0]
    assert tuple(both) == (want, want)


def schema(df):
    return [(r.name, r.logical_type, r.nullable, r.present) for r in df.orderBy("ordinal").collect()]


def test_schema_order_nullability_presence(records):
    r = records(['{"id":1,"name":"a","score":1,"active":true,"meta":{"a":1}}', '{"id":2,"name":null,"score":2.5,"active":false,"meta":null}', '{"id":3,"name":"c","score":3}'])
    assert schema(infer.infer_schema(r)) == [
        ("id", "integer", False, 3), ("name", "string", True, 3), ("score", "number", False, 3), ("active", "boolean", True, 2), ("meta", "json", True, 2)]
    assert schema(infer.infer_schema(records(['{"id":1,"extra":"x"}', '{"id":2}'])))[1] == ("extra", "string", True, 1)
    assert schema(infer.infer_schema(records(['{"n":null,"":1}']))) == [("n", "string", True, 1), ("", "integer", False, 1)]


def test_schema_does_not_depend_on_partitions(records):
    texts = [json.dumps({f"k{i % 5}": i, f"z{i % 3}": str(i) if i % 2 else i}) for i in range(60)]
    r = records(texts)
    assert schema(infer.infer_schema(r.repartition(7))) == schema(infer.infer_schema(r.coalesce(1)))


def test_sample_and_hits(records):
    r = records(['{"columns":["id"],"rows":[[1],[2]]}', "", '{"id":"x"}'])
    assert schema(infer.infer_schema_sample(r, 2)) == [("id", "integer", False, 2)]
    assert schema(infer.infer_schema_sample(r)) == [("id", "string", False, 3)]
    hits = records(['{"_id":"1","_source":{"name":"a","count":3}}', '{"_id":"2","_source":{"name":"b","count":4}}'])
    assert [(n, t) for n, t, *_ in schema(infer.infer_schema_hits(hits))] == [("count", "integer"), ("name", "string")]


def columns(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ordinal int, name string, logical_type string, nullable boolean")


def test_definitions(spark):
    c = columns(spark, [("id", "integer", False), ('we"ird', "json", True), ("at", "datetime", True), ("s", "string", True)])
    text = lambda e, s=None: targets.create_table_ddl(c, e, "t", s).collect()[0].definition
    assert text("postgresql", "public") == 'CREATE TABLE IF NOT EXISTS "public"."t" (\n  "id" bigint NOT NULL,\n  "we""ird" jsonb,\n  "at" timestamptz,\n  "s" text\n);'
    assert text("mysql").endswith("  `at` datetime(6),\n  `s` text\n) ENGINE=InnoDB DEFAULT CHARSET=utf8mb4;")
    assert text("hive").endswith("\n)\nSTORED AS TEXTFILE;")
    mapping = json.loads(targets.index_mapping(c).collect()[0].definition)["mappings"]["properties"]
    assert list(mapping) == ["id", 'we"ird', "at", "s"]
    assert mapping["s"] == {"type": "text", "fields": {"keyword": {"type": "keyword", "ignore_above": 256}}}
    assert mapping['we"ird'] == {"type": "object", "enabled": True} and mapping["id"] == {"type": "long"}
    with pytest.raises(Exception, match="no columns"):
        targets.create_table_ddl(columns(spark, []), "mysql", "t").collect()
    with pytest.raises(Exception, match="no columns"):
        targets.index_mapping(columns(spark, [])).collect()


MAPPING = '{"name":{"type":"text","fields":{"keyword":{"type":"keyword"}}},"user":{"properties":{"id":{"type":"long"}}},"box":{"type":"nested","properties":{"w":{"type":"float"}}}}'


def test_flatten_mapping(spark):
    df = spark.range(1).select("id", F.parse_json(F.lit(MAPPING)).alias("m"))
    names = lambda mode: sorted((r.name, r.type) for r in targets.flatten_mapping(df, "m", mode, 5).collect())
    assert names("listing") == [("box", "nested"), ("box.w", "float"), ("name", "text"), ("name.keyword", "keyword"), ("user", "object")]
    assert names("typed") == [("box", "nested"), ("box.w", "float"), ("name", "text"), ("name.keyword", "keyword"), ("user.id", "long")]
    with pytest.raises(Exception, match="nested too deeply"):
        targets.flatten_mapping(df, "m", "listing", 1).collect()


def test_create_if_missing(spark, tmp_path):
    ddl = targets.spark_table_ddl([("id", "bigint")], "made_once", "parquet", str(tmp_path / "t"))
    assert targets.create_if_missing(spark, "made_once", ddl) is True
    assert targets.create_if_missing(spark, "made_once", "not even sql") is False
    for bad in (None, "  ", "x" * 20_001):
        with pytest.raises(ValueError):
            targets.create_if_missing(spark, "not_there", bad)


def test_places_are_long_integers_unless_too_large(spark):
    """Columns are in order of first places, small and very large ones; the first aggregation has no decimals to carry for small ones."""
    from recordloom.sources.records import records_of

    rows = [("f", 1 << 50, '{"c":1,"a":1}'), ("f", 7, '{"b":1,"a":9007199254740992}'), ("f", (1 << 42) - 1, '{"d":"2020-01-01"}'), ("f", 1 << 42, '{"e":"2020"}')]
    made = infer.infer_schema(records_of(spark.createDataFrame(rows, "file string, line_no bigint, value string")))
    assert [(r.name, r.logical_type) for r in made.orderBy("ordinal").collect()] == [("b", "integer"), ("a", "bigint"), ("d", "datetime"), ("e", "string"), ("c", "integer")]
    assert infer.LINE_BITS + infer.POS_BITS == 63


def test_marks_of_lines_are_no_new_keys(spark):
    """The parser keeps every key it meets, so lines may not bring one each."""
    from recordloom.functions.values import only_record, parse_wrapped

    texts = ['{"a":1}', '{"a":2} ', '{"a":1},{"":5}', '{"a":1}]}', '{"":1}', "[1]", '{"a":1},{"b":{}', '{"a":1} x']
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", parse_wrapped(F.col("t")).alias("w"))
    keys = df.select(F.explode(F.map_keys(F.get("w", 1))).alias("k")).distinct().collect()
    assert [r.k for r in keys] == [""]
    good = df.select("t", F.to_json(only_record(F.col("w"), F.col("t"))).alias("r")).filter("r IS NOT NULL").collect()
    assert {r.t: r.r for r in good} == {'{"a":1}': '{"a":1}', '{"a":2} ': '{"a":2}', '{"":1}': '{"":1}'}
