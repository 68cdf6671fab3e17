import json

import pytest
from pyspark.sql import functions as F

from recordloom.functions import engines
from recordloom.functions.convert import FieldRule, Val, coerce_for_search, coerce_value, convert_column, family
from recordloom.functions.values import kind, string_of, value_number
from recordloom.operators import project, quality
from recordloom.plans.import_plan import ImportSpec, convert_records, run_import


@pytest.fixture
def one(spark):
    def run(text, rule=None, target=None):
        df = spark.createDataFrame([(text,)], "j string").select(F.parse_json("j").alias("v"))
        val = convert_column(F.col("v"), "c", rule, target)
        row = df.select(val.as_text().alias("value"), val.error_or_null().alias("error")).collect()[0]
        return row.value, row.error

    return run


@pytest.mark.parametrize(
    "text, rule, target, want",
    [
        ('{"a":1}', None, "text", '{"a":1}'),
        ('{"a":1}', None, "character varying", '{"a":1}'),
        ('["a","b"]', FieldRule("c", "cast", "array<string>", "text", options={"arrayDelimiter": "|"}), None, "a|b"),
        ('["a",null,1.0,[2]]', FieldRule("c", "cast", "array<string>", "text"), None, "a,null,1,[2]"),
        ('"x"', FieldRule("c", "cast", "array<string>", "text"), None, "x"),
        ('{"a":1}', FieldRule("c", "cast", "map<string,int>", "text"), None, '{"a":1}'),
        ("2", FieldRule("c", "cast", "int", "boolean"), None, "true"),
        ('"0"', FieldRule("c", "cast", "bigint", "bool"), None, "false"),
        ('""', FieldRule("c", "cast", "number", "bool"), None, "false"),
        ('"2026-09-17T02:00:00+08:00"', FieldRule("c", "cast", "iso-string", "timestamp"), None, "2026-09-16T18:00:00.000Z"),
        ('"2026-09-17"', FieldRule("c", "cast", "iso", "x"), None, "2026-09-17T00:00:00.000Z"),
        ("42", FieldRule("c", "stringify"), None, "42"),
        ("1.0", FieldRule("c", "stringify"), None, "1"),
        ('"q\\"x"', FieldRule("c", "json"), None, '"q\\"x"'),
        ("null", FieldRule("c", "json"), "integer", None),
        ("5", FieldRule("c", "cast", "varchar", "uuid"), None, "5"),
        ('" 12 "', None, "bigint", " 12 "),
        ('"0x1F"', None, "int", "0x1F"),
        ("true", None, "tinyint(1)", "1"),
        ("7", None, "boolean", "true"),
        ('"FALSE"', None, "boolean", "false"),
        ("0", None, "datetime", "1970-01-01T00:00:00.000Z"),
        ("1767323045123", None, "timestamp with time zone", "2026-01-02T03:04:05.123Z"),
        ('"2026-01-02 03:04:05"', None, "date", "2026-01-02T03:04:05.000Z"),
        ('"2026-01-02T03:04Z"', None, "timestamptz", "2026-01-02T03:04:00.000Z"),
        ('"{\\"a\\": 1}"', None, "jsonb", '{"a": 1}'),
        ('"plain"', None, "json", '"plain"'),
        ("1.5", None, "json", "1.5"),
        ('["x"]', None, "uuid", '["x"]'),
    ],
)
def test_values(one, text, rule, target, want):
    assert one(text, rule, target) == (want, None)


@pytest.mark.parametrize(
    "text, rule, target, error",
    [
        ('"not-a-number"', None, "integer", "column c: string -> integer: not an integer from -2147483648 to 2147483647"),
        ('" "', None, "integer", "column c: string -> integer: not an integer from -2147483648 to 2147483647"),
        ('"1e999"', None, "double", "column c: string -> double: not a finite number"),
        ("[1]", None, "numeric(4,2)", "column c: array -> numeric(4,2): not a finite number"),
        ('"2"', None, "boolean", "column c: string -> boolean: not a boolean"),
        ('"10:00"', None, "timestamp", "column c: string -> timestamp: not a date"),
        ("9e15", None, "timestamp", "column c: number -> timestamp: not a date"),
        ('"x"', FieldRule("c", "cast", "int", "boolean"), None, "column c: int -> boolean: not a finite number"),
        ('"not-a-date"', FieldRule("c", "cast", "iso-string", "timestamp"), "timestamp", "column c: iso-string -> timestamp: not a date and time"),
        ("5", FieldRule("c", "stringify", target_type="note"), "bool", "column c: note -> bool: not a boolean"),
    ],
)
def test_failures(one, text, rule, target, error):
    assert one(text, rule, target) == (None, error)


@pytest.mark.parametrize(
    "name, want",
    [
        ("int", "numeric"), ("int(11) unsigned", "numeric"), ("tinyint unsigned", "numeric"), ("double precision", "numeric"),
        ("INTEGER", "numeric"), ("interval", "other"), ("timestamp with  time zone", "temporal"), ("time", "other"),
        ("datetime(6)", "temporal"), ("bit", "other"), ("varchar(10)", "string"), ("keyword", "other"), ("jsonb", "json"),
    ],
)
def test_families(name, want):
    assert family(name) == want


@pytest.mark.parametrize(
    "text, want",
    [("1e20", "100000000000000000000"), ("1e21", "1e+21"), ("1.5e300", "1.5e+300"), ("0.0000001", "1e-7"), ("12345678.9", "12345678.9"),
     ("1.23e-5", "0.0000123"), ("100000.0", "100000"), ("9007199254740993", "9007199254740993"), ("-0.5", "-0.5"), ("1e3", "1000"), ("0.0", "0")],
)
def test_number_text(spark, text, want):
    df = spark.createDataFrame([(text,)], "j string").select(string_of(F.parse_json("j")).alias("s"))
    assert df.collect()[0].s == want


def test_timestamps_do_not_depend_on_the_session_zone(spark, one):
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert one('"2026-01-02 03:04:05"', None, "timestamp") == ("2026-01-02T03:04:05.000Z", None)
        assert one('"2026-11-01T05:30:00Z"', None, "timestamp")[0] == "2026-11-01T05:30:00.000Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_mysql_and_postgres_values(spark):
    texts = ["null", "true", '{"k":"v"}', "[1,2,3]", '{"type":"Buffer","data":[1,2]}', '"x"', "1.50"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, j string").select("i", F.parse_json("j").alias("v"))
    rows = df.select(engines.mysql_value(F.col("v")).alias("m"), engines.postgres_value(F.col("v")).alias("p")).orderBy("i").collect()
    assert [r.m for r in rows] == [None, "1", '{"k":"v"}', "[1,2,3]", "0102", "x", "1.5"]
    assert [r.p for r in rows][:3] == [None, "true", '{"k":"v"}']
    binary = spark.sql("select cast('hello' as binary) b, true t")
    assert binary.select(engines.mysql_column(F.col("b"), engines.T.BinaryType()).alias("x")).collect()[0].x == "68656c6c6f"


@pytest.mark.parametrize(
    "text, dtype, want, error",
    [
        ("3.0", "int", "3", None), ("3.5", "bigint", None, "not an integer"), ('"x"', "double", None, "not a number"), ('"TRUE"', "boolean", "true", None),
        ('"1"', "boolean", None, "not a boolean"), ("1", "boolean", "true", None), ('" "', "date", None, "not a date"), ('"0aFF"', "binary", "0aff", None),
        ('"hi"', "binary", "6869", None), ('["a"]', "array<string>", '["a"]', None), ('"raw"', "map<string,int>", "raw", None), ("[1]", "string", "[1]", None),
        ('""', "int", "0", None), ('"1.50"', "decimal(10,2)", "1.5", None),
    ],
)
def test_hive_values(spark, text, dtype, want, error):
    val = engines.hive_value(F.parse_json(F.lit(text)), dtype, "c")
    row = spark.range(1).select(val.as_text().alias("v"), val.error_or_null().alias("e")).collect()[0]
    assert row.v == want and (row.e is None if error is None else row.e.endswith(error))


def test_graph_values():
    n = engines.normalise_graph
    assert n({"low": 5, "high": 1}) == 4294967301 and n({"low": -1, "high": 0}) == -1
    assert n({"x": 1, "y": 2, "srid": {"low": 7203, "high": 0}}) == {"x": 1, "y": 2, "z": None, "srid": 7203}
    node = {"identity": {"low": 1, "high": 0}, "labels": ["A"], "properties": {"p": [{"low": 2, "high": 0}]}}
    assert n(node) == {"_id": 1, "_labels": ["A"], "properties": {"p": [2]}}
    edge = {"identity": 1, "type": "T", "start": 2, "end": 3, "properties": {}}
    assert n(edge) == {"_id": 1, "_type": "T", "_src": 2, "_dst": 3, "properties": {}}
    deep = {"low": 1, "high": 0}
    for _ in range(60):
        deep = {"d": [deep]}
    assert json.dumps(n(deep)).count("d") == 60


@pytest.mark.parametrize("value, want", [
    ({"year": 2024, "month": 5, "day": {"low": 6, "high": 0}}, "2024-05-06"),
    ({"year": -5, "month": 5, "day": 6}, "-0005-05-06"),
    ({"hour": 7, "minute": 8, "second": 9, "nanosecond": 0}, "07:08:09"),
    ({"hour": 7, "minute": 8, "second": 9, "nanosecond": 10, "timeZoneOffsetSeconds": -5400}, "07:08:09.000000010-01:30"),
    ({"year": 2024, "month": 5, "day": 6, "hour": 7, "minute": 8, "second": 9, "nanosecond": 0, "timeZoneOffsetSeconds": 0}, "2024-05-06T07:08:09Z"),
    ({"year": 2024, "month": 5, "day": 6, "hour": 7, "minute": 8, "second": 9, "nanosecond": 0, "timeZoneOffsetSeconds": 7200, "timeZoneId": "Europe/Rome"},
     "2024-05-06T07:08:09+02:00[Europe/Rome]"),
    ({"months": 14, "days": -3, "seconds": -2, "nanoseconds": 500_000_000}, "P14M-3DT-1.500000000S"),
])
def test_graph_temporals(value, want):
    assert engines.normalise_graph({"v": [value]}) == {"v": [want]}


@pytest.mark.parametrize("value", [
    {}, {"year": 2024}, {"year": 2024, "month": 13, "day": 1}, {"year": 2024, "month": 5, "day": "6"}, {"year": 2024, "month": 5, "day": 6, "note": 1},
    {"year": 2024.5, "month": 5, "day": 6}, {"hour": 7, "minute": 8}, {"months": 1, "days": 2}, {"timeZoneOffsetSeconds": 5},
])
def test_maps_that_are_no_temporals_stay(value):
    assert engines.normalise_graph(value) == value


def test_graph_texts_that_are_no_json_or_deep(spark):
    deep = '{"d":[' * 2500 + '{"low":1,"high":0}' + "]}" * 2500
    given = [deep, "[" * 400_000, "{bad", "NaN", '"\\ud800"', None, "", '{"a":null}']
    rows = spark.createDataFrame(list(enumerate(given)), "i int, t string").select("i", engines.graph_result("t").alias("r"), engines.graph_json("t").alias("v"))
    found = {r.i: (r.r.value, r.r.error) for r in rows.collect()}
    assert found[0] == (deep.replace('{"low":1,"high":0}', "1"), None) and found[7] == ('{"a":null}', None)
    assert found[1] == (None, "nested too deeply") and found[5] == (None, None)
    assert all(found[i][0] is None and found[i][1].startswith("not JSON") for i in (2, 3, 4, 6))


def test_search_strings(spark):
    df = spark.range(1).select(*[F.to_json(coerce_for_search(F.parse_json(F.lit('{"a":1}')), t)).alias(t) for t in ("keyword", "long")])
    assert tuple(df.collect()[0]) == ('"{\\"a\\":1}"', '{"a":1}')


def test_rules_are_checked():
    for bad in (dict(source=" ", strategy="json"), dict(source="a", strategy="x"), dict(source="a", strategy="cast", source_type="int")):
        with pytest.raises(ValueError):
            FieldRule(**bad)
    with pytest.raises(ValueError):
        ImportSpec({"a": "int"}, rules=[FieldRule("a", "json"), FieldRule("a", "skip")]).sources()
    with pytest.raises(ValueError):
        ImportSpec({"a": "int"}, rules=[FieldRule("b", "json", target="z")]).sources()


def test_import_skips_and_reports(records):
    spec = ImportSpec({"id": "int", "name": "string", "active": "boolean"}, metastore=True)
    r = records(['{"columns":["id","name","active"],"rows":[[3,"Carol",true],[4,"Bad","not-a-bool"]]}', "{broken", '{"id":5,"zip":1}'])
    good, dead = run_import(r, spec)
    assert [tuple(x)[3:] for x in good.collect()] == [(3, "Carol", True)]
    d = {(x.line_no, x.row_idx): x for x in dead.collect()}
    assert d[(1, 1)].column_name == "active" and "line 1" in d[(1, 1)].error and "active" in d[(1, 1)].error
    assert d[(2, 0)].error == "line 2 is not a JSON object"
    assert d[(3, 0)].error == "line 3 has columns the target lacks: zip"


def test_import_stops_at_the_first_bad_row(records):
    r = records(['{"id":1}', '{"id":"x"}', '{"id":"y"}'])
    with pytest.raises(quality.RowError, match="line 2, column id: string -> int: not an integer from -2147483648 to 2147483647"):
        run_import(r, ImportSpec({"id": "int"}), "fail")


def test_missing_selected_column_stops_even_when_skipping(records):
    good, _ = run_import(records(['{"id":1}']), ImportSpec({"id": "int", "b": "text"}, selected=["id", "b"]))
    with pytest.raises(Exception, match="line 1 lacks selected columns: b"):
        good.collect()


def test_rules_rename_skip_and_need_their_source(records):
    spec = ImportSpec({"key": "bigint", "tags": "text"}, rules=[FieldRule("id", "cast", "int", "bigint", "key"), FieldRule("secret", "skip"),
                                                                 FieldRule("tags", "cast", "array<string>", "text")])
    rows = convert_records(records(['{"id":42,"secret":"x","tags":["a","b"]}', '{"id":1,"tags":null}']), spec).orderBy("line_no").collect()
    assert (rows[0].key, rows[0].tags, rows[0].error) == (42, "a,b", None)
    assert rows[1].error == "line 2 lacks columns to convert: secret"


def test_value_that_does_not_fit_is_an_error(records):
    row = convert_records(records(['{"n":99999999999999999999}']), ImportSpec({"n": "bigint"})).collect()[0]
    assert row.n is None and row.error_column == "n"


def test_projection(records):
    r = records(['{"b":1,"a":2,"c":null}'])
    keys = lambda df: df.select(F.map_keys("rec")).collect()[0][0]
    assert keys(project.project(r, ["a", "b"])) == ["b", "a"]
    assert keys(project.project_document(r, ["a", "b"])) == ["a", "b"]
    assert keys(project.project(r, None)) == ["b", "a", "c"]
    assert keys(project.rename_skip(r, {"b": "z"}, ["a"])) == ["z", "c"]
    assert project.require_columns(r, ["c"]).collect()[0].error is None
    assert project.require_columns(r, ["x", "c", "y"]).collect()[0].error == "line 1 lacks selected columns: x, y"
    assert [x.name for x in project.union_columns(records(['{"b":1}', '{"a":1,"b":2}'])).orderBy("ordinal").collect()] == ["b", "a"]
    assert [x.name for x in project.first_record_columns(records(["", '{"_id":1,"_source":{"q":1}}'])).collect()] == ["q"]


@pytest.mark.parametrize("text,target,fits", [
    ("3.7", "bigint", False), ('"3.7"', "bigint", False), ("3.0", "bigint", True), ("300", "tinyint", False), ("-129", "tinyint", False),
    ("200", "tinyint unsigned", True), ("-1", "int unsigned", False), ("40000", "smallint", False), ("2147483648", "int", False),
    ("9223372036854775807", "bigint", True), ("99999999999999999999", "bigint", False), ("3.7", "double precision", True),
])
def test_integer_widths(one, text, target, fits):
    value, error = one(text, None, target)
    assert (error is None) == fits and (value is None) == (not fits)
    assert fits or "integer from" in error


def test_graph_values_share_one_decoder_a_batch(monkeypatch):
    import json

    import pandas as pd

    made = []

    class Counted(json.JSONDecoder):
        def __init__(self, *a, **k):
            made.append(1)
            super().__init__(*a, **k)

    monkeypatch.setattr(json, "JSONDecoder", Counted)
    texts = ['{"d":{"year":2020,"month":2,"day":{"low":3,"high":0},"hour":null}}', "{", None, '[NaN]', '{"low":1,"high":1}'] * 50
    got = engines.graph_result.func(pd.Series(texts, dtype=object))
    assert got["value"][:5].tolist() == ['{"d":"2020-02-03"}', None, None, None, "4294967297"] and got["error"].notna().sum() == 100
    assert len(made) == 1


def test_plain_days_equal_the_general_way(spark):
    """Days are counted, not parsed with a time zone; what is no day, or none that exists, is as before, in any session zone."""
    from recordloom.functions.values import _unusual_stamp, let, text_timestamp

    days = ["1998-02-06", "1969-12-31", "0000-01-01", "9999-12-31", "2000-02-29", "1999-02-29", "1998-13-01", "1998-02-06\n", " 1998-02-06",
            "soon", "", "1998", "1998-02", "1998-2-6", "1582-10-10", None]
    frame = spark.createDataFrame([(d,) for d in days], "d string").repartition(2)
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for z in ("UTC", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", z)
            got = frame.select("d", F.unix_micros(text_timestamp(F.col("d"))).alias("a"), F.unix_micros(let(F.col("d"), _unusual_stamp)).alias("b")).collect()
            assert all(r.a == r.b for r in got), [r for r in got if r.a != r.b]
            assert {r.d: r.a for r in got}["1998-02-06"] == 886723200000000
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
