import json

import pytest
from pyspark.sql import functions as F

from recordloom.sinks import lines as out
from recordloom.sources import records as rec
from recordloom.sources.lines import read_lines
from recordloom.sources.tables import jdbc_options, read_csv_table, scan_many, sliced_scan


def shown(df):
    rows = df.select("line_no", "row_idx", F.to_json("rec").alias("rec"), "error").orderBy("line_no", "row_idx")
    return [(r.line_no, r.row_idx, r.rec, r.error) for r in rows.collect()]


def test_record_lines_keep_key_order_and_last_duplicate(records):
    got = shown(records(['{"id":1,"bbb":"x","aaa":2}', "", '{"a":1,"b":2,"a":3}', "  "]))
    assert got == [(1, 0, '{"id":1,"bbb":"x","aaa":2}', None), (3, 0, '{"a":3,"b":2}', None)]


@pytest.mark.parametrize("text", ["{not json", "[1]", "7", "null", '"s"', '{"a":1', '{"a":1} x', '{"a":1}{"b":2}', '{"a":1},{"b":2}'])
def test_other_lines_are_errors_with_their_number(records, text):
    assert shown(records(['{"ok":1}', text]))[1] == (2, 0, None, "line 2 is not a JSON object")


@pytest.mark.parametrize("table", [
    '{"schema":"lab","name":"readings"}', '{"database":"d1","name":"readings"}', '{"name":"readings"}', '{"name":"r","keys":["probe"],"extra":{"n":1}}', "null",
])
@pytest.mark.parametrize("row", [
    [17, "probe-ä", {"depth_m": -3.25, "tags": []}], [-1, "", None], [0, "two\nlines", [True, {"k": [1]}]], [2**53 + 1, "\"quoted\"", 1.5],
])
def test_every_envelope_gives_the_same_kind_of_record(records, table, row):
    columns = ["probe", "label", "reading"]
    line = '{"table":%s,"columns":%s,"rows":[%s]}' % (table, json.dumps(columns), json.dumps(row))
    assert json.loads(shown(records([line]))[0][2]) == dict(zip(columns, row))


def test_envelope_shape_errors(records):
    got = shown(
        records(
            [
                '{"columns":["id","n"],"rows":[[1,null],[2],5]}',
                '{"columns":["id",2],"rows":[[1,null]]}',
                '{"columns":["id"],"rows":[]}',
                '{"columns":["id"],"rows":3}',
                '{"columns":["a","a"],"rows":[[1,2]]}',
            ]
        )
    )
    assert got == [
        (1, 0, '{"id":1,"n":null}', None),
        (1, 1, None, "line 1: rows[1] has 1 values for 2 columns"),
        (1, 2, None, "line 1: rows[2] must be an array"),
        (2, 0, None, "line 2: columns must be an array of strings"),
        (4, 0, '{"columns":["id"],"rows":3}', None),
        (5, 0, '{"a":2}', None),
    ]


def test_either_key_makes_an_envelope_when_asked(records):
    got = shown(records(['{"columns":["id"],"rows":3}', '{"rows":[[1]]}', '{"a":1}'], detect="either"))
    assert [e for *_, e in got] == ["line 1: rows must be an array", "line 2: columns must be an array of strings", None]


def test_row_envelope(lines):
    parsed = rec.parse_lines(lines(['{"table":"public.users","columns":["id","name"],"values":[1,"alice"]}', "not json", '{"values":[1]}']))
    got = shown(rec.expand_row_envelopes(parsed, ["id", "name"]))
    assert got[0][2] == '{"id":1,"name":"alice"}'
    assert got[1][3] == "line 2 is not a JSON object"
    assert got[2][3] == "line 3: 1 values for 2 columns"


def test_hits(records):
    r = rec.unwrap_hits(records(['{"_id":"1","_routing":"","_source":{"n":"a"}}', '{"_id":"2","_index":"i","x":1}', '{"_source":3}', '{"_id":7,"_source":{}}']))
    rows = r.select("_id", "_routing", F.to_json("rec").alias("rec"), "error").orderBy("line_no").collect()
    assert [(x._id, x._routing, x.rec) for x in rows] == [("1", None, '{"n":"a"}'), ("2", None, '{"x":1}'), (None, None, None), (None, None, "{}")]
    assert rows[2].error == "line 3: _source must be a JSON object"


def test_graph_lines(records):
    r = records(['{"_id":7,"_labels":["User"],"properties":{"name":"Alice"}}', '{"_id":1,"_type":"KNOWS","_src":7,"_dst":8,"properties":{"role":"first"}}'])
    node = rec.graph_nodes(r).collect()[0]
    assert (node._id, node._labels) == ("7", ["User"])
    edge = rec.graph_edges(r).collect()[0]
    assert (edge._id, edge._type, edge._src, edge._dst) == ("1", "KNOWS", "7", "8")


def test_interrupted_file_is_cut_at_its_first_broken_line(spark, lines):
    a = lines(['{"a":1}', "", '{"a":2}', '{"a":', '{"a":3}'], "a")
    b = lines(['{"a":1}', '{"a":2}'], "b")
    got = rec.recover_complete_lines(a.union(b)).select("file", "line_no").orderBy("file", "line_no").collect()
    assert [tuple(r) for r in got] == [("a", 1), ("a", 3), ("b", 1), ("b", 2)]


@pytest.mark.parametrize("split", ["128MB", "64"])
def test_line_numbers_are_exact_for_any_split(spark, tmp_path, split):
    texts = {f"p{i}.jsonl": [f'{{"f":{i},"n":{n}}}' if n % 7 else "" for n in range(50 + 31 * i)] for i in range(4)}
    for name, body in texts.items():
        (tmp_path / name).write_text("\n".join(body) + ("" if name == "p2.jsonl" else "\n"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        rows = read_lines(spark, str(tmp_path)).collect()
        positions = read_lines(spark, str(tmp_path), "position").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    got = {}
    for r in rows:
        got.setdefault(r.file.rsplit("/", 1)[1], {})[r.line_no] = r.value
    assert got == {f: {i + 1: t for i, t in enumerate(b)} for f, b in texts.items()}
    # The free position sorts the lines of a file in the same order.
    for f, b in texts.items():
        mine = sorted((r.line_no, r.value) for r in positions if r.file.endswith(f))
        assert [v for _, v in mine] == b and len({p for p, _ in mine}) == len(b)


def test_filter_does_not_parse_twice(records):
    good = records(['{"a":1}']).filter("error IS NULL")
    plan = good._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


def test_round_trips(spark, lines):
    df = spark.createDataFrame([(i, f"n{i}" if i % 3 else None, i / 4) for i in range(25)], "id bigint, name string, score double")

    def back(text_lines):
        parsed = rec.records_of(text_lines.select(F.lit("f").alias("file"), F.lit(1).cast("bigint").alias("line_no"), "value"))
        get = lambda n, t: F.try_variant_get(F.try_element_at("rec", F.lit(n)), "$", t).alias(n)
        return sorted(map(tuple, parsed.select(get("id", "bigint"), get("name", "string"), get("score", "double")).collect()))

    want = sorted(map(tuple, df.collect()))
    assert back(out.record_lines(df)) == want
    batches = out.envelope_lines(df, ["id"], 10, "t", "app")
    assert batches.count() == 3 and back(batches) == want
    hits = out.hit_lines(df, F.struct("*"), F.col("id").cast("string"))
    assert rec.unwrap_hits(rec.records_of(hits.select(F.lit("f").alias("file"), F.lit(1).cast("bigint").alias("line_no"), "value"))).count() == 25


def test_envelope_text_and_batches(spark):
    df = spark.createDataFrame([(3, "[]", None), (1, '["a","b"]', '{"k":"v"}'), (2, '["c"]', '{"n":1}')], "id int, tags string, payload string")
    got = [r.value for r in out.envelope_lines(df, ["id"], 2, "users", "default", "hive").orderBy("batch_no").collect()]
    head = '{"table":{"database":"default","name":"users"},"columns":["id","tags","payload"],"rows":'
    assert got == [head + r'[[1,"[\"a\",\"b\"]","{\"k\":\"v\"}"],[2,"[\"c\"]","{\"n\":1}"]]}', head + '[[3,"[]",null]]}']


def test_csv_table_is_text_and_tolerates_ragged_rows(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id,name,x\n1,Alice,a\n2,Bob\n3,Carol,c,extra\n")
    rows = read_csv_table(spark, str(tmp_path / "t.csv")).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [("1", "Alice", "a"), ("2", "Bob", None), ("3", "Carol", "c")]


def test_slices_are_disjoint_and_bounded(spark):
    df = sliced_scan(spark.range(1000), 7, "id")
    assert df.select("slice").distinct().count() == 7 and df.count() == 1000
    with pytest.raises(ValueError):
        sliced_scan(spark.range(3), 33, "id")


def test_jdbc_options_for_partitioned_reads():
    o = jdbc_options("jdbc:x", "app.t", "id", (0, 100), 8)
    assert (o["partitionColumn"], o["lowerBound"], o["upperBound"], o["numPartitions"]) == ("id", "0", "100", "8")
    with pytest.raises(ValueError):
        jdbc_options("jdbc:x", "t", partitions=4)


def test_scan_many_totals(spark):
    got = {r.table_name: (r.rows, r.bytes) for r in scan_many({"a": spark.range(2), "b": spark.range(0)}).collect()}
    assert got == {"a": (2, 18), "b": (0, 0), "*total*": (2, 18)}


def test_bulk_lines_and_outcome(spark):
    df = spark.createDataFrame([("1", None, 5), (None, "r", 6)], "id string, r string, v int")
    got = [r.value for r in out.bulk_lines(df, "ix", F.struct("v"), "skip", F.col("id"), F.col("r")).collect()]
    assert got == ['{"create":{"_index":"ix","_id":"1"}}\n{"v":5}', '{"create":{"_index":"ix","routing":"r"}}\n{"v":6}']
    responses = spark.createDataFrame(
        [(1, '{"items":[{"create":{"status":201}},{"create":{"status":409,"error":{"type":"x","reason":"exists"}}}]}'),
         (2, '{"items":[{"create":{"status":400,"error":{"type":"mapper"}}}]}')], "seq int, value string")
    items = out.bulk_items(responses)
    row = out.bulk_outcome(items, "create").collect()[0]
    assert tuple(row) == (3, 1, 1, 1, "mapper")
    assert out.bulk_outcome(items, "index").collect()[0].failed == 2


@pytest.mark.parametrize("text,good", [
    ('{"a":1}\t', True), ('{"a":1}\r', True), ('{"a":1} ', True), ("{}", True), ('{"a":{"b":[1,2]}}', True),
    ('{"a":1}],[{"b":2}', False), ('{"a":1},{"b":2}', False), ('{"a":1},{}],[{}', False), ('{"a":1}}', False),
    ("{'a':1}", False), ('{"a":NaN}', False), ('{"a":Infinity}', False), ("[]", False), ('"x"', False), ('{"a":1', False),
])
def test_lines_are_strict_json(records, text, good):
    row = records([text]).collect()[0]
    assert (row.error is None) == good


def test_csv_quotes_breaks_and_empty_text(spark, tmp_path):
    from recordloom.sources.tables import read_csv_table

    path = tmp_path / "t.csv"
    path.write_text('a,b,c\n"say ""hi"" now",,""\n"two\nlines",x,y\n')
    got = [tuple(r) for r in read_csv_table(spark, str(path), line_breaks=True).collect()]
    assert got == [('say "hi" now', None, ""), ("two\nlines", "x", "y")]


def test_project_document_flags_missing_keys(records):
    from recordloom.operators.project import project_document

    rows = project_document(records(['{"a":1,"b":2}', '{"a":1}', '{"a":null,"b":null}']), ["b", "a"]).collect()
    assert [r.error is None for r in rows] == [True, False, True] and "b" in rows[1].error


def test_samples_refuse_what_they_cannot_take(records):
    from recordloom.operators.infer import MAX_SAMPLE, sample_records

    rows = records([f'{{"a":{i}}}' for i in range(5)])
    assert sample_records(rows, None).count() == 5 and sample_records(rows, 2).count() == 2
    with pytest.raises(ValueError):
        sample_records(rows, MAX_SAMPLE + 1)
