"""Queries: reading, filtering and projecting records."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from recordloom.operators import filters, project
from recordloom.plans.registry import get, lines_of, query, table
from recordloom.session import scratch
from recordloom.sinks.lines import envelope_lines, hit_lines, record_lines, row_envelope_lines, write_lines
from recordloom.sources import records as rec
from recordloom.sources import tables as src

ISO = "'%Y-%m-%dT%H:%M:%S.%g'"


@query("read_records", f"""
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
       strftime(o_orderdate, {ISO}) AS o_orderdate, 0 AS row_idx
FROM orders""")
def read_records(spark, sf):
    path = scratch(spark, "orders-lines")
    write_lines(record_lines(table(spark, sf, "orders")), path)
    return rec.read_records(spark, path).filter("error IS NULL").select(
        get("o_orderkey", "bigint").alias("o_orderkey"),
        get("o_custkey", "bigint").alias("o_custkey"),
        get("o_orderstatus", "string").alias("o_orderstatus"),
        get("o_totalprice", "double").alias("o_totalprice"),
        get("o_orderdate", "string").alias("o_orderdate"),
        "row_idx",
    )


@query("expand_envelopes", """
WITH p AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS n FROM orders)
SELECT n // 100 + 1 AS line_no, CAST(n % 100 AS INTEGER) AS row_idx,
       o_orderkey, o_custkey, o_orderpriority, o_totalprice FROM p""")
def expand_envelopes(spark, sf):
    lines = envelope_lines(table(spark, sf, "orders"), ["o_orderkey"], 100, "orders", "app")
    return rec.records_of(lines_of(lines, F.col("batch_no") + 1, F.col("value"))).select(
        "line_no", "row_idx",
        get("o_orderkey", "bigint").alias("o_orderkey"),
        get("o_custkey", "bigint").alias("o_custkey"),
        get("o_orderpriority", "string").alias("o_orderpriority"),
        get("o_totalprice", "double").alias("o_totalprice"),
    )


@query("expand_row_envelope", """
SELECT p_partkey, p_name, p_brand, p_size, p_retailprice FROM part""")
def expand_row_envelope(spark, sf):
    parts = table(spark, sf, "part")
    lines = row_envelope_lines(parts, "public.part").select(F.lit(1).alias("n"), "value")
    parsed = rec.parse_lines(lines_of(lines, "n", F.col("value")))
    return rec.expand_row_envelopes(parsed, parts.columns).filter("error IS NULL").select(
        get("p_partkey", "bigint").alias("p_partkey"),
        get("p_name", "string").alias("p_name"),
        get("p_brand", "string").alias("p_brand"),
        get("p_size", "int").alias("p_size"),
        get("p_retailprice", "double").alias("p_retailprice"),
    )


def customer_hits(spark, sf):
    """Wrapped hits for most customers, flat documents for one market segment."""
    c = table(spark, sf, "customer").withColumn("line_no", F.col("c_custkey") + 1)
    c = c.withColumn("id", F.col("c_custkey").cast("string"))
    c = c.withColumn("routing", F.when(F.col("c_acctbal") < 0, F.lit("")).otherwise(F.concat(F.lit("n"), "c_nationkey")))
    body = F.struct("c_name", "c_acctbal")
    wrapped = F.to_json(F.struct(F.col("id").alias("_id"), F.col("routing").alias("_routing"), body.alias("_source")))
    flat = F.to_json(F.struct(F.col("id").alias("_id"), F.lit("i").alias("_index"), "c_name", "c_acctbal"))
    return lines_of(c, "line_no", F.when(F.col("c_mktsegment") == "BUILDING", flat).otherwise(wrapped))


@query("unwrap_hits", """
SELECT c_custkey + 1 AS line_no, CAST(c_custkey AS VARCHAR) AS _id,
       CASE WHEN c_mktsegment = 'BUILDING' OR c_acctbal < 0 THEN NULL ELSE 'n' || c_nationkey END AS _routing,
       -- keys inside a nested document are kept in sorted order
       CASE WHEN c_mktsegment = 'BUILDING' THEN 'c_name,c_acctbal' ELSE 'c_acctbal,c_name' END AS keys,
       c_name, c_acctbal FROM customer""")
def unwrap_hits(spark, sf):
    return rec.unwrap_hits(rec.records_of(customer_hits(spark, sf))).select(
        "line_no", "_id", "_routing", F.array_join(F.map_keys("rec"), ",").alias("keys"),
        get("c_name", "string").alias("c_name"), get("c_acctbal", "double").alias("c_acctbal"),
    )


def node_lines(spark, sf):
    c = table(spark, sf, "customer")
    value = F.to_json(F.struct(
        F.col("c_custkey").alias("_id"), F.array(F.lit("Customer"), F.col("c_mktsegment")).alias("_labels"),
        F.struct(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")).alias("properties"),
    ))
    return lines_of(c, F.col("c_custkey") + 1, value)


def edge_lines(spark, sf):
    o = table(spark, sf, "orders")
    value = F.to_json(F.struct(
        F.col("o_orderkey").alias("_id"), F.concat(F.lit("PLACED_"), "o_orderstatus").alias("_type"),
        F.col("o_custkey").alias("_src"), F.col("o_orderkey").alias("_dst"),
        F.struct(F.col("o_totalprice").alias("total")).alias("properties"),
    ))
    return lines_of(o, F.col("o_orderkey") + 1, value)


@query("graph_nodes", """
SELECT CAST(c_custkey AS VARCHAR) AS _id, 'Customer,' || c_mktsegment AS labels,
       c_name AS name, c_acctbal AS balance FROM customer""")
def graph_nodes(spark, sf):
    nodes = rec.graph_nodes(rec.records_of(node_lines(spark, sf)))
    return nodes.select(
        "_id", F.array_join("_labels", ",").alias("labels"),
        get("name", "string", "properties").alias("name"), get("balance", "double", "properties").alias("balance"),
    )


@query("graph_edges", """
SELECT CAST(o_orderkey AS VARCHAR) AS _id, 'PLACED_' || o_orderstatus AS _type,
       CAST(o_custkey AS VARCHAR) AS _src, CAST(o_orderkey AS VARCHAR) AS _dst, o_totalprice AS total FROM orders""")
def graph_edges(spark, sf):
    edges = rec.graph_edges(rec.records_of(edge_lines(spark, sf)))
    return edges.select("_id", "_type", "_src", "_dst", get("total", "double", "properties").alias("total"))


@query("read_csv_table", """
SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_type, CAST(p_size AS VARCHAR) AS p_size,
       CAST(p_retailprice AS VARCHAR) AS p_retailprice FROM part""")
def read_csv_table(spark, sf):
    path = scratch(spark, "part-csv")
    table(spark, sf, "part").write.option("header", True).csv(path)
    return src.read_csv_table(spark, path).select("p_partkey", "p_name", "p_type", "p_size", "p_retailprice")


@query("read_csv_quoted", """
SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, '' AS note, CASE WHEN doc_id % 3 <> 0 THEN '"' || source || '", said' END AS quoted
FROM documents""")
def read_csv_quoted(spark, sf):
    """Whole texts with line breaks, doubled quotes, empty text and NULL."""
    path = scratch(spark, "documents-csv")
    d = table(spark, sf, "documents")
    quoted = F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit('"'), "source", F.lit('", said')))
    rows = d.select("doc_id", "text", F.lit("").alias("note"), quoted.alias("quoted"))
    rows.write.option("header", True).option("escape", '"').option("emptyValue", '""').option("nullValue", "").option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return src.read_csv_table(spark, path, line_breaks=True).select("doc_id", "text", "note", "quoted")


@query("read_records_strict", """
SELECT event_id AS line_no, CASE WHEN event_id % 6 IN (0, 5) THEN event_id END AS a, event_id % 6 NOT IN (0, 5) AS refused FROM events""")
def read_records_strict(spark, sf):
    """White space of JSON behind a record is fine; brackets, single quotes, NaN and a second value are not."""
    e = table(spark, sf, "events")
    number = F.col("event_id").cast("string")
    case = F.col("event_id") % 6
    text = (
        F.when(case == 0, F.concat(F.lit('{"a":'), number, F.lit("}\t\r")))
        .when(case == 1, F.concat(F.lit('{"a":'), number, F.lit('}],[{"b":1}')))
        .when(case == 2, F.concat(F.lit("{'a':"), number, F.lit("}")))
        .when(case == 3, F.lit('{"a":NaN}'))
        .when(case == 4, F.concat(F.lit('{"a":'), number, F.lit('},{"a":1}')))
        .otherwise(F.concat(F.lit('{"a":'), number, F.lit("}")))
    )
    rows = rec.records_of(lines_of(e, "event_id", text))
    return rows.select("line_no", get("a", "bigint").alias("a"), F.col("error").isNotNull().alias("refused"))


@query("project_missing", """
SELECT o_orderkey AS line_no, o_orderkey % 2 = 1 AS refused FROM orders""")
def project_missing(spark, sf):
    """A document without a selected key is refused; one whose key is null is not."""
    o = table(spark, sf, "orders")
    number = F.col("o_orderkey").cast("string")
    text = F.when(F.col("o_orderkey") % 2 == 1, F.concat(F.lit('{"a":'), number, F.lit("}"))).otherwise(
        F.concat(F.lit('{"a":'), number, F.lit(',"b":null}')))
    rows = project.project_document(rec.records_of(lines_of(o, "o_orderkey", text)), ["b", "a"])
    return rows.select("line_no", F.col("error").isNotNull().alias("refused"))


@query("scan_table", """
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem
WHERE l_returnflag = 'R' AND l_quantity >= 25""")
def scan_table(spark, sf):
    return src.scan_table(
        spark, f"{sf}/lineitem.parquet", where="l_returnflag = 'R' AND l_quantity >= 25",
        columns=["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"],
    )


@query("scan_metastore", """
SELECT CAST(event_id AS VARCHAR) AS event_id, event_type, value,
       '["' || event_type || '",null]' AS tags, '{"user":' || user_id || ',"note":null}' AS detail
FROM events WHERE value > 5""")
def scan_metastore(spark, sf):
    e = table(spark, sf, "events").select(
        "event_id", "event_type", "value", F.array("event_type", F.lit(None)).alias("tags"),
        F.struct(F.col("user_id").alias("user"), F.lit(None).cast("string").alias("note")).alias("detail"),
    )
    e.createOrReplaceTempView("recordloom_scan_source")
    return src.scan_metastore_table(spark, "recordloom_scan_source", where="value > 5")


@query("sliced_scan", """
SELECT CAST(o_orderkey % 8 AS INTEGER) AS slice, count(*) AS n, min(o_orderkey) AS first_key,
       max(o_orderkey) AS last_key FROM orders GROUP BY 1""")
def sliced_scan(spark, sf):
    sliced = src.sliced_scan(
        table(spark, sf, "orders"), 8, "o_orderkey", F.pmod("o_orderkey", F.lit(8)).cast("int")
    )
    return sliced.groupBy("slice").agg(
        F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key")
    )


@query("scan_many", """
WITH t AS (
  SELECT 'nation' AS table_name, strlen(CAST(to_json(nation) AS VARCHAR)) + 1 AS b FROM nation
  UNION ALL SELECT 'documents', strlen(CAST(to_json(documents) AS VARCHAR)) + 1 FROM documents
  UNION ALL SELECT 'conversations', strlen(CAST(to_json(conversations) AS VARCHAR)) + 1 FROM conversations)
SELECT table_name, count(*) AS rows, CAST(sum(b) AS BIGINT) AS bytes FROM t GROUP BY 1
UNION ALL SELECT '*total*', count(*), CAST(sum(b) AS BIGINT) FROM t""")
def scan_many(spark, sf):
    return src.scan_many({n: table(spark, sf, n) for n in ("nation", "documents", "conversations")})


@query("recover_complete_lines", """
WITH b AS (SELECT event_type, min(event_id) AS m FROM events WHERE value > 200 GROUP BY 1)
SELECT e.event_type AS file, e.event_id AS line_no FROM events e LEFT JOIN b USING (event_type)
WHERE b.m IS NULL OR e.event_id < b.m""")
def recover_complete_lines(spark, sf):
    e = table(spark, sf, "events")
    whole = F.to_json(F.struct("event_id", "user_id", "value"))
    cut = F.when(F.col("value") > 200, F.substr(whole, F.lit(1), F.length(whole) - 3)).otherwise(whole)
    return rec.recover_complete_lines(lines_of(e, "event_id", cut, F.col("event_type"))).select("file", "line_no")


@query("where_fragment", """
SELECT l_orderkey, l_linenumber, l_discount FROM lineitem
WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24 AND l_shipdate >= TIMESTAMP '1996-01-01'""")
def where_fragment(spark, sf):
    df = filters.where(
        table(spark, sf, "lineitem"),
        "l_discount BETWEEN 0.05D AND 0.07D AND l_quantity < 24 AND l_shipdate >= TIMESTAMP_NTZ '1996-01-01'",
    )
    return df.select("l_orderkey", "l_linenumber", "l_discount")


@query("filter_dsl", """
SELECT event_id, event_type, value FROM events
WHERE (event_type IN ('click', 'purchase') AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-25'
  AND NOT (event_type LIKE 'purch%' AND value < 10) AND (value > 3 OR user_id = 7))
  OR event_type LIKE 's_gn%'""")
def filter_dsl(spark, sf):
    query_object = {"bool": {"should": [
        {"bool": {
            "filter": [
                {"terms": {"event_type": ["click", "purchase"]}},
                {"range": {"ts": {"gte": "now-20d/d", "lt": "now/d"}}},
            ],
            "must_not": [{"bool": {"must": [{"prefix": {"event_type": "purch"}}, {"range": {"value": {"lt": 10}}}]}}],
            "should": [{"range": {"value": {"gt": 3}}}, {"term": {"user_id": 7}}],
            "minimum_should_match": 1,
        }},
        {"wildcard": {"event_type": "s?gn*"}},
    ]}}
    now = datetime(2024, 1, 25, 12, tzinfo=timezone.utc)
    events = table(spark, sf, "events")
    return filters.filter_dsl(events, query_object, "event_id", now).select("event_id", "event_type", "value")


@query("filter_dsl_text_dates", """
SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-25' AND event_type <> 'view'
  AND (value > 5 OR user_id % 10 > 7) AND NOT (event_type = 'click' AND value < 1)""")
def filter_dsl_text_dates(spark, sf):
    query_object = {"bool": {
        "filter": [{"range": {"doc.at": {"gte": "now-20d/d", "lt": "now/d"}}}, {"range": {"doc.hits.n": {"gt": 5}}}],
        "must_not": [{"bool": {"must": [{"term": {"doc.kind": "click"}}, {"range": {"doc.value": {"lt": 1}}}]}}],
    }}
    now = datetime(2024, 1, 25, 12, tzinfo=timezone.utc)
    e = table(spark, sf, "events")
    # Dates are texts; those of views are none.
    at = F.when(F.col("event_type") == "view", "some day").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    hits = F.array(F.struct(F.col("value").alias("n")), F.struct((F.col("user_id") % 10 - 2).cast("double").alias("n")))
    docs = e.select("event_id", F.struct(at.alias("at"), F.col("event_type").alias("kind"), "value", hits.alias("hits")).alias("doc"))
    return filters.filter_dsl(docs, query_object, "event_id", now).select("event_id")


@query("graph_bad_lines", """
SELECT o_orderkey + 1 AS line_no, CASE o_orderstatus WHEN 'F' THEN CAST(o_orderkey AS VARCHAR) END AS _id,
  CASE WHEN o_orderstatus = 'F' THEN NULL WHEN o_orderpriority = '5-LOW' THEN 'line ' || (o_orderkey + 1) || ' is not a JSON object'
    ELSE 'line ' || (o_orderkey + 1) || ' is neither a node nor a relationship' END AS error
FROM orders WHERE o_orderstatus <> 'O'""")
def graph_bad_lines(spark, sf):
    """Nodes among relationships (left to their own reader), lines of neither kind, and lines that are cut off."""
    o = table(spark, sf, "orders")
    node = F.to_json(F.struct(F.col("o_orderkey").alias("_id"), F.array(F.lit("Order")).alias("_labels")))
    edge = F.to_json(F.struct(F.col("o_orderkey").alias("_id"), F.lit("P").alias("_type"), F.lit(1).alias("_src"), F.lit(2).alias("_dst")))
    other = F.when(F.col("o_orderpriority") == "5-LOW", F.lit('{"_id":')).otherwise(F.lit('{"_id":1,"_type":"P"}'))
    value = F.when(F.col("o_orderstatus") == "F", node).when(F.col("o_orderstatus") == "O", edge).otherwise(other)
    nodes = rec.graph_nodes(rec.records_of(lines_of(o, F.col("o_orderkey") + 1, value)))
    return nodes.select("line_no", "_id", "error")


@query("graph_where", """
SELECT CAST(c_custkey AS VARCHAR) AS _id, c_acctbal AS balance FROM customer
WHERE c_mktsegment = 'MACHINERY' AND c_acctbal > 1000""")
def graph_where(spark, sf):
    nodes = rec.graph_nodes(rec.records_of(node_lines(spark, sf))).select(
        "_id", "_labels", get("balance", "double", "properties").alias("balance")
    )
    return filters.graph_where(nodes, "node", "MACHINERY", "balance > 1000").select("_id", "balance")


@query("search_names", """
SELECT p_partkey, p_brand, p_name FROM part WHERE contains(lower(p_brand || '.' || p_name), 'brand#1')
  AND contains(lower(p_brand || '.' || p_name), 'red')""")
def search_names(spark, sf):
    found = filters.search_names(table(spark, sf, "part"), " RED ", "p_brand", "p_name")
    return filters.search_names(found, "brand#1", "p_brand", "p_name").select("p_partkey", "p_brand", "p_name")


@query("project_source_order", """
SELECT c_custkey, 'c_custkey,c_name' AS keys, c_name FROM customer""")
def project_source_order(spark, sf):
    records = rec.records_of(lines_of(table(spark, sf, "customer"), F.col("c_custkey") + 1))
    return project.project(records, ["c_name", "c_custkey"]).select(
        get("c_custkey", "bigint").alias("c_custkey"), F.array_join(F.map_keys("rec"), ",").alias("keys"),
        get("c_name", "string").alias("c_name"),
    )


@query("project_request_order", """
SELECT c_custkey, 'c_name,c_custkey' AS keys, c_name FROM customer""")
def project_request_order(spark, sf):
    records = rec.records_of(lines_of(table(spark, sf, "customer"), F.col("c_custkey") + 1))
    return project.project_document(records, ["c_name", "c_custkey"]).select(
        get("c_custkey", "bigint").alias("c_custkey"), F.array_join(F.map_keys("rec"), ",").alias("keys"),
        get("c_name", "string").alias("c_name"),
    )


def ragged_events(spark, sf):
    """Event records whose keys depend on the event type."""
    e = table(spark, sf, "events")
    text = F.to_json(F.struct(
        "event_id",
        F.when(F.col("event_type") != "error", F.col("value")).alias("value"),
        F.when(F.col("event_type") == "purchase", F.col("user_id")).alias("buyer"),
        F.when(F.col("event_type") == "signup", F.col("props")).alias("props"),
    ))
    return lines_of(e, F.col("event_id") + 1, text)


@query("require_columns", """
SELECT event_id + 1 AS line_no,
  'line ' || (event_id + 1) || ' lacks selected columns: '
  || CASE WHEN event_type = 'error' THEN 'value, buyer' ELSE 'buyer' END AS error
FROM events WHERE event_type <> 'purchase'""")
def require_columns(spark, sf):
    checked = project.require_columns(rec.records_of(ragged_events(spark, sf)), ["event_id", "value", "buyer"])
    return checked.filter("error IS NOT NULL").select("line_no", "error")


@query("rename_skip", """
SELECT c_custkey AS id, 'id,c_nationkey,balance,c_mktsegment' AS keys, c_acctbal AS balance FROM customer""")
def rename_skip(spark, sf):
    records = rec.records_of(lines_of(table(spark, sf, "customer"), F.col("c_custkey") + 1))
    out = project.rename_skip(records, {"c_custkey": "id", "c_acctbal": "balance"}, ["c_name"])
    return out.select(
        get("id", "bigint").alias("id"), F.array_join(F.map_keys("rec"), ",").alias("keys"),
        get("balance", "double").alias("balance"),
    )


@query("writable_columns", """
SELECT s_suppkey, s_name, s_acctbal FROM supplier""")
def writable_columns(spark, sf):
    suppliers = table(spark, sf, "supplier")
    meta = spark.createDataFrame(
        [(c, c == "s_nationkey", False) for c in suppliers.columns], "name string, generated boolean, hidden boolean"
    )
    return project.select_writable(suppliers, meta)


@query("first_record_columns", """
WITH f AS (SELECT event_type FROM events ORDER BY event_id LIMIT 1),
k AS (SELECT 'event_id' AS name, 0 AS p UNION ALL SELECT 'value', 1 FROM f WHERE event_type <> 'error'
  UNION ALL SELECT 'buyer', 2 FROM f WHERE event_type = 'purchase'
  UNION ALL SELECT 'props', 3 FROM f WHERE event_type = 'signup')
SELECT CAST(row_number() OVER (ORDER BY p) - 1 AS INTEGER) AS pos, name FROM k""")
def first_record_columns(spark, sf):
    return project.first_record_columns(rec.records_of(ragged_events(spark, sf)))


@query("union_columns", """
WITH k AS (
  SELECT 'event_id' AS name, min(event_id) AS m, 0 AS p FROM events
  UNION ALL SELECT 'value', min(event_id), 1 FROM events WHERE event_type <> 'error'
  UNION ALL SELECT 'buyer', min(event_id), 2 FROM events WHERE event_type = 'purchase'
  UNION ALL SELECT 'props', min(event_id), 3 FROM events WHERE event_type = 'signup')
SELECT CAST(row_number() OVER (ORDER BY m, p) - 1 AS INTEGER) AS ordinal, name FROM k""")
def union_columns(spark, sf):
    return project.union_columns(rec.records_of(ragged_events(spark, sf)))


@query("write_records", """
SELECT c_custkey, to_json({'c_custkey': c_custkey, 'c_name': c_name, 'note': NULL, 'c_acctbal': c_acctbal}) AS value
FROM customer""")
def write_records(spark, sf):
    path = scratch(spark, "customer-lines")
    c = table(spark, sf, "customer").select("c_custkey", "c_name", F.lit(None).cast("string").alias("note"), "c_acctbal")
    write_lines(record_lines(c), path)
    back = spark.read.text(path)
    return back.select(
        F.get_json_object("value", "$.c_custkey").cast("bigint").alias("c_custkey"), "value"
    )


@query("write_envelopes", """
WITH p AS (SELECT *, (row_number() OVER (ORDER BY event_id) - 1) // 1000 AS b FROM events)
SELECT b AS batch_no, '{"table":{"schema":"app","name":"events"},"columns":["event_id","user_id","event_type"],"rows":['
  || string_agg('[' || event_id || ',' || user_id || ',"' || event_type || '"]', ',' ORDER BY event_id) || ']}' AS value
FROM p GROUP BY b""")
def write_envelopes(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    return envelope_lines(e, ["event_id"], 1000, "events", "app")


@query("write_row_envelopes", """
SELECT n_nationkey, '{"table":"public.nation","columns":["n_nationkey","n_name","n_regionkey"],"values":['
  || n_nationkey || ',"' || n_name || '",' || n_regionkey || ']}' AS value FROM nation
UNION ALL SELECT c_custkey, '{"table":"public.nation","columns":["n_nationkey","n_name","n_regionkey"],"values":['
  || c_custkey || ',"' || c_name || '",' || c_nationkey || ']}' FROM customer""")
def write_row_envelopes(spark, sf):
    names = ["n_nationkey", "n_name", "n_regionkey"]
    both = table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("n_nationkey"), "n_name", "n_regionkey")
    both = both.union(table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey"))
    lines = row_envelope_lines(both.toDF(*names), "public.nation")
    return lines.select(F.get_json_object("value", "$.values[0]").cast("bigint").alias("n_nationkey"), "value")


@query("write_hits", """
SELECT '{"_source":{"s_name":"' || s_name || '","s_nationkey":' || s_nationkey || '},"_id":"' || s_suppkey || '"'
  || CASE WHEN s_acctbal < 0 THEN '' ELSE ',"_routing":"n' || s_nationkey || '"' END || '}' AS value FROM supplier""")
def write_hits(spark, sf):
    s = table(spark, sf, "supplier")
    routing = F.when(F.col("s_acctbal") < 0, F.lit("")).otherwise(F.concat(F.lit("n"), "s_nationkey"))
    return hit_lines(s, F.struct("s_name", "s_nationkey"), F.col("s_suppkey").cast("string"), routing)


@query("record_round_trip", """
SELECT o_orderstatus, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY 1""")
def record_round_trip(spark, sf):
    """Records written as lines and read back, reduced per status."""
    path = scratch(spark, "round-trip")
    write_lines(record_lines(table(spark, sf, "orders")), path)
    back = rec.read_records(spark, path, "position")
    return back.groupBy(get("o_orderstatus", "string").alias("o_orderstatus")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(get("o_orderkey", "bigint")).alias("keys")
    )
