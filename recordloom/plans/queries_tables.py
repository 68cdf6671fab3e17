"""Queries: sinks, conflict policies, incremental transfer, streaming, catalog."""

from __future__ import annotations

import os

from pyspark import TaskContext
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from recordloom.functions.convert import spark_type
from recordloom.operators import catalog, conflicts, incremental, targets
from recordloom.plans.import_plan import ImportSpec, convert_records, run_import
from recordloom.plans.queries_records import edge_lines, node_lines
from recordloom.plans.queries_values import ORDER_TARGETS, damaged_orders
from recordloom.plans.registry import lines_of, query, table
from recordloom.session import cut_lineage, scratch
from recordloom.sinks import lines as out
from recordloom.sinks import tables as sink
from recordloom.sinks.keyed import KeyedTable
from recordloom.sources import records as rec
from recordloom.sources import tables as src
from recordloom.sources.lines import read_lines
from recordloom.streaming import flows


@query("bulk_actions", """
SELECT '{"create":{"_index":"orders","_id":"' || o_orderkey || '"'
 || CASE WHEN o_orderstatus = 'P' THEN '' ELSE ',"routing":"' || o_orderstatus || '"' END || '}}' || chr(10)
 || '{"o_custkey":' || o_custkey || ',"o_orderpriority":"' || o_orderpriority || '"}' AS value FROM orders""")
def bulk_actions(spark, sf):
    o = table(spark, sf, "orders")
    routing = F.when(F.col("o_orderstatus") == "P", F.lit("")).otherwise(F.col("o_orderstatus"))
    return out.bulk_lines(
        o, "orders", F.struct("o_custkey", "o_orderpriority"), "skip", F.col("o_orderkey").cast("string"), routing
    )


@query("bulk_outcome", """
SELECT count(*) AS items, count(*) FILTER (event_type NOT IN ('error', 'click')) AS written,
  count(*) FILTER (event_type = 'error') AS skipped, count(*) FILTER (event_type = 'click') AS failed,
  'mapper ' || min(event_id) FILTER (event_type = 'click') AS first_reason FROM events""")
def bulk_outcome(spark, sf):
    e = table(spark, sf, "events")
    status = F.when(F.col("event_type") == "error", 409).when(F.col("event_type") == "click", 400).otherwise(201)
    reason = F.when(F.col("event_type") == "error", F.lit("conflict")).when(
        F.col("event_type") == "click", F.concat(F.lit("mapper "), "event_id"))
    error = F.when(reason.isNotNull(), F.struct(F.lit("t").alias("type"), reason.alias("reason")))
    item = F.struct(F.struct(status.alias("status"), error.alias("error")).alias("create"))
    response = e.select(F.col("event_id").alias("seq"), F.to_json(F.struct(F.array(item).alias("items"))).alias("value"))
    return out.bulk_outcome(out.bulk_items(response), "create")


# Account updates: three orders share a key, the keys reach beyond the existing accounts.
def accounts(spark, sf):
    c = table(spark, sf, "customer")
    existing = c.select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"),
        F.col("c_mktsegment").alias("segment"),
    )
    o = table(spark, sf, "orders")
    incoming = o.select(
        F.floor(F.col("o_orderkey") / 3).cast("bigint").alias("id"),
        F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("name"),
        F.col("o_totalprice").alias("balance"),
        F.col("o_orderkey").alias("seq"),
    )
    return existing, incoming


INCOMING = """WITH i AS (SELECT o_orderkey // 3 AS id, 'order ' || o_orderkey AS name, o_totalprice AS balance, o_orderkey AS seq,
  row_number() OVER (PARTITION BY o_orderkey // 3 ORDER BY o_orderkey) AS a,
  row_number() OVER (PARTITION BY o_orderkey // 3 ORDER BY o_orderkey DESC) AS d FROM orders)"""


@query("conflict_error", """
SELECT o_orderkey // 3 AS id, bool_or(c_custkey IS NOT NULL) AS in_target, count(*) AS incoming
FROM orders LEFT JOIN customer ON c_custkey = o_orderkey // 3 GROUP BY 1
HAVING count(*) > 1 OR bool_or(c_custkey IS NOT NULL)""")
def conflict_error(spark, sf):
    existing, incoming = accounts(spark, sf)
    return conflicts.conflicting_keys(existing, incoming, ["id"])


@query("conflict_skip", INCOMING + """
SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer
UNION ALL SELECT id, name, balance, NULL FROM i WHERE a = 1 AND id NOT IN (SELECT c_custkey FROM customer)""")
def conflict_skip(spark, sf):
    existing, incoming = accounts(spark, sf)
    return conflicts.merge_frames(existing, incoming, ["id"], "skip", "seq")


@query("conflict_skip_append", INCOMING + """
SELECT id, name, balance FROM i WHERE a = 1 AND id NOT IN (SELECT c_custkey FROM customer)""")
def conflict_skip_append(spark, sf):
    existing, incoming = accounts(spark, sf)
    return conflicts.rows_to_append(existing, incoming, ["id"], "seq")


@query("conflict_update", INCOMING + """
SELECT coalesce(id, c_custkey) AS id, coalesce(name, c_name) AS name, coalesce(balance, c_acctbal) AS balance,
  c_mktsegment AS segment FROM (SELECT * FROM i WHERE d = 1) l FULL JOIN customer ON id = c_custkey""")
def conflict_update(spark, sf):
    existing, incoming = accounts(spark, sf)
    return conflicts.merge_frames(existing, incoming, ["id"], "update", "seq")


@query("conflict_update_absent", """
WITH i AS (SELECT o_orderkey // 3 AS id, o_orderkey AS seq, 'order ' || o_orderkey AS name,
  CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_totalprice END AS balance,
  o_orderpriority NOT IN ('1-URGENT', '5-LOW') AS has_name, o_orderstatus <> 'P' AS has_balance FROM orders),
k AS (SELECT id FROM i UNION SELECT c_custkey FROM customer),
n AS (SELECT id, arg_max(name, seq) AS name FROM i WHERE has_name GROUP BY 1),
b AS (SELECT id, max(seq) AS s FROM i WHERE has_balance GROUP BY 1)
SELECT k.id, CASE WHEN n.id IS NOT NULL THEN n.name ELSE c_name END AS name,
  CASE WHEN b.id IS NOT NULL THEN (SELECT balance FROM i WHERE i.seq = b.s) ELSE c_acctbal END AS balance, c_mktsegment AS segment
FROM k LEFT JOIN n ON n.id = k.id LEFT JOIN b ON b.id = k.id LEFT JOIN customer ON c_custkey = k.id""")
def conflict_update_absent(spark, sf):
    """Absent columns keep the stored value, null ones overwrite it."""
    existing, _ = accounts(spark, sf)
    o = table(spark, sf, "orders")
    has = F.filter(
        F.array(
            F.when(~F.col("o_orderpriority").isin("1-URGENT", "5-LOW"), F.lit("name")),
            F.when(F.col("o_orderstatus") != "P", F.lit("balance")),
        ),
        lambda x: x.isNotNull(),
    )
    incoming = o.select(
        F.floor(F.col("o_orderkey") / 3).cast("bigint").alias("id"),
        F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("name"),
        F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice")).alias("balance"),
        F.col("o_orderkey").alias("seq"), has.alias("has"),
    )
    return conflicts.merge_frames(existing, incoming, ["id"], "update", "seq", "has")


@query("conflict_update_files", """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 100 < 3 AND o_orderkey < 2000 THEN 0.0 ELSE o_totalprice END AS balance, o_orderstatus AS segment FROM orders
UNION ALL SELECT -c_custkey - 1, c_acctbal, NULL FROM customer""")
def conflict_update_files(spark, sf):
    """An update of a stored table, file by file: some orders in a range of keys, and rows with new keys."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("balance"), F.col("o_orderstatus").alias("segment"))
    stored = KeyedTable.create(spark, scratch(spark, "keyed"), o.schema, ["id"])
    stored.write(o.repartitionByRange(8, "id").withColumn("seq", F.col("id")), "error", "seq")
    change = o.filter("id % 100 < 3 AND id < 2000").select("id", F.lit(0.0).alias("balance"), F.col("id").alias("seq"))
    fresh = table(spark, sf, "customer").select((-F.col("c_custkey") - 1).alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_custkey").alias("seq"))
    stored.write(change.unionByName(fresh), "update", "seq")
    return stored.read()


@query("conflict_overwrite", INCOMING + """
SELECT id, name, balance, NULL::VARCHAR AS segment FROM i WHERE d = 1
UNION ALL SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT id FROM i)""")
def conflict_overwrite(spark, sf):
    existing, incoming = accounts(spark, sf)
    return conflicts.merge_frames(existing, incoming, ["id"], "overwrite", "seq")


@query("import_orders", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderpriority FROM orders
WHERE o_orderstatus = 'F' OR o_orderpriority NOT IN ('1-URGENT', '5-LOW')""")
def import_orders(spark, sf):
    """The whole import: envelopes, expansion, conversion, dead letters, conflict skip."""
    o = table(spark, sf, "orders")
    urgent, low = F.col("o_orderpriority") == "1-URGENT", F.col("o_orderpriority") == "5-LOW"
    shown = o.select(
        "o_orderkey", "o_custkey", "o_orderstatus",
        F.when(urgent, F.lit("unknown")).otherwise(F.col("o_totalprice").cast("string")).alias("o_totalprice"),
        F.when(low, F.lit("soon")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("o_orderdate"),
        "o_orderpriority",
    )
    envelopes = out.envelope_lines(shown, ["o_orderkey"], 500, "orders", "app")
    records = rec.records_of(lines_of(envelopes, F.col("batch_no") + 1, F.col("value")))
    good, _ = run_import(records, ImportSpec(ORDER_TARGETS))
    incoming = good.select(*ORDER_TARGETS, (F.col("line_no") * 10_000 + F.col("row_idx")).alias("seq"))
    existing = o.filter("o_orderstatus = 'F'").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    merged = conflicts.merge_frames(existing, incoming, ["o_orderkey"], "skip", "seq")
    day = F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")
    return merged.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", day, "o_orderpriority")


def _table_at(spark, label: str, columns: list[tuple[str, str]]) -> tuple[str, bool, bool]:
    """A new table with its data in the shared folder; created once, then found."""
    path = scratch(spark, label)
    name = "rl_" + path.rsplit("-", 1)[1]
    ddl = targets.spark_table_ddl(columns, name, "parquet", path)
    return name, targets.create_if_missing(spark, name, ddl), targets.create_if_missing(spark, name, None)


@query("create_if_missing", """
SELECT true AS created_first, false AS created_again, count(*) AS rows, CAST(sum(o_custkey) AS BIGINT) AS keys FROM orders""")
def create_if_missing(spark, sf):
    name, first, again = _table_at(spark, "created", [("o_orderkey", "bigint"), ("o_custkey", "bigint")])
    table(spark, sf, "orders").select("o_orderkey", "o_custkey").write.insertInto(name)
    stats = spark.table(name).agg(F.count(F.lit(1)).alias("rows"), F.sum("o_custkey").alias("keys"))
    return stats.select(F.lit(first).alias("created_first"), F.lit(again).alias("created_again"), "rows", "keys")


@query("metastore_append", """
SELECT o_orderkey AS id, o_orderpriority AS note, NULL::DOUBLE AS price FROM orders
UNION ALL SELECT p_partkey, NULL, p_retailprice FROM part""")
def metastore_append(spark, sf):
    name, _, _ = _table_at(spark, "appended", [("id", "bigint"), ("note", "string"), ("price", "double")])
    o, p = table(spark, sf, "orders"), table(spark, sf, "part")
    sink.metastore_append(o.select(F.col("o_orderpriority").alias("note"), F.col("o_orderkey").alias("id")), name)
    sink.metastore_append(p.select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("price")), name)
    return spark.table(name)


@query("append_misfits", """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'x' || o_orderkey WHEN o_orderkey % 3 = 0 THEN '1.5'
  ELSE '99999999999' END AS note, 'values that do not fit: note' AS error FROM orders
WHERE o_orderkey % 7 <> 0 AND (o_orderkey % 5 = 0 OR o_orderkey % 3 = 0 OR o_orderkey % 2 = 0)""")
def append_misfits(spark, sf):
    """Dead letters of an append: text, fractions and values beyond the type; NULLs and what fits is written."""
    name, _, _ = _table_at(spark, "misfits", [("id", "bigint"), ("note", "int")])
    k = F.col("o_orderkey")
    note = F.when(k % 7 == 0, F.lit(None)).when(k % 5 == 0, F.concat(F.lit("x"), k.cast("string"))).when(k % 3 == 0, "1.5").when(
        k % 2 == 0, "99999999999").otherwise((k % 100).cast("string"))
    rows = table(spark, sf, "orders").select(k.alias("id"), note.alias("note"))
    sink.metastore_append(rows, name, misfits="skip")
    return sink.append_misfits(rows, name)


@query("conflict_null_keys", """
WITH t AS (SELECT CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderkey // 2 END AS id, o_totalprice AS v FROM orders
  WHERE o_orderstatus = 'F'),
i AS (SELECT CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey // 3 END AS id, o_totalprice + 1 AS v, o_orderkey AS seq FROM orders),
l AS (SELECT id, arg_max(v, seq) AS v FROM i WHERE id IS NOT NULL GROUP BY id)
SELECT t.id, CASE WHEN l.id IS NULL THEN t.v ELSE l.v END AS v FROM t LEFT JOIN l ON t.id = l.id
UNION ALL SELECT id, v FROM l WHERE id NOT IN (SELECT id FROM t WHERE id IS NOT NULL)
UNION ALL SELECT id, v FROM i WHERE id IS NULL""")
def conflict_null_keys(spark, sf):
    """NULL keys match nothing and stay; keys that the target holds more than once stay as many."""
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    existing = o.filter("o_orderstatus = 'F'").select(F.when(k % 10 != 0, F.floor(k / 2)).cast("bigint").alias("id"), F.col("o_totalprice").alias("v"))
    incoming = o.select(F.when(k % 7 != 0, F.floor(k / 3)).cast("bigint").alias("id"), (F.col("o_totalprice") + 1).alias("v"), k.alias("seq"))
    return conflicts.merge_frames(existing, incoming, ["id"], "update", "seq")


@query("conflict_unknown_columns", """
SELECT count(*) AS rows, 'columns the target lacks: o_clerk' AS error FROM orders""")
def conflict_unknown_columns(spark, sf):
    """Every policy refuses a column that the target lacks, and leaves the target as it is."""
    o = table(spark, sf, "orders")
    target = o.select("o_orderkey", "o_custkey")
    incoming = target.withColumn("o_clerk", F.lit("c")).withColumn("seq", F.col("o_orderkey"))
    errors = set()
    for policy in conflicts.POLICIES:
        try:
            conflicts.merge_frames(target, incoming, ["o_orderkey"], policy, "seq")
        except conflicts.UnknownColumns as e:
            errors.add(str(e))
    return target.agg(F.count(F.lit(1)).alias("rows"), F.lit("; ".join(sorted(errors))).alias("error"))


@query("write_many", """
SELECT 'app.customer.jsonl' AS file_name, count(*) AS lines FROM customer
UNION ALL SELECT 'app.line_item_s.jsonl', count(*) FROM lineitem
UNION ALL SELECT 'app.nation.jsonl', count(*) FROM nation""")
def write_many(spark, sf):
    root = scratch(spark, "many")
    paths = sink.write_many(
        {"customer": table(spark, sf, "customer"), "line item/s": table(spark, sf, "lineitem"), "nation": table(spark, sf, "nation")},
        root, "app",
    )
    each = spark.read.text(list(paths.values())).select(F.col("_metadata.file_path").alias("p"))
    folder = F.element_at(F.split("p", "/"), -2).alias("file_name")
    return each.groupBy(folder).agg(F.count(F.lit(1)).alias("lines"))


@query("direct_copy", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders""")
def direct_copy(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice").withColumn("seq", F.col("o_orderkey"))
    path = scratch(spark, "copied")
    sink.direct_copy(o.filter("o_totalprice > 250000"), path, ["o_orderkey"], "seq")
    sink.direct_copy(o, path, ["o_orderkey"], "seq", existing=spark.read.parquet(path))
    return spark.read.parquet(path)


# --- incremental -----------------------------------------------------------------

@query("resume_offset", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM (
  SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n > 4321""")
def resume_offset(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    left = incremental.resume_offset(o, ["o_orderdate", "o_orderkey"], 4321)
    return left.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("resume_offset_ties", """
SELECT l_orderkey, l_linenumber, l_quantity FROM (SELECT *, row_number() OVER (ORDER BY l_quantity, l_orderkey, l_linenumber) AS n FROM lineitem)
WHERE n > (SELECT count(*) // 3 FROM lineitem)""")
def resume_offset_ties(spark, sf):
    """A third of the rows is done, in order of a key that thousands of rows share."""
    li = table(spark, sf, "lineitem").select("l_quantity", "l_orderkey", "l_linenumber")
    return incremental.resume_offset(li, ["l_quantity"], li.count() // 3).select("l_orderkey", "l_linenumber", "l_quantity")


@query("resume_files", """
SELECT o_orderkey, o_orderkey + 1 AS line_no FROM orders WHERE o_orderkey >= 4321""")
def resume_files(spark, sf):
    """A file of lines read on from a cursor that is joined to its blocks."""
    path = scratch(spark, "resumed")
    o = table(spark, sf, "orders")
    # All tasks sort; the one that writes the file only reads their parts, one after another.
    out.write_lines(cut_lineage(lines_of(o, "o_orderkey").orderBy("line_no")).coalesce(1), path)
    name = spark.read.text(path).select(F.col("_metadata.file_path").alias("file")).distinct()
    left = read_lines(spark, path, after=name.select("file", F.lit(4321).alias("line_no")))
    return left.select(F.get_json_object("value", "$.o_orderkey").cast("bigint").alias("o_orderkey"), "line_no")


@query("resume_lines", """
WITH c AS (SELECT event_type, min(event_id) AS done FROM events WHERE value > 150 GROUP BY 1)
SELECT e.event_type AS file, e.event_id AS line_no FROM events e LEFT JOIN c USING (event_type)
WHERE e.event_id > coalesce(c.done, 0)""")
def resume_lines(spark, sf):
    e = table(spark, sf, "events")
    lines = lines_of(e, "event_id", file=F.col("event_type"))
    cursor = e.filter("value > 150").groupBy(F.col("event_type").alias("file")).agg(F.min("event_id").alias("line_no"))
    return incremental.resume_lines(lines, cursor).select("file", "line_no")


@query("resume_keyset", """
SELECT o_custkey, o_orderkey FROM orders WHERE (o_custkey, o_orderkey) > (700, 6000)""")
def resume_keyset(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    return incremental.resume_keyset(o, ["o_custkey", "o_orderkey"], [700, 6000])


@query("next_keyset", """
SELECT o_custkey, o_orderkey FROM orders ORDER BY o_custkey DESC, o_orderkey DESC LIMIT 1""")
def next_keyset(spark, sf):
    return incremental.next_keyset(table(spark, sf, "orders"), ["o_custkey", "o_orderkey"])


@query("resume_slices", """
WITH s AS (SELECT o_orderkey, o_orderkey % 4 AS slice, o_orderstatus FROM orders),
c AS (SELECT slice, max(o_orderkey) // 2 AS last FROM s WHERE slice <> 3 GROUP BY 1)
SELECT CAST(slice AS INTEGER) AS slice, count(*) AS rows, max(o_orderkey) AS last_key, 4 AS slices
FROM s LEFT JOIN c USING (slice) WHERE last IS NULL OR o_orderkey > last GROUP BY 1""")
def resume_slices(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey")
    sliced = src.sliced_scan(o, 4, "o_orderkey", F.pmod("o_orderkey", F.lit(4)).cast("int"))
    cursors = sliced.filter("slice <> 3").groupBy("slice").agg(
        F.count(F.lit(1)).alias("rows"), F.floor(F.max("o_orderkey") / 2).cast("bigint").alias("last_key"),
        F.lit(4).alias("slices"),
    )
    left = incremental.resume_slices(sliced, cursors, "o_orderkey", 4)
    return incremental.slice_cursors(left, "o_orderkey", 4)


@query("resume_tables", """
SELECT 'customer' AS table_name, count(*) - 70 AS rows FROM customer UNION ALL SELECT 'orders', count(*) FROM orders""")
def resume_tables(spark, sf):
    tables = [
        ("part", table(spark, sf, "part"), ["p_partkey"]),
        ("customer", table(spark, sf, "customer"), ["c_custkey"]),
        ("orders", table(spark, sf, "orders"), ["o_orderkey"]),
    ]
    return catalog.row_counts(incremental.resume_tables(tables, {"table_index": 1, "rows": 70}))


@query("commit_watermark", """
WITH d AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_linestatus = 'F'),
p AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n FROM d),
w AS (SELECT l_orderkey, max(l_linenumber) AS b FROM p WHERE n = l_linenumber GROUP BY 1)
SELECT DISTINCT l_orderkey, CAST(coalesce(b, 0) * 100 AS BIGINT) AS watermark, CAST(coalesce(b, 0) AS BIGINT) AS batches
FROM lineitem LEFT JOIN w USING (l_orderkey)""")
def commit_watermark(spark, sf):
    batches = table(spark, sf, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").cast("bigint").alias("seq"),
        (F.col("l_linenumber") * 100).cast("bigint").alias("end_line"), (F.col("l_linestatus") == "F").alias("committed"),
    )
    return incremental.commit_watermark(batches, "l_orderkey")


@query("stream_ingest", """
SELECT o_orderkey, o_custkey, o_totalprice, NULL::VARCHAR AS error_column FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '5-LOW')
UNION ALL SELECT NULL, NULL, NULL, CASE WHEN o_orderpriority = '1-URGENT' THEN 'o_totalprice' ELSE 'o_orderdate' END
FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')""")
def stream_ingest(spark, sf):
    root = scratch(spark, "ingest")
    out.write_lines(damaged_orders(spark, sf), f"{root}/in")
    flow = flows.stream_ingest(spark, f"{root}/in", f"{root}/out", f"{root}/dead", f"{root}/ckpt", ImportSpec(ORDER_TARGETS))
    flow.awaitTermination()
    good = spark.read.parquet(f"{root}/out").select("o_orderkey", "o_custkey", "o_totalprice", F.lit(None).cast("string").alias("error_column"))
    dead = spark.read.parquet(f"{root}/dead")
    return good.unionByName(dead.select(F.col("column_name").alias("error_column")), allowMissingColumns=True)


@query("stream_ingest_keyed", """
SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice,
  CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '5-LOW')
UNION ALL SELECT o_orderkey, NULL, o_totalprice * 2, 'X' FROM orders WHERE o_orderkey % 3 = 0 AND o_orderpriority IN ('1-URGENT', '5-LOW')""")
def stream_ingest_keyed(spark, sf):
    """Two drops of files into one keyed table: all good orders, then records that change two columns of every third order."""
    root = scratch(spark, "keyed")
    kinds = {c: spark_type(t) for c, t in ORDER_TARGETS.items()}
    target = KeyedTable.create(spark, f"{root}/table", StructType.fromDDL(", ".join(f"{c} {t}" for c, t in kinds.items())), ["o_orderkey"])
    third = table(spark, sf, "orders").filter("o_orderkey % 3 = 0")
    change = F.to_json(F.struct("o_orderkey", (F.col("o_totalprice") * 2).alias("o_totalprice"), F.lit("X").alias("o_orderstatus")))
    for drop in (damaged_orders(spark, sf), lines_of(third, "o_orderkey", change)):
        out.write_lines(drop, f"{root}/in", mode="append")
        flow = flows.stream_ingest_keyed(spark, f"{root}/in", target, f"{root}/dead", f"{root}/ckpt", ImportSpec(ORDER_TARGETS), "update")
        flow.awaitTermination()
    return target.read().select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")


@query("stream_log", """
SELECT event_type AS level, CAST(user_id AS VARCHAR) AS user_field, count(*) AS n FROM events GROUP BY 1, 2""")
def stream_log(spark, sf):
    root = scratch(spark, "logs")
    e = table(spark, sf, "events")
    line = F.to_json(F.struct(F.col("ts").alias("timestamp"), F.col("event_type").alias("level"), F.lit("svc").alias("service"),
                              F.lit("m").alias("message"), F.col("user_id")))
    blank = F.when(F.col("value") > 30, F.concat(line, F.lit("\n  \n"))).otherwise(line)
    e.select(blank.alias("value")).write.text(f"{root}/in")

    def deliver(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={batch_id}")

    flows.stream_log_batches(spark, f"{root}/in", f"{root}/ckpt", deliver, interval=None).awaitTermination()
    got = spark.read.parquet(f"{root}/out")
    return got.groupBy("level", F.try_element_at("fields", F.lit("user_id")).alias("user_field")).agg(F.count(F.lit(1)).alias("n"))


@query("stream_log_growing", """
SELECT event_type AS level, CAST(user_id AS VARCHAR) AS user_field, count(*) AS n FROM events GROUP BY 1, 2""")
def stream_log_growing(spark, sf):
    """Four log files that tasks append to between the triggers, each time leaving off inside a line."""
    root = scratch(spark, "growing").removeprefix("file://").removeprefix("file:")
    os.makedirs(f"{root}/in")
    e = table(spark, sf, "events")
    line = F.to_json(F.struct(F.col("ts").alias("timestamp"), F.col("event_type").alias("level"), F.lit("svc").alias("service"),
                              F.lit("m").alias("message"), F.col("user_id")))

    def append(rows):
        with open(f"{root}/in/{TaskContext.get().partitionId()}.log", "a") as f:
            for r in rows:
                f.write(f"\n{r.line}")

    def deliver(batch, batch_id):
        batch.write.mode("append").parquet(f"{root}/out")

    def drain():
        flows.stream_log_growing(spark, f"{root}/in", f"{root}/ckpt", deliver, interval=None, start="begin").awaitTermination()

    for third in range(3):
        e.filter(F.col("event_id") % 3 == third).select("event_id", line.alias("line")).repartition(4, "event_id").foreachPartition(append)
        drain()
    spark.range(0, 4, 1, 4).select(F.lit("").alias("line")).foreachPartition(append)
    drain()
    got = spark.read.parquet(f"{root}/out")
    return got.groupBy("level", F.try_element_at("fields", F.lit("user_id")).alias("user_field")).agg(F.count(F.lit(1)).alias("n"))


@query("progress_metrics", """
SELECT 'table' AS file, count(*) FILTER (o_orderpriority NOT IN ('1-URGENT', '5-LOW')) AS rows, max(o_orderkey) + 1 AS lines,
  count(*) FILTER (o_orderpriority IN ('1-URGENT', '5-LOW')) AS skipped FROM orders""")
def progress_metrics(spark, sf):
    return flows.progress_metrics(convert_records(rec.records_of(damaged_orders(spark, sf)), ImportSpec(ORDER_TARGETS)))


# --- catalog -----------------------------------------------------------------------

@query("tables_with_columns", """
SELECT c_mktsegment || c_custkey AS schema, 't' || o_orderkey AS table_name,
  CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS estimated_rows, cols AS columns
FROM orders JOIN customer ON o_custkey = c_custkey
LEFT JOIN (SELECT l_orderkey, string_agg(l_linenumber || ':' || l_partkey || ':' || l_suppkey, ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS cols
  FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P' AND c_mktsegment <> 'BUILDING'""")
def tables_with_columns(spark, sf):
    o, c, li = table(spark, sf, "orders"), table(spark, sf, "customer"), table(spark, sf, "lineitem")
    relations = o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("table_id"), F.col("o_custkey").alias("namespace_id"),
        F.concat(F.lit("t"), F.col("o_orderkey").cast("string")).alias("table_name"),
        F.when(F.col("o_orderstatus") == "P", "view").otherwise("table").alias("kind"),
        F.col("c_acctbal").alias("estimated_rows"),
    )
    spaces = c.filter("c_mktsegment <> 'BUILDING'").select(
        F.col("c_custkey").alias("namespace_id"), F.concat("c_mktsegment", F.col("c_custkey").cast("string")).alias("schema")
    )
    columns = li.select(
        F.col("l_orderkey").alias("table_id"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("ordinal"),
        F.col("l_partkey").cast("string").alias("name"), F.col("l_suppkey").cast("string").alias("type"),
    )
    listed = catalog.tables_with_columns(relations, spaces, columns)
    text = F.array_join(
        F.transform("columns", lambda x: F.concat_ws(":", x["ordinal"]["l_linenumber"].cast("string"), x["name"], x["type"])), ","
    )
    return listed.withColumn("columns", text)


@query("pk_flag", """
SELECT l_orderkey AS table_name, l_linenumber AS name, bool_or(o_orderstatus = 'F' AND l_returnflag = 'R') AS is_pk
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2""")
def pk_flag(spark, sf):
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    columns = li.select(F.lit("app").alias("schema"), F.col("l_orderkey").alias("table_name"), F.col("l_linenumber").alias("name")).distinct()
    constraints = o.select(
        F.lit("app").alias("schema"), F.col("o_orderkey").alias("table_name"), F.col("o_orderkey").alias("constraint_name"),
        F.when(F.col("o_orderstatus") == "F", "PRIMARY KEY").otherwise("UNIQUE").alias("constraint_type"),
    )
    usage = li.filter("l_returnflag = 'R'").select(
        F.lit("app").alias("schema"), F.col("l_orderkey").alias("table_name"), F.col("l_orderkey").alias("constraint_name"),
        F.col("l_linenumber").alias("column_name"),
    )
    return catalog.primary_key_flag(columns, constraints, usage).select("table_name", "name", "is_pk")


@query("is_unique", """
SELECT count(*) = count(DISTINCT (l_orderkey, l_linenumber)) AS is_unique, count(*) AS rows,
  count(DISTINCT (l_orderkey, l_linenumber)) AS keys FROM lineitem""")
def is_unique(spark, sf):
    return catalog.is_unique(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


ALL_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
              "embeddings", "pages", "benchmark", "labels", "conversations")


@query("row_counts", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS rows FROM {t}" for t in ALL_TABLES))
def row_counts(spark, sf):
    return catalog.row_counts({t: table(spark, sf, t) for t in ALL_TABLES})


@query("label_counts", """
SELECT 'Customer' AS label, count(*) AS nodes FROM customer UNION ALL SELECT c_mktsegment, count(*) FROM customer GROUP BY 1""")
def label_counts(spark, sf):
    return catalog.label_counts(rec.graph_nodes(rec.records_of(node_lines(spark, sf))))


@query("edge_type_counts", """
SELECT 'PLACED_' || o_orderstatus AS type, count(*) AS edges FROM orders GROUP BY 1""")
def edge_type_counts(spark, sf):
    return catalog.edge_type_counts(rec.graph_edges(rec.records_of(edge_lines(spark, sf))))


@query("index_listing", """
SELECT c_name AS index, CASE WHEN c_acctbal < 0 THEN 'red' ELSE 'green' END AS health,
  CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS docs, CAST(c_nationkey AS DOUBLE) AS size,
  coalesce(a.aliases, '') AS aliases, coalesce(f.fields, '') AS fields FROM customer
LEFT JOIN (SELECT o_custkey, string_agg('o' || o_orderkey, ',' ORDER BY 'o' || o_orderkey) AS aliases FROM orders
  WHERE o_orderstatus = 'P' GROUP BY 1) a ON a.o_custkey = c_custkey
LEFT JOIN (SELECT user_id, string_agg(n || ':' || event_type, ',' ORDER BY n, event_type) AS fields FROM (
  SELECT user_id, event_type, 'f' || event_id AS n FROM events) GROUP BY 1) f ON f.user_id = c_custkey""")
def index_listing(spark, sf):
    c = table(spark, sf, "customer")
    name = lambda k: F.concat(F.lit("Customer#"), F.lpad(F.col(k).cast("string"), 9, "0")).alias("index")
    stats = c.select(
        F.col("c_name").alias("index"), F.when(F.col("c_acctbal") < 0, "red").otherwise("green").alias("health"),
        F.when(F.col("c_acctbal") < 0, "n/a").otherwise(F.col("c_acctbal").cast("string")).alias("docs"),
        F.col("c_nationkey").cast("string").alias("size"),
    )
    aliases = table(spark, sf, "orders").select(
        name("o_custkey"),
        F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("o"), F.col("o_orderkey").cast("string"))).otherwise("").alias("alias"),
    )
    fields = table(spark, sf, "events").select(
        name("user_id"), F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("name"), F.col("event_type").alias("type")
    )
    listed = catalog.index_listing(stats, aliases, fields)
    return listed.select(
        "index", "health", "docs", "size", F.array_join("aliases", ",").alias("aliases"),
        F.array_join(F.transform("fields", lambda f: F.concat_ws(":", f["name"], f["type"])), ",").alias("fields"),
    )


@query("preview", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1000")
def preview(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return catalog.preview(o, 5000, [F.col("o_totalprice").desc(), F.col("o_orderkey")])


@query("recent_topk", "SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id LIMIT 5")
def recent_topk(spark, sf):
    return catalog.recent_topk(table(spark, sf, "events").select("event_id", "user_id", "ts"), "ts", 5, ["event_id"]).drop("ts")


@query("count_by_type", """
SELECT event_type AS type, count(*) AS n FROM events GROUP BY 1 UNION ALL SELECT '*total*', count(*) FROM events""")
def count_by_type(spark, sf):
    return catalog.count_by_type(table(spark, sf, "events"), "event_type")
