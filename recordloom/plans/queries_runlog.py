"""Queries: run-log analytics and job specifications."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.functions import names
from recordloom.operators import jobs, runlog
from recordloom.plans.registry import query, table


@query("parse_task_log", """
SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_custkey END AS payload_customer,
  CASE o_orderpriority WHEN '1-URGENT' THEN NULL WHEN '2-HIGH' THEN NULL WHEN '3-MEDIUM' THEN ''
    ELSE o_orderkey || ',' || o_custkey END AS depends_on,
  CASE WHEN o_orderstatus = 'F' THEN 'run-' || o_custkey END AS run_id,
  CASE WHEN o_orderstatus = 'F' THEN CAST(o_custkey AS INTEGER) END AS step_index,
  CASE WHEN o_orderpriority = '5-LOW' THEN 'failed' END AS error FROM orders""")
def parse_task_log(spark, sf):
    o = table(spark, sf, "orders")
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    deps = (
        F.when(p == "1-URGENT", F.lit("[1,\"a\"]")).when(p == "2-HIGH", F.lit("")).when(p == "3-MEDIUM", F.lit("[]"))
        .otherwise(F.format_string('["%d","%d"]', "o_orderkey", "o_custkey"))
    )
    meta = F.when(
        s == "F",
        F.format_string('{"runId":"run-%d","templateId":"t","templateName":"n","stepIndex":%d,"stepCount":9}', "o_custkey", "o_custkey"),
    ).when(s == "O", F.format_string('{"runId":%d,"templateId":"t","templateName":"n","stepIndex":1,"stepCount":9}', "o_custkey"))
    log = o.select(
        F.col("o_orderkey").alias("id"), p.alias("type"), s.alias("status"),
        F.when(s == "P", F.lit("{broken")).otherwise(F.format_string('{"customer":%d}', "o_custkey")).alias("payload"),
        deps.alias("depends_on"), meta.alias("template_meta"), F.lit(None).cast("int").alias("progress"),
        F.lit("").alias("cursor"), F.when(p == "5-LOW", F.lit("failed")).otherwise(F.lit("")).alias("error"),
        F.col("o_orderdate").cast("string").alias("created_at"), F.lit(None).cast("string").alias("started_at"),
        F.lit(None).cast("string").alias("finished_at"),
    )
    return runlog.parse_task_log(log).select(
        "id", F.try_variant_get("payload", "$.customer", "bigint").alias("payload_customer"),
        F.array_join("depends_on", ",").alias("depends_on"), F.col("template.run_id").alias("run_id"),
        F.col("template.step_index").alias("step_index"), "error",
    )


@query("aggregate_results", """
SELECT count(*) AS tasks, count(*) FILTER (l_returnflag = 'A') AS completed, count(*) FILTER (l_returnflag = 'N') AS failed,
  count(*) FILTER (l_returnflag = 'R') AS canceled, CAST(sum(l_quantity) AS BIGINT) AS rows, CAST(sum(l_partkey) AS BIGINT) AS duration_ms FROM lineitem""")
def aggregate_results(spark, sf):
    li = table(spark, sf, "lineitem")
    status = F.when(F.col("l_returnflag") == "A", "completed").when(F.col("l_returnflag") == "N", "failed").otherwise("canceled")
    return runlog.aggregate_results(
        li.select(status.alias("status"), F.col("l_quantity").cast("bigint").alias("rows"), F.col("l_partkey").alias("duration_ms"))
    )


@query("step_summary", """
WITH s AS (SELECT l_orderkey AS run_id, l_linenumber AS i, l_tax = 0.08 AS malformed, l_linestatus = 'F' OR l_quantity < 40 AS ok FROM lineitem),
f AS (SELECT run_id, min(i) FILTER (malformed OR NOT ok) AS first FROM s GROUP BY 1)
SELECT run_id, count(*) AS total, count(*) FILTER (NOT malformed AND ok AND (first IS NULL OR i <= first)) AS completed,
  count(*) FILTER (malformed OR (NOT ok AND i = first)) AS failed,
  count(*) FILTER (NOT malformed AND i > first) AS skipped
FROM s JOIN f USING (run_id) GROUP BY 1""")
def step_summary(spark, sf):
    li = table(spark, sf, "lineitem")
    steps = li.select(
        F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("step_index"),
        F.when(F.col("l_tax") != 0.08, F.col("l_returnflag")).alias("atom"),
        ((F.col("l_linestatus") == "F") | (F.col("l_quantity") < 40)).alias("ok"),
    )
    return runlog.step_summary(steps)


@query("group_runs", """
WITH g AS (SELECT 'template:' || o_custkey AS group_key, max(o_orderdate) AS latest, count(*) AS task_count,
  count(*) FILTER (o_orderstatus = 'F') AS completed_count FROM orders GROUP BY 1)
SELECT group_key, o_orderkey AS id, task_count, completed_count,
  row_number() OVER (PARTITION BY group_key ORDER BY o_orderpriority, o_orderdate, o_orderkey) AS position,
  row_number() OVER (ORDER BY latest DESC, group_key, o_orderpriority, o_orderdate, o_orderkey) - 1 AS global_position
FROM orders JOIN g ON g.group_key = 'template:' || o_custkey""")
def group_runs(spark, sf):
    o = table(spark, sf, "orders")
    tasks = o.select(
        F.concat(F.lit("template:"), F.col("o_custkey").cast("string")).alias("group_key"), F.col("o_orderkey").alias("id"),
        F.col("o_orderpriority").alias("step_index"), F.col("o_orderdate").alias("created_at"),
        F.when(F.col("o_orderstatus") == "F", "completed").otherwise("failed").alias("status"),
    )
    return runlog.group_runs(tasks).select("group_key", "id", "task_count", "completed_count", "position", "global_position")


def task_chain(spark, sf) -> DataFrame:
    """Every order is a task; those of lower priority depend on the order before them."""
    o = table(spark, sf, "orders")
    chained = F.col("o_orderpriority").isin("4-NOT SPECIFIED", "5-LOW")
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("seq"),
        F.when(chained, F.array(F.col("o_orderkey") - 1)).otherwise(F.array().cast("array<bigint>")).alias("depends_on"),
        F.when(F.col("o_orderstatus") == "O", "postgres-export").otherwise("postgres-import").alias("type"),
        F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderdate") < "1995-03-01", "failed")
        .otherwise("queued").alias("status"),
    )


CHAIN = """WITH o AS (SELECT *, o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW') AND o_orderkey > (SELECT min(o_orderkey) FROM orders) AS linked FROM orders),
c AS (SELECT *, max(CASE WHEN NOT linked THEN o_orderkey END) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS component FROM o)"""


@query("dependency_components", CHAIN + """
SELECT o_orderkey AS id, component FROM c""")
def dependency_components(spark, sf):
    return runlog.dependency_components(task_chain(spark, sf))


@query("dependency_order", CHAIN + """
SELECT o_orderkey AS id, CAST(o_orderkey - component AS INTEGER) AS level FROM c""")
def dependency_order(spark, sf):
    return runlog.dependency_order(task_chain(spark, sf)).select("id", "level")


@query("dependency_order_chain", """
SELECT o_orderkey AS id, CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS INTEGER) AS level FROM orders""")
def dependency_order_chain(spark, sf):
    """Each order waits for the one before it: a chain as long as the table."""
    o = table(spark, sf, "orders")
    key = F.col("o_orderkey")
    tasks = o.select(key.alias("id"), key.alias("seq"), F.array(key - 1).alias("depends_on"))
    return runlog.dependency_order(tasks).select("id", "level")


@query("match_template", CHAIN + """,
l AS (SELECT component, count(*) AS n, string_agg(CASE WHEN o_orderstatus = 'O' THEN 'E' ELSE 'I' END, '' ORDER BY o_orderkey) AS types FROM c GROUP BY 1)
SELECT component, n, CASE types WHEN 'EI' THEN 'copy' WHEN 'EII' THEN 'fan' WHEN 'I' THEN 'load' ELSE 'dependency group' END AS template_name FROM l""")
def match_template(spark, sf):
    tasks = task_chain(spark, sf)
    components = runlog.dependency_components(tasks)
    levels = runlog.dependency_order(tasks).select("id", "level")
    e, i = "postgres-export", "postgres-import"
    templates = spark.createDataFrame(
        [(1, "copy", [e, i]), (2, "copy again", [e, i]), (3, "fan", [e, i, i]), (4, "load", [i])],
        "template_no int, name string, step_types array<string>",
    )
    return runlog.match_template(tasks.join(levels, "id"), components, templates)


@query("dependency_state", """
WITH RECURSIVE o AS (SELECT o_orderkey AS id,
  CASE WHEN o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW') THEN o_orderkey - 1 END AS dep,
  CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderdate < TIMESTAMP '1995-03-01' THEN 'failed' ELSE 'queued' END AS status FROM orders),
d AS (SELECT o.id, o.dep, o.status, CASE WHEN o.dep IS NULL THEN NULL ELSE coalesce(p.status, 'unknown') END AS ds FROM o LEFT JOIN o p ON p.id = o.dep),
r AS (
  SELECT id, CASE WHEN ds IS NULL OR ds = 'completed' THEN 'ready' ELSE 'blocked' END AS state, dep
  FROM d WHERE status = 'queued' AND (ds IS NULL OR ds <> 'queued')
  UNION ALL SELECT d.id, CASE WHEN r.state = 'blocked' THEN 'blocked' ELSE 'waiting' END, d.dep FROM d JOIN r ON d.dep = r.id WHERE d.status = 'queued')
SELECT id, state, CASE WHEN state = 'blocked' THEN dep END AS blocked_by FROM r""")
def dependency_state(spark, sf):
    return runlog.dependency_state(task_chain(spark, sf))


@query("render_template", """
SELECT p_partkey, 'copy ' || p_name || ' to {{P_TYPE}} for {{UNKNOWN}} ' || p_name || ';' AS text FROM part""")
def render_template(spark, sf):
    p = table(spark, sf, "part")
    variables = F.create_map(
        F.lit("NAME"), F.col("p_name"), F.lit("TARGET"), F.lit("{{P_TYPE}}"), F.lit("P_TYPE"), F.col("p_type")
    )
    text = F.lit("copy {{NAME}} to {{TARGET}} for {{UNKNOWN}} {{NAME}};")
    return p.select("p_partkey", names.render_template(text, variables).alias("text"))


NOW = datetime(2026, 1, 2, 3, 4, 5, tzinfo=timezone.utc)
VARIABLES = "array<struct<name:string,default_value:string>>"


@query("template_vars", """
SELECT p_partkey, '2026-01-02' AS today, '03:04:05' AS now, '1767323045' AS stamp, p_name AS a, 'user' AS b, p_type AS c, '' AS d FROM part""")
def template_vars(spark, sf):
    p = table(spark, sf, "part")
    one = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("default_value"))
    template = F.array(
        one("A", F.col("p_name")), one("B", F.lit("template")), one("C", F.lit("template")),
        one("D", F.lit(None).cast("string")),
    ).cast(VARIABLES)
    step = F.array(F.struct(F.lit("C").alias("name"), F.col("p_type").alias("default_value"))).cast(VARIABLES)
    merged = jobs.step_variables(template, {"B": "user", "C": "user"}, step, NOW)
    at = lambda n: F.try_element_at(F.col("m"), F.lit(n))
    return p.select("p_partkey", merged.alias("m")).select(
        "p_partkey", at("TODAY").alias("today"), at("NOW").alias("now"), at("TIMESTAMP").alias("stamp"),
        at("A").alias("a"), at("B").alias("b"), at("C").alias("c"), at("D").alias("d"),
    )


@query("expand_steps", """
SELECT 'r' || p_partkey || '-1' AS task_id, CASE WHEN p_size > 40 THEN 'hive-export' ELSE 'postgres-export' END AS type, '' AS depends_on,
  1 AS step_index, CASE WHEN p_size > 25 THEN 2 ELSE 1 END AS step_count,
  CASE WHEN p_size > 25 THEN '{"file":"' || p_name || '"' || CASE WHEN p_size > 40 THEN ',"type":"hive-export"' ELSE '' END || '}' ELSE '{"top":"' || p_name || '"}' END AS config_json FROM part
UNION ALL SELECT 'r' || p_partkey || '-2', 'elasticsearch-import', 'r' || p_partkey || '-1', 2, 2, '{"day":"2026-01-02","x":"step"}' FROM part WHERE p_size > 25""")
def expand_steps(spark, sf):
    p = table(spark, sf, "part")
    empty = F.array().cast(VARIABLES)
    step = "array<struct<name:string,engine:string,action:string,config_json:string,variables:array<struct<name:string,default_value:string>>>>"
    config = F.when(F.col("p_size") > 40, F.lit('{"file":"{{NAME}}","type":"hive-export"}')).otherwise(F.lit('{"file":"{{NAME}}"}'))
    own = F.array(F.struct(F.lit("X").alias("name"), F.lit("step").alias("default_value"))).cast(VARIABLES)

    def one_step(name, engine, action, config_json, variables):
        return F.struct(
            F.lit(name).alias("name"), F.lit(engine).alias("engine"), F.lit(action).alias("action"),
            config_json.alias("config_json"), variables.alias("variables"),
        ).cast(step[6:-1])

    two = F.array(
        one_step("read", "pgmigrator", "export", config, empty),
        one_step("load", "esmigrator", "import", F.lit('{"day":"{{TODAY}}","x":"{{X}}"}'), own),
    )
    templates = p.select(
        F.col("p_partkey").alias("template_id"), F.col("p_name").alias("name"), F.lit("pgmigrator").alias("engine"),
        F.lit("export").alias("action"), F.lit('{"top":"{{NAME}}"}').alias("config_json"),
        F.array(F.struct(F.lit("NAME").alias("name"), F.col("p_name").alias("default_value"))).cast(VARIABLES).alias("variables"),
        F.when(F.col("p_size") > 25, two).alias("steps"),
    )
    expanded = jobs.expand_steps(templates, {"X": "user"}, NOW, F.concat(F.lit("r"), F.col("template_id").cast("string")))
    return expanded.select(
        "task_id", "type", F.array_join("depends_on", ",").alias("depends_on"), "step_index", "step_count", "config_json"
    )


@query("name_functions", """
SELECT p_partkey, '"' || p_name || '""' || p_brand || '"' AS pg, '`' || p_type || '`.`' || p_name || '`' AS my,
  regexp_replace(p_type || '.' || p_name || '/' || p_brand, '[^a-zA-Z0-9._-]', '_', 'g') || '.jsonl' AS file,
  'node_' || regexp_replace(p_brand || '.x', '[^a-zA-Z0-9_-]', '_', 'g') || '.jsonl' AS graph_file,
  regexp_full_match(p_name, '[A-Za-z_][A-Za-z0-9_]*(\\.[A-Za-z_][A-Za-z0-9_]*)*') AS name_ok, true AS type_ok FROM part""")
def name_functions(spark, sf):
    p = table(spark, sf, "part")
    full = F.concat(F.col("p_type"), F.lit("."), F.col("p_name"), F.lit("/"), F.col("p_brand"))
    return p.select(
        "p_partkey",
        names.quote_identifier(F.concat("p_name", F.lit('"'), "p_brand"), "postgresql").alias("pg"),
        names.qualified_name(F.col("p_type"), F.col("p_name"), "mysql").alias("my"),
        names.safe_file_name(full).alias("file"),
        names.safe_graph_file_name(F.lit("node"), F.concat("p_brand", F.lit(".x"))).alias("graph_file"),
        names.valid_identifier(F.col("p_name")).alias("name_ok"),
        names.valid_identifier(F.concat("p_type", F.lit("."), "p_type")).alias("type_ok"),
    )
