"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Inputs that a query reads as files are written before the clock starts.
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    from pyspark.sql import functions as F

    from recordloom.operators import conflicts, infer
    from recordloom.plans import QUERIES
    from recordloom.plans.import_plan import ImportSpec, run_import
    from recordloom.plans.registry import lines_of, table
    from recordloom.session import build_session
    from recordloom.sinks.lines import envelope_lines, record_lines, write_lines
    from recordloom.sources.records import read_records, records_of

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    root = tempfile.mkdtemp(prefix="recordloom-bench-")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "8g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": root,
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    lineitem, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    rows = lineitem.count()
    write_lines(record_lines(lineitem.repartition(int(cpus))), f"{root}/lineitem.jsonl")

    types = {
        "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int",
        "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
        "l_returnflag": "text", "l_linestatus": "text", "l_shipdate": "timestamp",
    }

    def sink(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    def import_records() -> None:
        sink(run_import(read_records(spark, f"{root}/lineitem.jsonl"), ImportSpec(types))[0])

    def infer_schema() -> None:
        infer.infer_schema(read_records(spark, f"{root}/lineitem.jsonl", "position")).collect()

    def envelope_round_trip() -> None:
        keyed = lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
        lines = envelope_lines(keyed, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], 1000, "lineitem", "app")
        sink(records_of(lines_of(lines, F.col("batch_no") + 1, F.col("value"))))

    def conflict_update() -> None:
        existing = orders.filter("o_orderstatus = 'F'")
        incoming = orders.select("o_orderkey", F.col("o_totalprice") + 1, F.col("o_orderkey").alias("seq")).toDF(
            "o_orderkey", "o_totalprice", "seq")
        sink(conflicts.merge_frames(existing, incoming, ["o_orderkey"], "update", "seq"))

    jobs = {
        "import_records": import_records,
        "infer_schema": infer_schema,
        "envelope_round_trip": envelope_round_trip,
        "conflict_update": conflict_update,
    }
    for name in ("import_orders", "dead_letter", "unwrap_hits", "tables_with_columns", "step_summary", "group_runs",
                 "commit_watermark", "dependency_components", "dependency_state", "scan_many"):
        jobs[name] = lambda name=name: sink(QUERIES[name](spark, sf))

    times = {}
    for name, job in jobs.items():
        best = None
        for _ in range(2):
            start = time.perf_counter()
            job()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    scale = re.search(r"sf([\d.]+)", sf)
    print(json.dumps({
        "metric": "total time of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(scale[1]) if scale else None,
        "rows_per_sec": {k: round(rows / times[k]) for k in ("import_records", "infer_schema", "envelope_round_trip")},
    }))


if __name__ == "__main__":
    main()
