"""Samples that read the beginning of files only, and positions inside a hot key."""

import json

import pytest
from pyspark.sql import functions as F

from recordloom.operators.infer import infer_schema_files, infer_schema_sample
from recordloom.operators.ordinal import with_ordinal
from recordloom.plans.import_plan import ImportSpec, cast_dry_run_files
from recordloom.sources.records import META, read_first_records, read_records


@pytest.fixture
def folder(tmp_path):
    for f in range(5):
        lines = [json.dumps({"i": 1000 * f + i, f"k{f}": "x"}) if i % 10 else ("oops" if i % 20 else " ") for i in range(2000)]
        (tmp_path / f"p{f}.jsonl").write_text("\n".join(lines) + "\n")
    (tmp_path / "p0a.jsonl").write_text("")
    return str(tmp_path)


@pytest.mark.parametrize("n, most", [(1, 64), (50, 64), (100, 200), (2000, 10_000)])
def test_few_lines_are_read(spark, folder, n, most):
    good, bad, read = read_first_records(spark, folder, n)
    whole = read_records(spark, folder)
    want = whole.filter("error IS NULL").orderBy(*META).limit(n)
    shown = [F.element_at(F.split("file", "/"), -1), "line_no", F.to_json("rec")]
    assert sorted(good.select(*shown).collect()) == sorted(want.select(*shown).collect())
    assert read <= most
    last = max((r.file.rpartition("/")[2], r.line_no) for r in good.collect())
    before = {(r.file.rpartition("/")[2], r.line_no) for r in whole.filter("error IS NOT NULL").collect()}
    assert {(r.file.rpartition("/")[2], r.line_no) for r in bad.collect()} == {x for x in before if x < last}


def test_sample_larger_than_the_files_takes_all(spark, folder):
    good, bad, _ = read_first_records(spark, folder, 100_000)
    whole = read_records(spark, folder)
    assert good.count() == whole.filter("error IS NULL").count() and bad.count() == whole.filter("error IS NOT NULL").count()
    with pytest.raises(ValueError):
        read_first_records(spark, folder, 0)


def test_inference_and_dry_run_of_files(spark, folder):
    columns, bad = infer_schema_files(spark, folder, 300)
    assert sorted(columns.collect()) == sorted(infer_schema_sample(read_records(spark, folder), 300).collect())
    assert {r.error for r in bad.collect()} == {f"line {i + 1} is not a JSON object" for i in range(10, 340, 20) if i < 334}
    # Bounded by lines: twice the records.
    few, _, _ = read_first_records(spark, folder, 300, most_lines=100)
    assert few.count() == 90
    tried = cast_dry_run_files(spark, folder, ImportSpec({"i": "smallint", "k0": "int"}), 12)
    assert tried.filter("error IS NULL").count() == 0 and tried.filter("error_column = 'k0'").count() == 12


def test_hot_key_is_spread_and_positions_repeat(spark):
    # Small partitions would be joined again.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spread_and_repeat(spark)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def spread_and_repeat(spark):
    rows = spark.range(100_000).select(F.lit("hot").alias("k"), "id", F.create_map(F.lit("m"), "id").alias("m")).repartition(8)
    a = with_ordinal(rows, ["k"])
    parts = a.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(parts) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(p["count"] for p in parts) < 50_000
    b = with_ordinal(rows.repartition(5, "id"), ["k"])
    both = a.select("id", "ordinal").join(b.select("id", F.col("ordinal").alias("again")), "id")
    assert both.filter("ordinal = again").count() == 100_000
    assert a.select("ordinal").distinct().count() == 100_000
