"""Exact line numbers, marks that travel with blocks, and the key at a place."""

import datetime
import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from recordloom.operators import incremental
from recordloom.sources import lines as source
from recordloom.sources.records import read_complete_lines, recover_complete_lines


@pytest.fixture
def files(tmp_path):
    rng = random.Random(3)
    made = {}
    for name, n in (("a", 900), ("b", 0), ("c", 1), ("d", 400)):
        text = [json.dumps({"i": i, "x": "y" * rng.randint(0, 60)}) if rng.random() > 0.1 else " " for i in range(n)]
        if name in "ad":
            text[n // 2] = '{"cut":'
        (tmp_path / f"{name}.jsonl").write_text("\n".join(text) + ("\n" if n % 2 else ""))
        made[f"file://{tmp_path}/{name}.jsonl"] = text
    return tmp_path, made


def small_blocks(spark, size="4k"):
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")


@pytest.fixture
def blocks(spark):
    small_blocks(spark)
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def normal(rows):
    return sorted((r.file.replace("file:///", "file:/").replace("file:/", "file:///"), r.line_no, r.value) for r in rows)


@pytest.mark.parametrize("most", [4 << 20, 3])
def test_numbers_cursors_and_complete_lines(spark, files, blocks, monkeypatch, most):
    monkeypatch.setattr(source, "MOST_BLOCKS", most)
    root, made = files
    want = sorted((f, i + 1, x) for f, text in made.items() for i, x in enumerate(text))
    got = source.read_lines(spark, str(root))
    assert normal(got.collect()) == want
    names = {f.replace("file:///", ""): f for f in {r.file for r in got.collect()}}
    assert len(names) == 3
    marks = [(next(n for n in names.values() if n.endswith(f"{x}.jsonl")), k) for x, k in (("a", 333), ("c", 1))]
    cursor = spark.createDataFrame(marks, "file string, line_no int")
    after = {"a.jsonl": 333, "c.jsonl": 1}
    rest = source.read_lines(spark, str(root), after=cursor)
    assert normal(rest.collect()) == [w for w in want if w[1] > after.get(w[0].rpartition("/")[2], 0)]
    whole = read_complete_lines(spark, str(root))
    cut = {f: next((i for i, x in enumerate(text) if x == '{"cut":'), len(text)) for f, text in made.items()}
    assert normal(whole.collect()) == [w for w in want if w[1] <= cut[w[0]] and w[2].strip()]
    assert normal(recover_complete_lines(got).collect()) == normal(whole.collect())


def test_lines_are_not_shuffled(spark, files, blocks):
    root, _ = files
    some = spark.createDataFrame([("x", 1)], "file string, line_no int")
    for df in (source.read_lines(spark, str(root)), source.read_lines(spark, str(root), after=some), read_complete_lines(spark, str(root))):
        join = df._jdf.queryExecution().sparkPlan()
        while "BroadcastHashJoin" not in join.nodeName():
            assert join.children().size() == 1, join.toString()
            join = join.children().apply(0)
        streamed = join.children().apply(0).toString()
        assert "FileScan text" in streamed and "Join" not in streamed and "Exchange" not in streamed


def test_key_at_every_kind_of_key(spark, monkeypatch):
    monkeypatch.setattr(incremental, "SORTED_ROWS", 5)
    monkeypatch.setattr(incremental, "SPLITTERS", 3)
    rng = random.Random(9)
    day = datetime.datetime(2026, 3, 1, 12, 30, 1, 123456)
    rows = [(rng.choice([None, 1, 1, 1, 2, 7]), rng.choice([None, "", "ä", "b"]), rng.choice([0.1, -3.5, 1e300]), day + datetime.timedelta(microseconds=rng.randrange(4)),
             Decimal(rng.randrange(4)) / 7, bytes([rng.randrange(256)]), i) for i in range(120)]
    df = spark.createDataFrame(rows, "a int, s string, d double, t timestamp, n decimal(20,6), b binary, i int")
    df = df.withColumn("z", F.col("t").cast("timestamp_ntz")).repartition(5).cache()
    for keys in (["a"], ["s", "d"], ["t"], ["n", "b"], ["z", "a"], ["i"]):
        order = [r.i for r in df.orderBy(*keys, *df.columns).collect()]
        for done in (1, 59, 119):
            got = incremental.resume_offset(df, keys, done)
            assert sorted(r.i for r in got.collect()) == sorted(order[done:]), (keys, done)
    assert incremental.resume_offset(df, ["a"], 120).count() == 0 and incremental.resume_offset(df, ["a"], 0).count() == 120
    assert incremental.resume_offset(df.limit(0), ["a"], 3).count() == 0


def test_offset_needs_no_global_sort(spark):
    df = spark.range(100_000).select(F.xxhash64("id").alias("k"), F.repeat(F.lit("payload"), 10).alias("p"))
    left = incremental.resume_offset(df, ["k"], 70_000)
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Exchange" not in plan and "RDDScan" not in plan and "ExistingRDD" not in plan
    assert left.count() == 30_000
