"""The keyed table: which files a write replaces, what a reader sees, and streams that die at the worst moment."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from recordloom.operators.conflicts import KeyConflict, UnknownColumns, merge_frames
from recordloom.plans.import_plan import OPEN_FILES_CONF, ImportSpec, import_once
from recordloom.operators.quality import RowError
from recordloom.session import shared_root
from recordloom.sinks.keyed import ConcurrentWrite, KeyedTable
from recordloom.streaming import flows

SHAPE = "id long, name string, n int"


@pytest.fixture
def stored(spark, tmp_path):
    """400 rows in four files by ranges of the key."""
    rows = spark.range(400).select("id", F.concat(F.lit("r"), "id").alias("name"), F.lit(0).alias("n"))
    table = KeyedTable.create(spark, str(tmp_path / "t"), spark.createDataFrame([], SHAPE).schema, ["id"])
    done = table.write(rows.repartitionByRange(4, "id").withColumn("seq", F.col("id")), "skip", "seq")
    assert done["rewritten"] == 0
    return table


def spread(table):
    """Live files with rows, by least id."""
    got = table.read().groupBy(F.col("_metadata.file_name").alias("f")).agg(F.min("id").alias("lo")).orderBy("lo").collect()
    return [r.f for r in got]


def rows_of(df):
    return sorted(map(str, map(tuple, df.collect())))


def ranged(spark, table, parts=4):
    """The table again, in files by ranges of the key."""
    state = table.state()
    return table._swap(state, list(state["files"]), table._put(table.read().repartitionByRange(parts, "id")))


def test_update_rewrites_touched_files_only(spark, stored):
    ranged(spark, stored)
    before = spread(stored)
    assert len(before) == 4
    change = spark.createDataFrame([(5, "x", 1), (5, "y", 2), (1000, "new", 3), (None, "free", 4)], "id long, name string, seq int")
    want = rows_of(merge_frames(stored.read(), change, ["id"], "update", "seq"))
    done = stored.write(change, "update", "seq")
    after = spread(stored)
    assert done["rewritten"] == 1 and set(before[1:]) <= set(after) and before[0] not in after
    assert rows_of(stored.read()) == want
    assert stored.read().filter("id = 5").head()[1:] == ("y", 0)


@pytest.mark.parametrize("policy", ["skip", "update", "overwrite"])
def test_policies_equal_the_whole_merge(spark, stored, policy):
    rng = random.Random(4)
    rows = [(rng.choice([None, rng.randrange(500)]), f"v{i}", i) for i in range(300)]
    for part in (rows[:100], rows[100:101], [], rows[101:]):
        change = spark.createDataFrame(part, "id long, name string, seq int")
        want = rows_of(merge_frames(stored.read(), change, ["id"], policy, "seq"))
        done = stored.write(change, policy, "seq")
        assert rows_of(stored.read()) == want
        assert policy != "skip" or done["rewritten"] == 0
    with pytest.raises(ValueError, match="unknown policy"):
        stored.write(change, "merge", "seq")


def test_presence_tells_absent_from_null(spark, stored):
    change = spark.createDataFrame([(1, None, 7, ["n"], 1), (2, None, None, ["name"], 2)], f"{SHAPE}, has array<string>, seq int")
    stored.write(change, "update", "seq", "has")
    assert rows_of(stored.read().filter("id IN (1, 2)")) == ["(1, 'r1', 7)", "(2, None, 0)"]


def test_error_policy_changes_nothing(spark, stored):
    before = stored.state()
    with pytest.raises(KeyConflict, match="id=7"):
        stored.write(spark.createDataFrame([(7, "x", 1), (900, "y", 2)], "id long, name string, seq int"), "error", "seq")
    with pytest.raises(KeyConflict, match="id=901"):
        stored.write(spark.createDataFrame([(901, "x", 1), (901, "y", 2)], "id long, name string, seq int"), "error", "seq")
    with pytest.raises(UnknownColumns):
        stored.write(spark.createDataFrame([(901, "x", 1)], "id long, other string, seq int"), "update", "seq")
    assert stored.state() == before
    stored.write(spark.createDataFrame([(901, "x", 1)], "id long, name string, seq int"), "error", "seq")
    assert stored.read().count() == 401


def test_readers_writers_and_vacuum(spark, stored):
    frame, state = stored.read(), stored.state()
    stored.write(spark.createDataFrame([(1, "x", 1)], "id long, name string, seq int"), "overwrite", "seq")
    assert frame.filter("id = 1").head().name == "r1" and stored.read().filter("id = 1").head().name == "x"
    with pytest.raises(ConcurrentWrite):
        stored._swap(state, [], {})
    stored._put(stored.read())  # a write that died before its version
    assert stored.read().count() == 400
    assert stored.vacuum(keep=1) > 0 and stored.read().count() == 400
    for i in range(5):
        stored.write(spark.createDataFrame([(2000 + i, "x", 1)], "id long, name string, seq int"), "skip", "seq")
    want = rows_of(stored.read())
    done = stored.compact()
    assert done["added"] == 1 and done["kept"] == 0 and rows_of(stored.read()) == want
    again = KeyedTable.create(spark, stored.path, frame.schema, ["id"])
    assert again.state()["version"] == done["version"] and stored.compact()["rewritten"] == 0


def drop(folder, name, records):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(r) + "\n" if not isinstance(r, str) else r + "\n" for r in records))


SPEC = ImportSpec({"id": "bigint", "name": "text", "n": "int"})


def ingest(spark, root, table, checkpoint="ckpt", policy="update"):
    seen = []
    flow = flows.stream_ingest_keyed(spark, str(root / "in"), table, str(root / "dead"), str(root / checkpoint), SPEC, policy,
                                     on_batch=lambda b, c: seen.append(c))
    flow.awaitTermination()
    return seen


def test_keyed_stream_survives_death_between_data_and_ledger(spark, tmp_path, monkeypatch):
    table = KeyedTable.create(spark, str(tmp_path / "t"), spark.createDataFrame([], SHAPE).schema, ["id"])
    drop(tmp_path / "in", "a.jsonl", [{"id": 1, "name": "a", "n": 1}, {"id": 2, "name": "b", "n": 2}, "oops", {"id": 1, "n": 5}])
    publish = KeyedTable._publish

    def die(self, state):
        raise RuntimeError("killed before the version")

    monkeypatch.setattr(KeyedTable, "_publish", die)
    with pytest.raises(Exception, match="killed before"):
        ingest(spark, tmp_path, table)
    monkeypatch.setattr(KeyedTable, "_publish", publish)
    assert table.read().count() == 0

    def die_after(self, state):
        publish(self, state)
        raise RuntimeError("killed after the version")

    monkeypatch.setattr(KeyedTable, "_publish", die_after)
    with pytest.raises(Exception, match="killed after"):
        ingest(spark, tmp_path, table)
    monkeypatch.setattr(KeyedTable, "_publish", publish)
    assert rows_of(table.read()) == ["(1, 'a', 5)", "(2, 'b', 2)"]
    version = table.state()["version"]
    assert ingest(spark, tmp_path, table) == [] and table.state()["version"] == version
    drop(tmp_path / "in", "b.jsonl", [{"id": 2, "name": None}, {"id": 3, "name": "c", "n": 3}])
    done = ingest(spark, tmp_path, table)
    assert [(d["rows"], d["skipped"], d["rewritten"]) for d in done] == [(2, 0, 1)]
    want = ["(1, 'a', 5)", "(2, None, 2)", "(3, 'c', 3)"]
    assert rows_of(table.read()) == want
    # A new checkpoint reads no file again.
    assert ingest(spark, tmp_path, table, "other") == [] and rows_of(table.read()) == want
    dead = spark.read.parquet(str(tmp_path / "dead"))
    assert [(r.line_no, r.error) for r in dead.filter("error IS NOT NULL").collect()] == [(3, "line 3 is not a JSON object")]


def test_keyed_stream_stages_rows_once(spark, tmp_path):
    """The rows of a batch are staged by the conversion; the write reads them there and keeps no second copy."""
    root = shared_root(spark)
    copies = lambda: {n for n in os.listdir(root) if n.startswith("incoming-")}
    table = KeyedTable.create(spark, str(tmp_path / "t"), spark.createDataFrame([], SHAPE).schema, ["id"])
    drop(tmp_path / "in", "a.jsonl", [{"id": 1, "name": "a", "n": 1}, {"id": 1, "n": 2}, "oops", {"id": None, "name": "free"}])
    before = copies()
    ingest(spark, tmp_path, table)
    drop(tmp_path / "in", "b.jsonl", [{"id": 1, "name": None}, {"id": 2, "name": "b", "n": 3}])
    ingest(spark, tmp_path, table)
    assert copies() == before
    assert rows_of(table.read()) == ["(1, None, 2)", "(2, 'b', 3)", "(None, 'free', None)"]
    # Rows that are no scan are still computed once, into a copy.
    table.write(spark.createDataFrame([(3, "c", 1)], "id long, name string, seq int"), "update", "seq")
    assert len(copies() - before) == 1 and table.read().count() == 4


def test_outcomes_are_written_and_the_setting_restored(spark, tmp_path):
    before = spark.conf.get(OPEN_FILES_CONF)
    drop(tmp_path / "in", "a.jsonl", [{"id": i, "name": "a", "n": "x" if i % 2 else i} for i in range(40)])
    good, dead, counts = import_once(flows.read_records(spark, str(tmp_path / "in")), SPEC, str(tmp_path / "once"))
    assert (good.count(), dead.count(), counts["rows"], counts["skipped"]) == (20, 20, 20, 20)
    assert spark.conf.get(OPEN_FILES_CONF) == before


def test_keyed_stream_under_error_policy_stops(spark, tmp_path):
    table = KeyedTable.create(spark, str(tmp_path / "t"), spark.createDataFrame([], SHAPE).schema, ["id"])
    drop(tmp_path / "in", "a.jsonl", [{"id": 1, "name": "a", "n": 1}])
    ingest(spark, tmp_path, table, policy="error")
    drop(tmp_path / "in", "b.jsonl", [{"id": 1, "name": "a", "n": 1}, {"id": 2, "name": "a", "n": 1}])
    with pytest.raises(Exception, match="duplicate key"):
        ingest(spark, tmp_path, table, policy="error")
    assert table.read().count() == 1


class Plans:
    """Counts executed plans that parse JSON lines."""

    def __init__(self):
        self.parsed = 0

    def onSuccess(self, name, execution, took):  # noqa: N802
        self.parsed += "from_json" in execution.executedPlan().toString()

    def onFailure(self, name, execution, error):  # noqa: N802
        pass

    class Java:
        implements = ["org.apache.spark.sql.util.QueryExecutionListener"]


def test_one_conversion_a_batch(spark, tmp_path):
    from pyspark import SparkContext
    from pyspark.java_gateway import ensure_callback_server_started

    ensure_callback_server_started(SparkContext._gateway)
    records = lambda: flows.read_records(spark, str(tmp_path / "in" / "a.jsonl"))
    drop(tmp_path / "in", "a.jsonl", [{"id": i, "name": "a", "n": "x" if i % 10 == 3 else i} for i in range(50)])
    plans = Plans()
    spark._jsparkSession.listenerManager().register(plans)
    try:
        good, dead, counts = import_once(records(), SPEC, str(tmp_path / "once"), presence="has")
        assert good.columns == ["file", "line_no", "row_idx", "has", "id", "name", "n"] and good.count() == 45 and dead.count() == 5
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        assert plans.parsed == 1
    finally:
        spark._jsparkSession.listenerManager().unregister(plans)
    assert counts == {"rows": 45, "skipped": 5, "lines": 50}
    with pytest.raises(RowError, match="line 4, column n"):
        import_once(records(), SPEC, str(tmp_path / "fail"), "fail")
