import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from recordloom.operators import catalog, conflicts, filters, incremental, jobs, runlog
from recordloom.functions import names
from recordloom.operators.ordinal import with_ordinal
from recordloom.plans.import_plan import ImportSpec
from recordloom.streaming import flows


@pytest.fixture
def tables(spark):
    target = spark.createDataFrame([(1, "existing-a", 1.0), (2, "existing-b", 2.0), (3, "existing-c", None)], "id int, name string, score double")
    incoming = spark.createDataFrame(
        [(10, 1, "updated-a"), (11, 2, "updated-b"), (12, 4, "fresh-d"), (13, 4, "fresh-d2"), (14, 5, "fresh-e")], "seq bigint, id int, name string")
    return target, incoming


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_policies(tables):
    target, incoming = tables
    merge = lambda p: rows(conflicts.merge_frames(target, incoming, ["id"], p, "seq"))
    assert merge("skip") == [(1, "existing-a", 1.0), (2, "existing-b", 2.0), (3, "existing-c", None), (4, "fresh-d", None), (5, "fresh-e", None)]
    assert merge("update") == [(1, "updated-a", 1.0), (2, "updated-b", 2.0), (3, "existing-c", None), (4, "fresh-d2", None), (5, "fresh-e", None)]
    assert merge("overwrite") == [(1, "updated-a", None), (2, "updated-b", None), (3, "existing-c", None), (4, "fresh-d2", None), (5, "fresh-e", None)]
    with pytest.raises(conflicts.KeyConflict):
        merge("error")
    assert rows(conflicts.rows_to_append(target, incoming, ["id"], "seq")) == [(4, "fresh-d"), (5, "fresh-e")]


def test_skip_twice_is_skip(tables):
    target, incoming = tables
    once = conflicts.merge_frames(target, incoming, ["id"], "skip", "seq")
    assert rows(conflicts.merge_frames(once, incoming, ["id"], "skip", "seq")) == rows(once)


def test_update_tells_absent_from_null(spark, tables):
    target, _ = tables
    incoming = spark.createDataFrame([(1, 1, None, 9.0, ["name"]), (2, 1, "x", None, ["score"]), (3, 3, "n", 7.0, ["name", "score"])],
                                     "seq bigint, id int, name string, score double, has array<string>")
    got = rows(conflicts.merge_frames(target, incoming, ["id"], "update", "seq", "has"))
    assert got == [(1, None, None), (2, "existing-b", 2.0), (3, "n", 7.0)]


def test_ordinal_is_exact(spark):
    df = spark.range(0, 500, numPartitions=9).select(F.pmod(F.col("id") * 7919, F.lit(500)).alias("k"))
    assert all(r.k == r.o for r in with_ordinal(df, ["k"], "o").collect())


def test_resume_and_prefix_are_the_whole(spark):
    df = spark.range(100).select(F.pmod("id", F.lit(7)).alias("a"), F.col("id").alias("b"))
    ordered = sorted(tuple(r) for r in df.collect())
    assert rows(incremental.resume_offset(df, ["a", "b"], 37)) == ordered[37:]
    assert rows(incremental.resume_keyset(df, ["a", "b"], list(ordered[36]))) == ordered[37:]
    assert tuple(incremental.next_keyset(df, ["a", "b"]).collect()[0]) == ordered[-1]
    with pytest.raises(ValueError):
        incremental.resume_offset(df, [], 1)
    with pytest.raises(ValueError):
        incremental.check_advance([1, 2], [1, 2])


def test_keyset_bound_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "k")
    spark.range(10).select(F.col("id").alias("a"), F.col("id").alias("b")).write.parquet(path)
    plan = incremental.resume_keyset(spark.read.parquet(path), ["a", "b"], [3, 4])._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(a,3)" in plan


def test_lines_slices_and_tables(spark, lines):
    text = lines(["a", "b", "c"])
    assert [r.value for r in incremental.resume_lines(text, {"f": 2}).collect()] == ["c"]
    assert incremental.resume_lines(text, spark.createDataFrame([("f", 1)], "file string, line_no bigint")).count() == 2
    sliced = spark.range(12).withColumn("slice", F.pmod("id", F.lit(3)).cast("int"))
    cursors = spark.createDataFrame([(0, 2, 3, 3)], "slice int, rows bigint, last_key bigint, slices int")
    assert rows(incremental.resume_slices(sliced, cursors, "id", 3).filter("slice = 0").select("id")) == [(6,), (9,)]
    with pytest.raises(ValueError):
        incremental.resume_slices(sliced, cursors, "id", 4)
    left = incremental.resume_tables([("a", spark.range(5), ["id"]), ("b", spark.range(5), ["id"]), ("c", spark.range(5), ["id"])], {"table_index": 1, "rows": 2})
    assert {k: v.count() for k, v in left.items()} == {"b": 3, "c": 5}


@pytest.mark.parametrize("done, want", [([1, 2, 3], (30, 3)), ([1, 2, 4], (20, 2)), ([2, 3], (0, 0)), ([], (0, 0)), ([1, 3, 4, 5], (10, 1))])
def test_commit_watermark(spark, done, want):
    df = spark.createDataFrame([(i, i * 10, i in done) for i in range(1, 6)], "seq bigint, end_line bigint, committed boolean")
    assert tuple(incremental.commit_watermark(df).collect()[0]) == want


def brute_components(n, edges):
    root = list(range(n))
    for _ in range(n):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    return root


@pytest.mark.parametrize("shape", ["chain", "hub", "random"])
def test_components_against_brute_force(spark, shape):
    n, rng = 60, random.Random(4)
    edges = {
        "chain": [(i, i + 1) for i in range(n - 1) if i % 20 != 19],
        "hub": [(0, i) for i in range(1, 40)] + [(41, 40)],
        "random": [tuple(rng.sample(range(n), 2)) for _ in range(35)],
    }[shape]
    tasks = spark.createDataFrame([(i, [b for a, b in edges if a == i] + [999]) for i in range(n)], "id bigint, depends_on array<bigint>")
    got = {r.id: r.component for r in runlog.dependency_components(tasks).collect()}
    assert got == dict(enumerate(brute_components(n, edges)))


def test_order_puts_dependencies_first_and_flags_cycles(spark):
    deps = {1: [3], 2: [1], 3: [], 4: [1, 2], 5: [6], 6: [5], 7: [99], 8: [5]}
    tasks = spark.createDataFrame([(k, k, v) for k, v in deps.items()], "id bigint, seq bigint, depends_on array<bigint>")
    level = {r.id: r.level for r in runlog.dependency_order(tasks).collect()}
    assert level == {3: 0, 7: 0, 1: 1, 2: 2, 4: 3, 5: None, 6: None, 8: None}


def brute_levels(deps):
    """Levels by peeling; what is left is on or behind a cycle."""
    known = {k: {d for d in v if d in deps} for k, v in deps.items()}
    level = {}
    while found := [k for k, v in known.items() if k not in level and all(d in level for d in v)]:
        level.update({k: 1 + max((level[d] for d in known[k]), default=-1) for k in found})
    return {k: level.get(k) for k in deps}


@pytest.mark.parametrize("seed", range(2))
def test_levels_against_peeling(spark, seed):
    rng = random.Random(seed)
    n = 60
    deps = {i: [] for i in range(n)}
    for i in range(1, n):
        # Chains, joins, repeated and unknown dependencies; the odd seed has cycles, also of odd length.
        deps[i] = [i - 1] * (i % 10 != 0) + rng.sample(range(i), min(i, rng.choice([0, 0, 0, 0, 0, 2]))) + rng.choice([[], [999], [None]])
    if seed % 2:
        deps[40].append(42)
        deps[55].append(55)
    tasks = spark.createDataFrame([(k, -k, v) for k, v in deps.items()], "id bigint, seq bigint, depends_on array<bigint>")
    found = runlog.dependency_order(tasks).collect()
    assert {r.id: r.level for r in found} == brute_levels(deps) and all(r.seq == -r.id for r in found)


@pytest.mark.parametrize("seed", range(2))
def test_levels_of_contracted_chains(spark, monkeypatch, seed):
    monkeypatch.setattr(runlog, "FEW_SINGLE", 3, raising=False)
    rng = random.Random(seed)
    n = 90
    deps = {i: [i - 1] * (i % 30 != 0) + rng.sample(range(max(i, 1)), min(i, rng.choice([0, 0, 0, 0, 1]))) for i in range(n)}
    deps |= {100: [101], 101: [100], 102: [101], 103: [102], 104: [], 105: [105], 106: [999]}
    tasks = spark.createDataFrame([(k, -k, v) for k, v in deps.items()] + [(None, 1, [5]), (50, 7, [49])], "id bigint, seq bigint, depends_on array<bigint>")
    found = [tuple(r) for r in runlog.dependency_order(tasks).collect()]
    deps[50] = list({*deps[50], 49})
    level = brute_levels(deps)
    assert sorted(found, key=str) == sorted([(k, -k, level[k]) for k in deps] + [(None, 1, 0), (50, 7, level[50])], key=str)


def test_a_chain_writes_a_few_times_its_rows(spark, monkeypatch):
    rows = []
    put = runlog._written
    monkeypatch.setattr(runlog, "_written", lambda df: rows.append((made := put(df)).count()) or made)
    monkeypatch.setattr(runlog, "FEW_SINGLE", 100, raising=False)
    n = 4000
    chain = spark.range(n).selectExpr("id", "id AS seq", "IF(id = 0, array(), array(id - 1)) AS depends_on")
    assert {r.id: r.level for r in runlog.dependency_order(chain).collect()} == {i: i for i in range(n)}
    assert sum(rows) < 10 * n


def test_a_chain_takes_logarithmic_rounds(spark, monkeypatch):
    cuts = []
    cut = runlog._written
    monkeypatch.setattr(runlog, "_written", lambda df: cuts.append(1) or cut(df))
    n = 1000
    chain = spark.range(n).selectExpr("id", "id AS seq", "IF(id = 0, array(), array(id - 1)) AS depends_on")
    found = {r.id: r.level for r in runlog.dependency_order(chain).collect()}
    assert found == {i: i for i in range(n)}
    # Two cuts a round; 2 ** 10 > n.
    assert len(cuts) <= 2 * 12 + 2


def brute_state(tasks):
    status = {i: s for i, s, _ in tasks}
    changed = True
    while changed:
        changed = False
        for i, s, deps in tasks:
            if status[i] != "queued":
                continue
            for d in deps:
                ds = status.get(d, "unknown")
                if ds == "completed":
                    continue
                if ds in ("failed", "canceled", "unknown"):
                    status[i] = "failed"
                    changed = True
                break
    out = {}
    for i, s, deps in tasks:
        if s == "queued":
            rest = [d for d in deps if status.get(d, "unknown") != "completed"]
            out[i] = "blocked" if status[i] == "failed" else "waiting" if rest else "ready"
    return out


def test_dependency_state_against_brute_force(spark):
    rng = random.Random(11)
    tasks = [(i, rng.choice(["completed", "failed", "running", "queued", "queued", "queued", "queued"]), [rng.randrange(-1, 80) for _ in range(rng.randrange(3))])
             for i in range(80)]
    df = spark.createDataFrame(tasks, "id bigint, status string, depends_on array<bigint>")
    got = {r.id: r.state for r in runlog.dependency_state(df).collect()}
    assert got == brute_state(tasks)


def test_long_chain_is_resolved_in_few_rounds(spark):
    tasks = [(0, "failed", [])] + [(i, "queued", [i - 1]) for i in range(1, 300)]
    df = spark.createDataFrame(tasks, "id bigint, status string, depends_on array<bigint>")
    states = runlog.dependency_state(df)
    assert states.filter("state = 'blocked'").count() == 299


def test_step_status(spark):
    steps = spark.createDataFrame([("r", 0, "unknown", False), ("r", 1, "preview", True), ("r", 2, None, None), ("q", 0, "a", True)],
                                  "run_id string, step_index int, atom string, ok boolean")
    got = {(r.run_id, r.step_index): r.status for r in runlog.step_status(steps).collect()}
    assert got == {("r", 0): "failed", ("r", 1): "skipped", ("r", 2): "failed", ("q", 0): "completed"}
    assert rows(runlog.step_summary(steps)) == [("q", 1, 1, 0, 0), ("r", 3, 0, 2, 1)]


def test_groups_and_templates(spark):
    tasks = spark.createDataFrame([("t3", "run", 3, "2026-01-01", "completed"), ("t2", "run", 2, "2026-01-01", "failed"), ("t1", "run", 1, "2026-01-01", "completed"),
                                   ("u", "later", 1, "2026-02-01", "queued")], "id string, group_key string, step_index int, created_at string, status string")
    got = runlog.group_runs(tasks).orderBy("global_position").collect()
    assert [(r.id, r.position, r.task_count, r.completed_count) for r in got] == [("u", 1, 1, 0), ("t1", 1, 3, 2), ("t2", 2, 3, 2), ("t3", 3, 3, 2)]
    chain = spark.createDataFrame([("first", 0, "x", []), ("second", 1, "y", ["first"]), ("third", 2, "x", ["second"]), ("lone", 3, "q", [])],
                                  "id string, seq int, type string, depends_on array<string>")
    levels = runlog.dependency_order(chain).select("id", "level")
    templates = spark.createDataFrame([(1, "three", ["x", "y", "x"]), (2, "other", ["x"])], "template_no int, name string, step_types array<string>")
    named = runlog.match_template(chain.join(levels, "id"), runlog.dependency_components(chain), templates)
    assert rows(named) == [("first", 3, "three"), ("lone", 1, "dependency group")]


@pytest.mark.parametrize(
    "text, want",
    [("{{A}} text", "1 text"), ("{{X}}", "{{X}}"), ("{{B}}{{A}}", "{{A}}1"), ("none", "none"), ("{{ A }}", "{{ A }}"), ("x{{A}}", "x1"), ("", "")],
)
def test_templates_render_once(spark, text, want):
    m = names.constant_map({"A": "1", "B": "{{A}}"})
    assert spark.range(1).select(names.render_template(F.lit(text), m)).collect()[0][0] == want


def test_built_in_variables_and_types(spark):
    now = datetime(2026, 1, 2, 3, 4, 5, tzinfo=timezone.utc)
    assert names.built_in_variables(now) == {"TODAY": "2026-01-02", "NOW": "03:04:05", "TIMESTAMP": "1767323045"}
    pick = jobs.task_type(F.lit("pgmigrator"), F.lit("export"), F.lit('{"type":"x-export"}'))
    assert spark.range(1).select(pick).collect()[0][0] == "x-export"


def test_filter_language(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", 5), (3, "abc", 9)], "id int, s string, n int")
    ids = lambda q: [r.id for r in filters.filter_dsl(df, q, "id").orderBy("id").collect()]
    assert ids(None) == ids({"match_all": {}}) == [1, 2, 3]
    assert ids({"range": {"n": {"gte": 5, "lt": 9}}}) == [2] and ids({"exists": {"field": "n"}}) == [2, 3]
    assert ids({"bool": {"must_not": {"range": {"n": {"gt": 6}}}}}) == [1, 2]
    assert ids({"bool": {"should": [{"term": {"s": "b"}}, {"wildcard": {"s": "a?c"}}]}}) == [2, 3]
    assert ids({"bool": {"must": [{"prefix": {"s": "a"}}], "should": [{"term": {"id": 99}}]}}) == [1, 3]
    assert ids({"ids": {"values": ["3"]}}) == [3] and ids('{"terms":{"n":[5,9]}}') == [2, 3]
    for bad in ({"fuzzy": {"s": "a"}}, {"term": {"zzz": 1}}, {}, {"range": {"n": {"near": 1}}}, {"bool": {"x": []}}):
        with pytest.raises(ValueError):
            filters.filter_dsl(df, bad)
    assert filters.where(df, " ").count() == 3 and filters.where(df, "n > 5").count() == 1


def test_filter_on_text_dates_and_inner_fields(spark):
    now = datetime(2024, 1, 10, 12, tzinfo=timezone.utc)
    df = spark.sql("""
        SELECT * FROM VALUES (1, '2024-01-09T13:00:00Z', named_struct('b', 1), array(named_struct('k', 1), named_struct('k', 9))),
          (2, '2024-01-01', named_struct('b', 2), array(named_struct('k', 5))), (3, 'soon', NULL, array()),
          (4, NULL, named_struct('b', NULL), NULL) AS t(id, day, a, items)""").withColumn("x.y", F.col("id"))
    ids = lambda q: [r.id for r in filters.filter_dsl(df, q, "id", now).orderBy("id").collect()]
    assert ids({"range": {"day": {"gte": "now-1d"}}}) == [1] and ids({"range": {"day": {"lt": "now-1d"}}}) == [2]
    assert ids({"bool": {"must_not": {"range": {"day": {"gte": "now-1d"}}}}}) == [2, 3, 4]
    assert ids({"range": {"day": {"gte": "2024-01-05", "lt": "now"}}}) == [1] and ids({"term": {"day": "soon"}}) == [3]
    assert ids({"terms": {"day": ["soon", "now-9d/d"]}}) == [2, 3]
    assert ids({"term": {"a.b": 2}}) == [2] and ids({"exists": {"field": "a.b"}}) == [1, 2] and ids({"term": {"x.y": 3}}) == [3]
    # Any value of a list, one value within all bounds.
    assert ids({"term": {"items.k": 9}}) == [1] and ids({"range": {"items.k": {"gt": 2, "lt": 8}}}) == [2]
    assert ids({"bool": {"must_not": {"terms": {"items.k": [1, 5]}}}}) == [3, 4]
    for bad in ("a.c", "a.b.c", "items.z", "day.x", "q.b"):
        with pytest.raises(ValueError):
            filters.filter_dsl(df, {"term": {bad: 1}})


def test_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "f")
    spark.range(10).select(F.col("id").alias("n")).write.parquet(path)
    plan = filters.filter_dsl(spark.read.parquet(path), {"range": {"n": {"gte": 5}}})._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(n,5)" in plan


def test_catalog(spark):
    assert [catalog.clamp_preview(x) for x in (None, float("nan"), 0, 5.9, 9999)] == [20, 20, 1, 5, 1000]
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "t string, at int")
    assert rows(catalog.count_by_type(df, "t")) == [("*total*", 3), ("a", 2), ("b", 1)]
    assert [r.at for r in catalog.recent_topk(df, "at", 2).collect()] == [3, 2]
    assert rows(catalog.is_unique(df, ["t"])) == [(False, 3, 2)] and rows(catalog.is_unique(df, ["t", "at"])) == [(True, 3, 3)]


def test_stream_ingest_resumes_without_repeating(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.jsonl").write_text('{"id":1}\n{"id":"bad"}\n')
    args = [str(tmp_path / x) for x in ("in", "out", "dead", "ckpt")]
    seen = []

    def run():
        flows.stream_ingest(spark, *args, ImportSpec({"id": "int"}), on_batch=lambda b, m: seen.append(m["rows"])).awaitTermination()
        return [r.id for r in spark.read.parquet(args[1]).orderBy("id").collect()]

    assert run() == [1]
    (src / "b.jsonl").write_text('{"columns":["id"],"rows":[[2],[3]]}\n')
    assert run() == [1, 2, 3] and run() == [1, 2, 3] and seen == [1, 2]
    assert [r.error for r in spark.read.parquet(args[2]).collect()] == ["line 2, column id: string -> int: not an integer from -2147483648 to 2147483647"]


def test_log_batches_are_kept_when_delivery_fails(spark, tmp_path):
    src = tmp_path / "logs"
    src.mkdir()
    (src / "1.log").write_text('{"level":"info","message":"m","taskId":"7"}\n\n  \n')
    got, broken = [], [True]

    def deliver(batch, batch_id):
        if broken[0]:
            raise RuntimeError("unreachable")
        got.extend(batch.collect())

    def run():
        flows.stream_log_batches(spark, str(src), str(tmp_path / "ckpt"), deliver, interval=None).awaitTermination()

    with pytest.raises(Exception):
        run()
    broken[0] = False
    run()
    assert [(r.level, r.message, r.fields) for r in got] == [("info", "m", {"taskId": "7"})]


def test_progress_observation(spark, records):
    from recordloom.plans.import_plan import convert_records

    df, seen = flows.with_progress(convert_records(records(['{"id":1}', '{"id":"x"}']), ImportSpec({"id": "int"})))
    df.count()
    assert seen.get == {"seen": 2, "skipped": 1, "lines": 2}


def test_hot_key_is_combined_before_the_shuffle(spark):
    """A key with most of the rows leaves one row per task for the exchange."""
    incoming = spark.range(0, 4000, numPartitions=8).select(
        F.when(F.col("id") % 4 == 0, F.col("id")).otherwise(7).alias("k"), F.col("id").alias("v"), F.col("id").alias("seq"))
    target = spark.createDataFrame([(7, -1), (8, -2)], "k bigint, v bigint")
    merged = {r.k: r.v for r in conflicts.merge_frames(target, incoming, ["k"], "overwrite", "seq").collect()}
    assert merged[7] == 3999 and merged[8] == 8 and len(merged) == 1001
    plan = conflicts.merge_frames(target, incoming, ["k"], "skip", "seq")._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan
    # The target is neither sorted nor shuffled for a few incoming rows.
    wide = spark.range(0, 100_000, numPartitions=8).select(F.col("id").alias("k"), F.col("id").alias("v"))
    few = spark.createDataFrame([(7, 1, 0), (7, 2, 1)], "k bigint, v bigint, seq bigint")
    frame = conflicts.merge_frames(wide, few, ["k"], "update", "seq")
    frame.count()
    final = frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert frame.filter("k = 7").head().v == 2 and frame.count() == 100_000
    assert "BroadcastHashJoin" in final or "SortMergeJoin" in final


def test_null_keys_and_target_repeats_survive(spark):
    target = spark.createDataFrame([(None, "a"), (1, "b"), (1, "c")], "k bigint, v string")
    incoming = spark.createDataFrame([(None, "x", 0), (None, "y", 1), (1, "n", 2), (2, "z", 3)], "k bigint, v string, seq bigint")
    got = {p: sorted(map(tuple, conflicts.merge_frames(target, incoming, ["k"], p, "seq").collect()), key=str) for p in ("skip", "update", "overwrite")}
    free = [(None, "a"), (None, "x"), (None, "y")]
    assert got["skip"] == sorted([*free, (1, "b"), (1, "c"), (2, "z")], key=str)
    assert got["update"] == got["overwrite"] == sorted([*free, (1, "n"), (1, "n"), (2, "z")], key=str)
    assert sorted(map(tuple, conflicts.rows_to_append(target, incoming, ["k"], "seq").collect()), key=str) == [(2, "z"), (None, "x"), (None, "y")]
    for policy in conflicts.POLICIES:
        with pytest.raises(conflicts.UnknownColumns):
            conflicts.merge_frames(target, incoming.withColumn("w", F.lit(1)), ["k"], policy, "seq")


def test_misfits_are_never_stored_as_null(spark):
    from recordloom.sinks import tables as sinks

    spark.sql("CREATE TABLE misfits_t (a BIGINT, b INT) USING parquet")
    rows = spark.createDataFrame([("12x", "7"), ("5", "99999999999"), ("3.7", "1"), ("8", None), ("9", "2")], "a string, b string")
    with pytest.raises(Exception, match="do not fit"):
        sinks.metastore_append(rows, "misfits_t")
    sinks.metastore_append(rows, "misfits_t", misfits="skip")
    assert sorted(map(tuple, spark.table("misfits_t").collect())) == [(8, None), (9, 2)]
    assert {r.error for r in sinks.append_misfits(rows, "misfits_t").collect()} == {"values that do not fit: a", "values that do not fit: b"}
    spark.sql("DROP TABLE misfits_t")


def test_inference_shuffles_long_buffers_only(spark, records):
    from recordloom.operators import infer

    plan = infer.infer_schema(records(['{"a":1}']))._jdf.queryExecution().executedPlan().toString()
    first = [line for line in plan.splitlines() if "partial_count(1)" in line][0]
    assert "HashAggregate" in first and "SortAggregate" not in first


def test_registry_is_complete():
    import __spark_entry__ as entry
    from recordloom.plans import ORACLES, QUERIES

    assert set(ORACLES) == set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())

def test_levels_have_no_bound(spark):
    n = 40
    tasks = spark.createDataFrame([(str(i), [str(i - 1)] if i else [], i) for i in range(n)], "id string, depends_on array<string>, seq long")
    assert {r.id: r.level for r in runlog.dependency_order(tasks).collect()} == {str(i): i for i in range(n)}


def test_the_task_that_writes_one_file_does_not_sort(spark, monkeypatch, tmp_path):
    from recordloom.plans import queries_tables

    spark.range(6000).select(F.expr("id AS o_orderkey"), F.lit("x").alias("o_clerk")).repartition(5).write.parquet(str(tmp_path / "orders.parquet"))
    plans = []
    put = queries_tables.out.write_lines
    monkeypatch.setattr(queries_tables.out, "write_lines", lambda df, path: plans.append(df._jdf.queryExecution().executedPlan().toString()) or put(df, path))
    found = queries_tables.resume_files(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found)) == [(i, i + 1) for i in range(4321, 6000)]
    assert len(plans) == 1 and "Sort" not in plans[0] and "Exchange" not in plans[0]
