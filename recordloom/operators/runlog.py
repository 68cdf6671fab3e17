"""Run-log analytics over the task table."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.operators.ordinal import with_ordinal
from recordloom.session import cut_lineage, scratch

TEMPLATE = "struct<runId:variant,templateId:variant,templateName:variant,stepIndex:variant,stepCount:variant,stepName:variant>"
DEFAULT_TEMPLATE_NAME = "dependency group"


def _text_of(v: Column) -> Column:
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _int_of(v: Column) -> Column:
    numeric = F.substring(F.schema_of_variant(v), 1, 3).isin("BIG", "DEC", "DOU")
    return F.when(numeric, F.try_variant_get(v, "$", "int"))


def parse_task_log(tasks: DataFrame) -> DataFrame:
    """Typed columns for the JSON texts of the task table.

    Text that is no JSON, or JSON of another shape, gives NULL for its column
    and never fails the row.  Empty texts are NULL.
    """
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    deps = F.from_json(blank("depends_on"), "array<variant>")
    dep_texts = F.transform(deps, _text_of)
    meta = F.from_json(blank("template_meta"), TEMPLATE)
    complete = (
        _text_of(meta["runId"]).isNotNull()
        & _text_of(meta["templateId"]).isNotNull()
        & _text_of(meta["templateName"]).isNotNull()
        & _int_of(meta["stepIndex"]).isNotNull()
        & _int_of(meta["stepCount"]).isNotNull()
    )
    template = F.struct(
        _text_of(meta["runId"]).alias("run_id"),
        _text_of(meta["templateId"]).alias("template_id"),
        _text_of(meta["templateName"]).alias("template_name"),
        _int_of(meta["stepIndex"]).alias("step_index"),
        _int_of(meta["stepCount"]).alias("step_count"),
        _text_of(meta["stepName"]).alias("step_name"),
    )
    return tasks.select(
        "id",
        "type",
        "status",
        F.try_parse_json(blank("payload")).alias("payload"),
        F.when(F.forall(dep_texts, lambda d: d.isNotNull()), dep_texts).alias("depends_on"),
        F.when(complete, template).alias("template"),
        F.coalesce(F.col("progress"), F.lit(0)).alias("progress"),
        F.try_parse_json(blank("cursor")).alias("cursor"),
        blank("error").alias("error"),
        "created_at",
        blank("started_at").alias("started_at"),
        blank("finished_at").alias("finished_at"),
    )


def aggregate_results(results: DataFrame) -> DataFrame:
    """Totals over task results ``(status, rows, duration_ms)``.

    The list of results is the input frame itself; it is not packed into a row.
    """
    return results.agg(
        F.count(F.lit(1)).alias("tasks"),
        F.count_if(F.col("status") == "completed").alias("completed"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status") == "canceled").alias("canceled"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("duration_ms"),
    )


def step_status(steps: DataFrame, run: str = "run_id") -> DataFrame:
    """``steps(run, step_index, atom, ok)`` with the status each step ends in.

    A step without an atom fails wherever it stands; of the others, all behind
    the first failure are skipped.  The first failure is an aggregate per run
    and is joined back, so a run of any length needs no ordered window.
    """
    malformed = F.col("atom").isNull()
    fails = malformed | ~F.coalesce(F.col("ok"), F.lit(False))
    first = steps.groupBy(run).agg(F.min(F.when(fails, F.col("step_index"))).alias("_first"))
    behind = F.coalesce(F.col("step_index") > F.col("_first"), F.lit(False))
    status = (
        F.when(malformed, "failed").when(behind, "skipped").when(fails, "failed").otherwise("completed")
    )
    return steps.join(first, run).withColumn("status", status).drop("_first")


def step_summary(steps: DataFrame, run: str = "run_id") -> DataFrame:
    done = step_status(steps, run)
    return done.groupBy(run).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "completed").alias("completed"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
    )


def group_runs(tasks: DataFrame, group: str = "group_key") -> DataFrame:
    """Tasks in group order with their position, one row per task.

    Groups come by their latest creation, newest first, then by key; inside a
    group tasks come by step, creation and id.  Positions are taken from the
    global order, so the tasks of a large group stay spread over many tasks.
    """
    stats = tasks.groupBy(group).agg(
        F.max("created_at").alias("latest"),
        F.count(F.lit(1)).alias("task_count"),
        F.count_if(F.col("status") == "completed").alias("completed_count"),
    )
    order = [F.col("latest").desc(), F.col(group), F.col("step_index"), F.col("created_at"), F.col("id")]
    placed = with_ordinal(tasks.join(stats, group), order, "_ord")
    start = placed.groupBy(group).agg(F.min("_ord").alias("_start"))
    return placed.join(start, group).select(
        *[c for c in placed.columns if c != "_ord"],
        (F.col("_ord") - F.col("_start") + 1).alias("position"),
        F.col("_ord").alias("global_position"),
    )


# --- graphs over depends_on ---------------------------------------------------

def dependency_edges(tasks: DataFrame) -> DataFrame:
    """``(id, dep)`` for dependencies on tasks that are part of the set."""
    raw = tasks.select("id", F.explode("depends_on").alias("dep")).distinct()
    return raw.join(tasks.select(F.col("id").alias("dep")), "dep", "left_semi").select("id", "dep")


def _same(a: DataFrame, b: DataFrame) -> bool:
    """Whether two edge sets without repeats are equal, from order-free sums."""

    def mark(df: DataFrame) -> tuple:
        h = F.xxhash64("u", "v").cast("decimal(38,0)")
        g = F.hash("v", "u").cast("decimal(38,0)")
        return tuple(df.agg(F.count(F.lit(1)), F.sum(h), F.sum(g)).head())

    return mark(a) == mark(b)


def connected_components(edges: DataFrame) -> DataFrame:
    """``(id, root)``: the smallest id reachable from each node of ``edges(u, v)``.

    Alternating star contraction: every node points its larger neighbours at the
    smallest one, then its smaller ones.  The number of rounds grows with the
    logarithm of the longest chain, where plain label spreading needs its
    length.  The minimum per node is a partial aggregate joined back to the
    edges, so a hub is combined before the shuffle and never collected.
    """
    current = cut_lineage(
        edges.filter("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    while True:
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m"))
        lowest = lowest.select("u", F.least("u", "m").alias("m"))
        large = (
            both.filter("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(smallest, "u")
        small = (
            joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(smallest.select("u", F.col("m").alias("v")))
            .filter("u <> v")
            .distinct()
        )
        following = cut_lineage(small)
        if _same(current, following):
            return following.select(F.col("u").alias("id"), F.col("v").alias("root")).union(
                following.select(F.col("v"), F.col("v")).distinct()
            )
        current = following


def dependency_components(tasks: DataFrame) -> DataFrame:
    """``(id, component)`` over the dependency edges inside the set."""
    edges = dependency_edges(tasks).select(F.col("id").alias("u"), F.col("dep").alias("v"))
    roots = connected_components(edges)
    return tasks.select("id").join(roots, "id", "left").select(
        "id", F.coalesce("root", "id").alias("component")
    )


#: More than any path has tasks; the lengths of paths around a cycle stop growing here.
FAR = 1 << 60


def _written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: unlike a checkpoint it does not hand what the planner knew on to the next round."""
    path = scratch(df.sparkSession, "levels")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


#: Tasks with one path that the rounds of :func:`dependency_order` take as they are; more are contracted first.
FEW_SINGLE = 500_000


def _heads(name: str, turn: int) -> Column:
    return F.xxhash64(F.col(name), F.lit(turn)).bitwiseAND(F.lit(1)) == 1


def _contracted(edges: DataFrame, few: int) -> tuple[DataFrame, list[DataFrame]]:
    """``(paths(id, dep, far), turns)``: the edges with most tasks that have one path passed over.

    Each turn takes out tasks with one path, no two of which follow each other: by a coin per task, heads that lead to tails, or
    to a task that has not just one path.  Whoever led to one of them leads on to where it leads.  A turn takes a quarter or more, so all turns
    together move a few times the edges; ``turns`` holds what each took out, whose targets stay until a later turn.
    """
    ways = edges.groupBy("id").agg(F.count(F.lit(1)).alias("ways")).filter("ways = 1 AND id IS NOT NULL").select("id")
    ends = ways.select(F.col("id").alias("dep"), F.lit(True).alias("more"))
    paths = edges.join(ways.withColumn("one", F.lit(True)), "id", "left").join(ends, "dep", "left")
    paths = _written(paths.select("id", "dep", F.lit(1).cast("long").alias("far"), F.coalesce("one", F.lit(False)).alias("one"), F.coalesce("more", F.lit(False)).alias("more")))
    turns: list[DataFrame] = []
    while paths.filter("one AND id <> dep").count() > few:
        out = F.col("one") & _heads("id", len(turns)) & (~F.col("more") | ~_heads("dep", len(turns))) & (F.col("id") != F.col("dep"))
        taken = _written(paths.filter(out).drop("one"))
        passed = taken.toDF("dep", "to", "add", "ahead")
        stay = paths.filter(~out)
        led = stay.filter("more").join(passed, "dep", "left").select(
            "id", F.coalesce("to", "dep").alias("dep"), (F.col("far") + F.coalesce("add", F.lit(0))).alias("far"), "one", F.coalesce("ahead", "more").alias("more")
        )
        paths = _written(led.unionByName(stay.filter("NOT more")))
        turns.append(taken.select("id", "dep", "far"))
    if turns:
        paths = _written(paths.groupBy("id", "dep").agg(F.max("far").alias("far")))
    return paths.select("id", "dep", "far"), turns


def dependency_order(tasks: DataFrame, seq: str = "seq") -> DataFrame:
    """``(id, seq, level)``: a task's level is the length of the longest path to a task without dependencies.

    Sorting by ``(level, seq)`` puts dependencies first.  Tasks on or behind a
    cycle have no level.

    While more than ``FEW_SINGLE`` tasks have one path, they are taken out turn
    by turn (:func:`_contracted`); the rest gets its levels by
    :func:`_ordered`, and what was taken out follows, last turn first: a task's
    level is that of its target and the length of the path.
    """
    paths, turns = _contracted(dependency_edges(tasks), FEW_SINGLE)
    if not turns:
        return _ordered(tasks, paths, seq)
    gone = reduce(DataFrame.unionByName, turns).select("id")
    rest = _written(_ordered(tasks.join(gone, "id", "left_anti"), paths, seq))
    known = rest.select("id", "level").distinct()
    late: list[DataFrame] = []
    for turn in reversed(turns):
        at = known.toDF("dep", "level")
        late.append(_written(turn.join(at, "dep").select("id", (F.col("level") + F.col("far")).cast("int").alias("level"))))
        known = known.unionByName(late[-1])
    followed = reduce(DataFrame.unionByName, late)
    return rest.unionByName(tasks.select("id", seq).join(followed, "id").select("id", seq, "level"))


def _ordered(tasks: DataFrame, paths: DataFrame, seq: str) -> DataFrame:
    """``(id, seq, level)`` of tasks by paths ``(id, dep, far)`` between them.

    Every open task keeps a floor, below which its level cannot be, and paths to
    tasks that are open too.  Each round places the tasks without a path at
    their floor.  A task with just one path is passed by: whoever led to it
    leads on to where it leads, over a path as long as both.  So the stretch
    that a path covers doubles in every round, and chains and trees of any depth
    take a number of rounds that grows with the logarithm of it.  A level whose
    tasks all have several open paths costs one round.
    """
    waiting = tasks.select("id", seq, F.lit(0).cast("long").alias("floor"))
    placed, rounds = None, 0
    while True:
        # Target and length are only used where there is one path.
        leads = paths.groupBy("id").agg(
            F.count(F.lit(1)).alias("ways"), F.max("dep").alias("target"), F.max("far").alias("stretch")
        )
        state = _written(waiting.join(leads, "id", "left"))
        free = state.filter("ways IS NULL")
        if free.isEmpty():
            break
        here = free.select("id", seq, F.col("floor").cast("int").alias("level"))
        placed = here if placed is None else placed.union(here)
        # A task whose one path ends at a task placed just now is placed in the next round, hence not passed by.
        ends = free.select(F.col("id").alias("target"), F.lit(True).alias("ends")).distinct()
        at = state.join(ends, "target", "left").select(
            F.col("id").alias("dep"), F.col("floor").alias("below"), "ways", "target", "stretch", "ends"
        )
        single = (F.col("ways") == 1) & F.col("ends").isNull()
        moved = _written(
            paths.join(at, "dep").select(
                "id",
                F.least(F.col("below") + F.col("far"), F.lit(FAR)).alias("reach"),
                F.when(single, F.col("target")).when(F.col("ways") > 0, F.col("dep")).alias("dep"),
                F.when(single, F.least(F.col("far") + F.col("stretch"), F.lit(FAR))).otherwise(F.col("far")).alias("far"),
            )
        )
        raised = moved.groupBy("id").agg(F.max("reach").alias("reach"))
        waiting = state.filter("ways IS NOT NULL").join(raised, "id").select(
            "id", seq, F.greatest("floor", "reach").alias("floor")
        )
        paths = moved.filter("dep IS NOT NULL").groupBy("id", "dep").agg(F.max("far").alias("far"))
        rounds += 1
        if rounds % 16 == 0:
            # The plan stays short however many rounds there are.
            placed = _written(placed)
    rest = state.select("id", seq, F.lit(None).cast("int").alias("level"))
    return rest if placed is None else placed.union(rest)


def match_template(
    tasks: DataFrame, components: DataFrame, templates: DataFrame, default: str = DEFAULT_TEMPLATE_NAME
) -> DataFrame:
    """``(component, template_name)``: the template with the same list of types.

    ``tasks(id, type, level, seq)``, ``templates(template_no, name, step_types)``;
    of several equal templates the first counts.  Types are only collected for
    components that are not longer than the longest template, since no other
    can match; a huge component never becomes one row.
    """
    longest = templates.agg(F.coalesce(F.max(F.size("step_types")), F.lit(0))).head()[0]
    member = tasks.join(components, "id")
    sizes = member.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    short = sizes.filter(F.col("n") <= longest)
    lists = (
        member.join(short, "component")
        .groupBy("component")
        .agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct("level", "seq", "type"))), lambda s: s["type"]
            ).alias("step_types")
        )
    )
    first = templates.groupBy("step_types").agg(F.min_by("name", "template_no").alias("template_name"))
    named = lists.join(first, "step_types").select("component", "template_name")
    return sizes.join(named, "component", "left").select(
        "component", "n", F.coalesce("template_name", F.lit(default)).alias("template_name")
    )


def dependency_state(tasks: DataFrame) -> DataFrame:
    """``(id, state, blocked_by)`` of every queued task.

    The first dependency in list order that is not completed decides.  Which one
    that is does not change while failures spread, so each queued task follows
    exactly one other task and doubling the followed distance finds the end of
    every chain in a logarithmic number of rounds.  A task whose chain ends in a
    failed, canceled or unknown one is blocked.
    """
    deps = tasks.filter(F.col("status") == "queued").select("id", F.posexplode_outer("depends_on").alias("pos", "dep"))
    known = tasks.select(F.col("id").alias("dep"), F.col("status").alias("dep_status"))
    looked = deps.join(known, "dep", "left")
    unfinished = F.col("dep").isNotNull() & (F.coalesce("dep_status", F.lit("unknown")) != "completed")
    decisive = looked.groupBy("id").agg(
        F.min(
            F.when(unfinished, F.struct("pos", "dep", F.coalesce("dep_status", F.lit("unknown")).alias("s")))
        ).alias("d")
    )
    # end: where the chain leads so far; open while that task is queued itself.
    current = cut_lineage(
        decisive.select(
            "id",
            F.col("d.dep").alias("blocked_by"),
            F.when(F.col("d").isNull(), F.lit("ready"))
            .when(F.col("d.s").isin("failed", "canceled", "unknown"), "blocked")
            .when(F.col("d.s") != "queued", "waiting")
            .alias("state"),
            F.when(F.col("d.s") == "queued", F.col("d.dep")).alias("end"),
        )
    )
    # Each round doubles the distance that is followed: what is open after these rounds is a cycle.
    for _ in range(current.filter(F.col("state").isNull()).count().bit_length() + 1):
        if current.filter(F.col("state").isNull()).isEmpty():
            break
        target = current.select(
            F.col("id").alias("end"), F.col("state").alias("end_state"), F.col("end").alias("end_end")
        )
        joined = current.join(target, "end", "left")
        # Behind a ready or waiting task one has to wait, behind a blocked one not.
        state = F.coalesce(
            "state",
            F.when(F.col("end_state") == "blocked", "blocked").when(F.col("end_state").isNotNull(), "waiting"),
        )
        following = cut_lineage(
            joined.select("id", "blocked_by", state.alias("state"), F.when(state.isNull(), F.col("end_end")).alias("end"))
        )
        current = following
    # What never ends is a cycle: it waits for itself.
    state = F.coalesce("state", F.lit("waiting"))
    return current.select(
        "id", state.alias("state"), F.when(state == "blocked", F.col("blocked_by")).alias("blocked_by")
    )
