"""Templates to job rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions.names import (
    built_in_variables,
    constant_map,
    merge_maps,
    render_template,
    variables_map,
)

# Task type of an engine and an action.
TASK_TYPES = {
    ("pgmigrator", "export"): "postgres-export",
    ("pgmigrator", "import"): "postgres-import",
    ("esmigrator", "export"): "elasticsearch-export",
    ("esmigrator", "import"): "elasticsearch-import",
    ("mysqlmigrator", "export"): "mysql-export",
    ("mysqlmigrator", "import"): "mysql-import",
    ("sqlitemigrator", "export"): "sqlite-export",
    ("hivemigrator", "export"): "hive-export",
    ("hivemigrator", "import"): "hive-import",
    ("neo4jmigrator", "export"): "neo4j-export",
    ("accessmigrator", "export"): "access-export",
}


def task_type(engine: Column, action: Column, config: Column | None = None) -> Column:
    """Task type of a step; a ``type`` in its configuration counts more."""
    pairs = {f"{e}/{a}": t for (e, a), t in TASK_TYPES.items()}
    mapped = F.try_element_at(constant_map(pairs), F.concat(engine, F.lit("/"), action))
    if config is None:
        return mapped
    named = F.try_variant_get(F.try_parse_json(config), "$.type", "variant")
    explicit = F.when(F.schema_of_variant(named) == "STRING", F.try_variant_get(named, "$", "string"))
    return F.coalesce(explicit, mapped)


def step_variables(template_vars: Column, user: dict[str, str] | Column, step_vars: Column, now: datetime) -> Column:
    """Built-in, template, user and step variables; a later one wins."""
    given = constant_map(user) if isinstance(user, dict) else user
    return merge_maps(
        constant_map(built_in_variables(now)), variables_map(template_vars), given, variables_map(step_vars)
    )


def expand_steps(templates: DataFrame, user: dict[str, str], now: datetime, run_id: Column) -> DataFrame:
    """One job row per step, in order, each depending on the one before.

    ``templates(template_id, name, engine, action, config_json, variables, steps)``
    with ``steps ARRAY<STRUCT<name, engine, action, config_json, variables>>``; a
    template without steps is one step of its own.  Task ids are derived from
    run and step, so the dependency is known without a window.
    """
    own = F.array(
        F.struct(
            F.lit(None).cast("string").alias("name"), "engine", "action", "config_json",
            F.lit(None).cast("array<struct<name:string,default_value:string>>").alias("variables"),
        )
    )
    steps = F.when(F.coalesce(F.size("steps"), F.lit(0)) > 0, F.col("steps")).otherwise(own)
    each = templates.select(
        "template_id",
        F.col("name").alias("template_name"),
        F.col("variables").alias("template_vars"),
        run_id.alias("run_id"),
        F.size(steps).alias("step_count"),
        F.posexplode(steps).alias("pos", "step"),
    )
    index = F.col("pos") + 1
    task_id = lambda n: F.concat(F.col("run_id"), F.lit("-"), n.cast("string"))
    variables = step_variables(F.col("template_vars"), user, F.col("step.variables"), now)
    rendered = render_template(F.col("step.config_json"), variables)
    staged = each.withColumn("config", rendered)
    return staged.select(
        task_id(index).alias("task_id"),
        task_type(F.col("step.engine"), F.col("step.action"), F.col("config")).alias("type"),
        F.when(F.col("pos") > 0, F.array(task_id(F.col("pos")))).otherwise(F.array().cast("array<string>")).alias("depends_on"),
        "run_id",
        "template_id",
        "template_name",
        index.alias("step_index"),
        "step_count",
        F.col("step.name").alias("step_name"),
        F.col("config").alias("config_json"),
    )
