"""The import: records to a typed frame plus dead letters, in one narrow plan."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from recordloom.functions.convert import (
    FieldRule,
    Val,
    check_rules,
    convert_column,
    find_values,
    misfit_text,
    spark_type,
    type_values,
)
from recordloom.functions.engines import hive_value
from recordloom.functions.values import code_is_missing, kind_of
from recordloom.operators.project import missing_columns, require_columns
from recordloom.operators.quality import RowError, column_error, fail_fast, split_good, unknown_names
from recordloom.sources.lines import barrier
from recordloom.sources.records import META, read_first_records

#: Files that a task of a partitioned write may have open at a time; 0 sorts the rows instead.
OPEN_FILES_CONF = "spark.sql.maxConcurrentOutputFileWriters"


@dataclass(frozen=True)
class ImportSpec:
    """Target columns (name to type), selection and rules of one import."""

    targets: dict[str, str]
    selected: list[str] | None = None
    rules: list[FieldRule] = field(default_factory=list)
    typed: bool = True
    metastore: bool = False

    def sources(self) -> dict[str, tuple[str, FieldRule | None]]:
        """Output column to the record key and the rule that feed it."""
        check_rules(self.rules)
        by_source = {r.source: r for r in self.rules}
        unknown = [r.output for r in self.rules if r.strategy != "skip" and r.output not in self.targets]
        if unknown:
            raise ValueError(f"converted columns the target lacks: {', '.join(unknown)}")
        keep = set(self.selected) if self.selected else None
        feeds: dict[str, tuple[str, FieldRule | None]] = {}
        for name in self.targets:
            if name not in by_source and (keep is None or name in keep):
                feeds[name] = (name, None)
        for rule in self.rules:
            if rule.strategy != "skip" and (keep is None or rule.source in keep):
                feeds[rule.output] = (rule.source, rule)
        return {name: feeds[name] for name in self.targets if name in feeds}


def _record_checks(records: DataFrame, spec: ImportSpec, present: Column) -> DataFrame:
    """Set ``error`` on records with unknown keys or without the keys of a rule.

    ``present`` counts the wanted keys a record has.  Where that is all of its
    keys, none is unknown and the names are not looked at.
    """
    known = list(dict.fromkeys([*spec.targets, *[r.source for r in spec.rules]]))
    suspicious = F.when(F.size("rec") != present, F.col("rec"))
    extra = unknown_names(known, suspicious)
    found = F.when(F.size(extra) > 0, column_error("has columns the target lacks", extra))
    error = F.coalesce(F.col("error"), found)
    needed = [r.source for r in spec.rules]
    if needed:
        absent = missing_columns(needed)
        error = F.coalesce(
            error, F.when(F.size(absent) > 0, column_error("lacks columns to convert", absent))
        )
    return records.withColumn("error", error)


def _value(spec: ImportSpec, column: str, source: Val, rule: FieldRule | None) -> Val:
    target = spec.targets[column]
    val = convert_column(source, column, rule, target)
    if not spec.metastore:
        return val
    same = val.col is source.col
    stored = hive_value(
        val.as_variant(), target, column, source.k if same else None, source.t if same else None
    )
    error = stored.error_or_null()
    return Val(stored.col, "text", error if val.error is None else F.coalesce(val.error, error))


def convert_records(records: DataFrame, spec: ImportSpec, presence: str | None = None) -> DataFrame:
    """Canonical records to ``META + columns + error + error_column``.

    ``presence`` names one more column: the output columns whose key the record has, which tells an absent value from a null one.

    Staged projections, each value computed once: the dynamic values, their type
    codes and texts, the typed outputs, and the message of the first failure,
    which only rows that lost a value ever compute.
    """
    feeds = spec.sources()
    # A missing selected column stops the import even when bad rows are skipped.
    checked = require_columns(records, spec.selected, raising=True)
    keys = list(dict.fromkeys(source for source, _ in feeds.values()))
    looked = find_values(checked, keys, [*META, "error", "rec"])
    present = sum((F.col(f"v{i}").isNotNull().cast("int") for i in range(len(keys))), F.lit(0))
    meta = list(META)
    if presence is not None:
        at = {k: i for i, k in enumerate(keys)}
        there = F.array_compact(F.array(*[F.when(F.col(f"v{at[source]}").isNotNull(), F.lit(c)) for c, (source, _) in feeds.items()]))
        looked, meta = looked.withColumn(presence, there), [*META, presence]
    staged, found = type_values(_record_checks(looked, spec, present).drop("rec"), keys)
    codes = [found[source].k for source, _ in feeds.values()]

    outputs, lost = {}, None
    plain = [c for c, (_, rule) in feeds.items() if rule is None and not spec.metastore]
    special = {}
    for i, (column, (source, rule)) in enumerate(feeds.items()):
        val = _value(spec, column, found[source], rule)
        outputs[f"c{i}"] = val.as_type(spark_type(spec.targets[column]) if spec.typed else "string")
        gone = ~code_is_missing(codes[i]) & F.col(f"c{i}").isNull()
        lost = F.when(gone, F.lit(i)) if lost is None else lost.when(gone, F.lit(i))
        if column not in plain:
            special[i] = val
    # Only what the messages need stays next to the outputs.
    kept = staged.columns if special else [*meta, "error", *[f"k{i}" for i in range(len(keys))]]
    staged = staged.select(*kept, *[c.alias(n) for n, c in outputs.items()])
    staged = staged.withColumn("lost", F.when(F.col("error").isNull(), lost))

    def by_column(texts: list[str]) -> Column:
        return F.try_element_at(F.array(*[F.lit(t) for t in texts]), F.col("lost") + 1)

    names = list(feeds)
    found = F.try_element_at(F.array(*codes), F.col("lost") + 1)
    message = F.concat(
        F.lit("column "), by_column(names), F.lit(": "), F.coalesce(kind_of(found), F.lit("unknown")),
        F.lit(" -> "), by_column([spec.targets[c] for c in names]), F.lit(": "),
        by_column([misfit_text(spec.targets[c]) for c in names]),
    )
    if special:
        own = None
        for i, val in special.items():
            text = val.error_or_null()
            own = F.when(F.col("lost") == i, text) if own is None else own.when(F.col("lost") == i, text)
        message = F.coalesce(own, message)
    text = F.when(
        F.col("lost").isNotNull(),
        F.concat(F.lit("line "), F.col("line_no").cast("string"), F.lit(", "), message),
    )
    result = staged.select(
        *meta,
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(names)],
        F.coalesce(F.col("error"), text).alias("error"),
        F.when(F.col("lost").isNotNull(), by_column(names)).alias("error_column"),
    )
    return barrier(result, *names, "error", "error_column")


def run_import(records: DataFrame, spec: ImportSpec, mode: str = "skip") -> tuple[DataFrame, DataFrame]:
    """Good typed rows and dead letters; ``mode='fail'`` raises on the first bad row."""
    converted = convert_records(records, spec)
    if mode == "fail":
        converted = fail_fast(converted)
    elif mode != "skip":
        raise ValueError(f"unknown mode: {mode}")
    return split_good(converted)


def import_once(records: DataFrame, spec: ImportSpec, path: str, mode: str = "skip", presence: str | None = None) -> tuple[DataFrame, DataFrame, dict]:
    """Convert once, into ``path``: ``(good, dead_letters, counts)``, the frames read back from there.

    One write divides the rows by outcome and counts them on the way: ``rows``, ``skipped``, ``lines``.  Under ``mode='fail'`` the
    first bad row, found by the same pass, is raised once it is known; nothing outside ``path`` has been written then.
    """
    if mode not in ("skip", "fail"):
        raise ValueError(f"unknown mode: {mode}")
    converted = convert_records(records, spec, presence)
    bad = F.col("error").isNotNull()
    seen = Observation()
    counted = converted.observe(
        seen, F.count_if(~bad).alias("rows"), F.count_if(bad).alias("skipped"), F.max("line_no").alias("lines"),
        F.min(F.when(bad, F.struct(*META, "error"))).alias("first"),
    )
    _write_outcomes(counted.withColumn("outcome", F.when(bad, "dead").otherwise("good")), path)
    counts = dict(seen.get)
    first = counts.pop("first")
    if mode == "fail" and first is not None:
        raise RowError(first["error"])
    stored = records.sparkSession.read.schema(f"{_ddl(converted)}, outcome string").parquet(path)
    good, _ = split_good(stored.filter("outcome = 'good'").drop("outcome"))
    _, dead = split_good(stored.filter("outcome = 'dead'").drop("outcome"))
    return good, dead, counts


def _write_outcomes(rows: DataFrame, path: str) -> None:
    """One folder an outcome.  With a file open for each of the two, a task need not sort its rows by outcome first."""
    conf = rows.sparkSession.conf
    before = conf.get(OPEN_FILES_CONF)
    conf.set(OPEN_FILES_CONF, str(max(2, int(before))))
    try:
        rows.write.partitionBy("outcome").parquet(path)
    finally:
        conf.set(OPEN_FILES_CONF, before)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def cast_dry_run(records: DataFrame, spec: ImportSpec, n: int = 20) -> DataFrame:
    """What the import would make of the first ``n`` records; nothing is written."""
    sample = records.orderBy(*META).limit(n)
    return convert_records(sample, spec)


def cast_dry_run_files(spark: SparkSession, paths: str | list[str], spec: ImportSpec, n: int = 20) -> DataFrame:
    """The same for the first ``n`` good records of some files, of which only the beginning is read; bad lines before them are in it."""
    good, bad, _ = read_first_records(spark, paths, n)
    return convert_records(good.unionByName(bad), spec)
