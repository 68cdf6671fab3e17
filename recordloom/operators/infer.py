"""Schema inference over all records: types, nullability, presence, column order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions.values import (
    ISO_DATE,
    ISO_DATE_TIME_PREFIX,
    MAX_SAFE_INTEGER,
    as_text,
    code,
    staged_text,
)
from recordloom.operators.ordinal import with_ordinal
from recordloom.operators.project import place
from recordloom.operators.quality import fail_fast
from recordloom.session import cut_lineage
from recordloom.sources.records import META, read_first_records

# The logical types; the three numeric ones widen in this order.
LOGICAL_TYPES = ("boolean", "integer", "bigint", "number", "datetime", "string", "json")
NUMERIC_ORDER = ("integer", "bigint", "number")
SAFE_DIGITS = len(str(MAX_SAFE_INTEGER))
#: Lines and positions below these bits make one number of 63 bits.
LINE_BITS, POS_BITS = 42, 21
DEFAULT_SAMPLE = 1000
MAX_SAMPLE = 100_000


def infer_value_type(v: Column, k: Column | None = None, t: Column | None = None, label: Callable[[str], Column] = F.lit) -> Column:
    """Logical type of one value, or what ``label`` makes of it; NULL for null and absent ones."""
    k = code(v) if k is None else k
    t = as_text(v) if t is None else t
    number = t.try_cast("double")
    whole = number == F.rint(number)
    safe = F.abs(number) <= MAX_SAFE_INTEGER
    dated = (F.length(t) >= 10) & (F.substring(t, 5, 1) == "-") & (t.rlike(ISO_DATE_TIME_PREFIX) | t.rlike(ISO_DATE))
    integer, bigint = label("integer"), label("bigint")
    return (
        F.when(k == "STR", F.when(dated, label("datetime")).otherwise(label("string")))
        # Most integers are too short to be unsafe, and need no conversion.
        .when(k == "BIG", F.when((F.length(t) < SAFE_DIGITS) | safe, integer).otherwise(bigint))
        .when(
            k.isin("DEC", "DOU", "FLO"),
            F.when(~whole, label("number")).when(safe, integer).otherwise(bigint),
        )
        .when(k == "BOO", label("boolean"))
        .when(k.isin("ARR", "OBJ"), label("json"))
    )


def _rank(name: Column) -> Column:
    """Position in :data:`LOGICAL_TYPES`, one-based; NULL for no type."""
    return F.nullif(F.array_position(F.array(*[F.lit(x) for x in LOGICAL_TYPES]), name), F.lit(0))


def merged_type(lowest: Column, highest: Column) -> Column:
    """Merge of a set of ranks from its smallest and largest member.

    Equal bounds mean one type.  The numeric types are neighbours in the order,
    so bounds inside them mean a numeric mix, which widens to the largest; any
    other mix is text.  Bounds merge in any order, so partial results do too.
    """
    numeric = [LOGICAL_TYPES.index(n) + 1 for n in NUMERIC_ORDER]
    name = F.try_element_at(F.array(*[F.lit(x) for x in LOGICAL_TYPES]), highest.cast("int"))
    return (
        F.when(lowest.isNull(), "string")
        .when(lowest == highest, name)
        .when(lowest.isin(*numeric) & highest.isin(*numeric), name)
        .otherwise("string")
    )


def merge_types(left: Column, right: Column) -> Column:
    """The type two values have in common."""
    a, b = _rank(left), _rank(right)
    return merged_type(F.least(a, b), F.greatest(a, b))


def infer_schema(records: DataFrame) -> DataFrame:
    """``(ordinal, name, logical_type, nullable, present)`` of the good records.

    One pass, made at once.  Records become one short row per key; the aggregation per key
    and file runs inside each task first and keeps only long buffers, so the
    shuffle carries a few rows per task however many records there are, and a
    key that every record has is no hot spot.
    """
    good = records.filter(F.col("rec").isNotNull())
    # Entry number 0 stands for the record itself: its count is the number of records.
    itself = F.array(F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast("variant").alias("value")))
    cells = good.select(
        "file", "line_no", F.posexplode(F.concat(itself, F.map_entries("rec"))).alias("pos", "e")
    ).select("file", "line_no", "pos", F.col("e.key").alias("name"), F.col("e.value").alias("v"))
    coded = cells.select("*", code(F.col("v")).alias("k"), F.to_json("v").alias("j"))
    text = staged_text(F.col("v"), F.col("k"), F.col("j"))
    typed = coded.select("file", "line_no", "pos", "name", "k", text.alias("t"))
    rank = infer_value_type(None, F.col("k"), F.col("t"), lambda name: F.lit(LOGICAL_TYPES.index(name) + 1).cast("bigint"))
    # Places are long integers but for those that do not fit.
    near = F.col("line_no").between(0, (1 << LINE_BITS) - 1) & (F.col("pos") < 1 << POS_BITS)
    ranked = typed.select(
        "file",
        F.when(F.col("pos") > 0, F.col("name")).alias("name"),
        rank.alias("rank"),
        F.when(near, F.col("line_no") * F.lit(1 << POS_BITS) + F.col("pos")).alias("near"),
        F.when(~near, place(F.col("line_no"), F.col("pos"))).alias("far"),
    )
    per_file = ranked.groupBy("name", "file").agg(
        F.count(F.lit(1)).alias("present"),
        F.count("rank").alias("typed"),
        F.min("rank").alias("lo"),
        F.max("rank").alias("hi"),
        F.min("near").alias("near"),
        F.min("far").alias("far"),
    )
    nearest = place(F.shiftright("near", POS_BITS), F.col("near").bitwiseAND(F.lit((1 << POS_BITS) - 1)))
    per_file = per_file.withColumn("at", F.least(nearest, "far"))
    per_name = per_file.groupBy("name").agg(
        F.sum("present").alias("present"),
        F.sum("typed").alias("typed"),
        F.min("lo").alias("lo"),
        F.max("hi").alias("hi"),
        F.min(F.struct("file", "at")).alias("first"),
    )
    # One row per column, which may be as many as records where keys are data: they are numbered range by range.  The number of
    # records, which is the count of the entry without a name, is a single row.
    per_name = cut_lineage(per_name)
    whole = per_name.filter("name IS NULL").head()
    ranked = with_ordinal(per_name.filter("name IS NOT NULL"), ["first", "name"], "ordinal").withColumn("ordinal", F.col("ordinal").cast("int"))
    return ranked.select(
        "ordinal",
        "name",
        merged_type(F.col("lo"), F.col("hi")).alias("logical_type"),
        ((F.col("typed") < F.col("present")) | (F.col("present") < F.lit(whole["present"] if whole else 0))).alias("nullable"),
        "present",
    )


def infer_with_errors(records: DataFrame, mode: str = "skip") -> tuple[DataFrame, DataFrame]:
    """The columns of the good records, and the bad ones as ``(file, line_no, row_idx, error)``; ``mode='fail'`` raises the first of these."""
    if mode not in ("skip", "fail"):
        raise ValueError(f"unknown mode: {mode}")
    if mode == "fail":
        fail_fast(records)
    return infer_schema(records), records.filter(F.col("error").isNotNull()).select(*META, "error")


def sample_records(records: DataFrame, n: int | None = DEFAULT_SAMPLE) -> DataFrame:
    """The first ``n`` good records in file order (a bounded top-n, no full sort); ``None`` takes all."""
    good = records.filter(F.col("rec").isNotNull())
    if n is None:
        return good
    if not 1 <= n <= MAX_SAMPLE:
        raise ValueError(f"a sample has 1 to {MAX_SAMPLE} records; None takes all")
    return good.orderBy(*META).limit(n)


def infer_schema_sample(records: DataFrame, n: int | None = DEFAULT_SAMPLE) -> DataFrame:
    return infer_schema(sample_records(records, n))


def infer_schema_files(spark: SparkSession, paths: str | list[str], n: int = DEFAULT_SAMPLE) -> tuple[DataFrame, DataFrame]:
    """The columns of the first ``n`` good records of some files, and the bad lines among them; the rest is not read.

    Lines are bounded as well: twice the records, at least 200 and at most 40 000.
    """
    if not 1 <= n <= MAX_SAMPLE:
        raise ValueError(f"a sample has 1 to {MAX_SAMPLE} records")
    good, bad, _ = read_first_records(spark, paths, n, most_lines=max(200, min(2 * n, 40_000)))
    return infer_schema(good), bad.select(*META, "error")


def document_bodies(records: DataFrame) -> DataFrame:
    """Records of a search target: the body where ``_source`` is an object, else the record."""
    body = F.try_variant_get(F.try_element_at("rec", F.lit("_source")), "$", "map<string,variant>")
    return records.withColumn("rec", F.coalesce(body, F.col("rec")))


def infer_schema_hits(records: DataFrame) -> DataFrame:
    return infer_schema(document_bodies(records))
