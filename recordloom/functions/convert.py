"""Column conversion rules and coercion to target types, compiled to expressions.

A rule and a target type are known when the plan is built, so only the branch
that applies becomes part of the plan.  What flows between the two steps is a
:class:`Val`: the expression, what is statically known about its kind, and the
message of the first failure (NULL when there is none).
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions.values import (
    NUMBER_TEXT,
    as_text,
    code,
    code_is_missing,
    code_is_nested,
    code_is_number,
    iso_millis,
    json_text,
    kind_of,
    millis_timestamp,
    staged_text,
    string_of,
    text_timestamp,
    value_number,
)

STRATEGIES = ("json", "cast", "stringify", "skip")


@dataclass(frozen=True)
class FieldRule:
    """How one source column is converted before it is coerced to its target."""

    source: str
    strategy: str
    source_type: str = ""
    target_type: str = ""
    target: str | None = None
    options: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.source.strip():
            raise ValueError("a rule needs a source column")
        if self.strategy not in STRATEGIES:
            raise ValueError(f"strategy must be one of {', '.join(STRATEGIES)}")
        if self.strategy == "cast" and not (self.source_type.strip() and self.target_type.strip()):
            raise ValueError("a cast needs a source type and a target type")

    @property
    def output(self) -> str:
        return self.target or self.source


def check_rules(rules: list[FieldRule]) -> list[FieldRule]:
    names = [r.source for r in rules]
    repeated = sorted({n for n in names if names.count(n) > 1})
    if repeated:
        raise ValueError(f"more than one rule for: {', '.join(repeated)}")
    return rules


# --- target families, by type name -----------------------------------------

def type_name(text: str | None) -> str:
    return re.sub(r"\s+", " ", (text or "").strip().lower())


# Type names of each family.
STRING_NAMES = ("string", "text", "character", "character varying")
STRING_STARTS = ("varchar", "char", "nvarchar")
SEARCH_STRING_NAMES = ("keyword", "wildcard")
INTEGER_PATTERN = r"(tinyint|smallint|mediumint|integer|bigint|int|int2|int4|int8)(\b|\()"
NUMERIC_STARTS = ("numeric", "decimal", "real", "money", "double", "float")
BOOLEAN_NAMES = ("boolean", "bool")
JSON_NAMES = ("json", "jsonb")


# The bits of sized integer types; unsigned types begin at 0.
INTEGER_BITS = {
    "tinyint": 8, "smallint": 16, "int2": 16, "mediumint": 24, "integer": 32, "int": 32, "int4": 32, "bigint": 64, "int8": 64,
}


def integer_range(target: str | None) -> tuple[int, int] | None:
    """Least and largest value of an integer type, None for any other; an unsigned bigint ends with the signed one."""
    found = re.match(INTEGER_PATTERN, type_name(target))
    if not found:
        return None
    bits = INTEGER_BITS[found[1]]
    if "unsigned" in type_name(target):
        return 0, min(2**bits, 2**63) - 1
    return -(2 ** (bits - 1)), 2 ** (bits - 1) - 1


def family(target: str | None) -> str:
    """``string, numeric, boolean, temporal, json`` or ``other``."""
    t = type_name(target)
    if t in STRING_NAMES or t.startswith(STRING_STARTS):
        return "string"
    if re.match(INTEGER_PATTERN, t) or t.startswith(NUMERIC_STARTS) or t == "number":
        return "numeric"
    if t in BOOLEAN_NAMES:
        return "boolean"
    if "timestamp" in t or t == "date" or "datetime" in t:
        return "temporal"
    return "json" if t in JSON_NAMES else "other"


def spark_type(target: str | None) -> str:
    """Spark type of a table column with the given target type name."""
    t = type_name(target)
    group = family(t)
    if group == "boolean":
        return "boolean"
    if group == "temporal":
        return "timestamp"
    if group == "numeric":
        sized = re.match(r"(numeric|decimal)\s*\((\d+)\s*(?:,\s*(\d+))?\s*\)", t)
        if sized:
            return f"decimal({sized[2]},{sized[3] or 0})"
        if t.startswith(("numeric", "decimal")):
            return "decimal(38,10)"
        return "bigint" if re.match(INTEGER_PATTERN, t) else "double"
    return "string"


# --- values between the steps ----------------------------------------------

@dataclass(frozen=True)
class Val:
    """``form`` is ``variant`` (dynamic), ``text``, ``bool`` or ``stamp`` (an instant).

    ``k`` is the type code of a dynamic value; callers that computed it before
    pass it in so that it is not looked up for every test; ``t`` likewise is its
    scalar text.  A value that failed
    is NULL, hence ``error`` only has to be looked at for rows whose input was
    there and whose output is not: good rows never pay for it.
    """

    col: Column
    form: str = "variant"
    error: Column | None = None
    k: Column | None = None
    t: Column | None = None

    @property
    def texts(self) -> Column:
        """Scalar text of a dynamic value, without number formatting."""
        return as_text(self.col) if self.t is None else self.t

    @property
    def codes(self) -> Column:
        return code(self.col) if self.k is None else self.k

    @property
    def missing(self) -> Column:
        return code_is_missing(self.codes) if self.form == "variant" else self.col.isNull()

    def as_variant(self) -> Column:
        if self.form == "variant":
            return self.col
        return (self.col if self.form == "bool" else self.as_text()).cast("variant")

    def as_text(self) -> Column:
        if self.form == "variant":
            return F.when(~self.missing, string_of(self.col, self.codes, self.t))
        return iso_millis(self.col) if self.form == "stamp" else self.col.cast("string")

    def as_type(self, ddl: str) -> Column:
        """Typed value of a table column; NULL when it does not fit."""
        if ddl == "string":
            return self.as_text()
        if self.form == "variant":
            # Casting the text is the fast way; other notations go through the variant.
            return F.coalesce(self.texts.try_cast(ddl), F.try_variant_get(self.col, "$", ddl))
        if self.form == "stamp" and ddl == "timestamp":
            return F.date_trunc("millisecond", self.col)
        if self.form == "bool":
            return self.col if ddl == "boolean" else self.col.cast("int").cast(ddl)
        return self.as_text().try_cast(ddl)

    def error_or_null(self) -> Column:
        return F.lit(None).cast("string") if self.error is None else self.error

    def failing(self, failed: Column, message: str | Column) -> "Val":
        """The same value with one more possible failure after the known ones."""
        text = F.lit(message) if isinstance(message, str) else message
        own = F.when(failed, text)
        both = own if self.error is None else F.coalesce(self.error, own)
        return Val(self.col, self.form, both, self.k, self.t)


def find_values(records: DataFrame, keys: list[str], keep: list[str]) -> DataFrame:
    """``keep`` plus the value of each of ``keys`` as a column ``v0, v1, ...``."""
    found = [F.try_element_at("rec", F.lit(k)).alias(f"v{i}") for i, k in enumerate(keys)]
    return records.select(*keep, *found)


def type_values(found: DataFrame, keys: list[str]) -> tuple[DataFrame, dict[str, Val]]:
    """Codes and texts of found values; conversions then refer to finished columns."""
    at = range(len(keys))
    typed = found.select(
        "*",
        *[code(F.col(f"v{i}")).alias(f"k{i}") for i in at],
        *[json_text(F.col(f"v{i}")).alias(f"j{i}") for i in at],
    )
    staged = typed.select(
        *found.columns,
        *[f"k{i}" for i in at],
        *[staged_text(F.col(f"v{i}"), F.col(f"k{i}"), F.col(f"j{i}")).alias(f"t{i}") for i in at],
    )
    return staged, {k: Val(F.col(f"v{i}"), k=F.col(f"k{i}"), t=F.col(f"t{i}")) for i, k in enumerate(keys)}


def with_values(records: DataFrame, keys: list[str], keep: list[str]) -> tuple[DataFrame, dict[str, Val]]:
    return type_values(find_values(records, keys, keep), keys)


def failure_text(column: str, source: str | Column, target: str, detail: str) -> Column:
    label = F.lit(source or "unknown") if isinstance(source, str) else source
    return F.concat(F.lit(f"column {column}: "), label, F.lit(f" -> {target or 'unknown'}: {detail}"))


# --- conversion strategies ---------------------------------------------------

def _cast(val: Val, rule: FieldRule) -> Val:
    v, there = val.col, ~val.missing
    src, dst = type_name(rule.source_type), type_name(rule.target_type)
    fail = lambda what: failure_text(rule.source, rule.source_type, rule.target_type, what)
    if src.startswith("array<") and family(dst) == "string":
        delimiter = rule.options.get("arrayDelimiter")
        delimiter = delimiter if isinstance(delimiter, str) else ","
        items = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))
        return Val(F.when(there, F.array_join(F.transform(items, lambda x: string_of(x)), delimiter)), "text")
    if src.startswith("map<") and family(dst) == "string":
        return Val(F.when(there, json_text(v)), "text")
    if ("int" in src or src == "number") and dst in BOOLEAN_NAMES:
        out = F.when(there, value_number(v, val.codes, val.t) != 0)
        return Val(out, "bool").failing(there & out.isNull(), fail("not a finite number"))
    if "timestamp" in dst or "datetime" in dst or "iso" in src or "timestamp" in src:
        # Only texts and whole numbers (a year) can be a date.
        stamp = F.when(val.codes.isin("STR", "BIG"), text_timestamp(val.texts))
        return Val(stamp, "stamp").failing(there & stamp.isNull(), fail("not a date and time"))
    return val


def convert_value(v: Column | Val, rule: FieldRule) -> Val:
    """Apply one rule to a dynamic value; NULL stays NULL."""
    val = v if isinstance(v, Val) else Val(v)
    if rule.strategy == "json":
        return Val(F.when(~val.missing, json_text(val.col)), "text")
    if rule.strategy == "stringify":
        return Val(val.as_text(), "text")
    if rule.strategy == "cast":
        return _cast(val, rule)
    raise ValueError("a skipped column has no value")


# --- coercion to the target type ---------------------------------------------

def _to_string(val: Val) -> Val:
    if val.form != "variant":
        return val
    nested = code_is_nested(val.codes)
    return Val(F.when(nested, json_text(val.col).cast("variant")).when(~val.missing, val.col))


def _numeric_text(text: Column) -> Column:
    finite = F.coalesce(F.abs(text.try_cast("double")) < float("inf"), F.lit(True))
    return text.rlike(NUMBER_TEXT) & finite


def _to_numeric(val: Val) -> Val:
    if val.form == "bool":
        return Val(val.col.cast("int").cast("string"), "text")
    if val.form != "variant":
        text = val.as_text()
        return Val(F.when(_numeric_text(text), text), "text")
    k = val.codes
    flag = F.when(val.texts == "true", "1").otherwise("0")
    ok = code_is_number(k) | ((k == "STR") & _numeric_text(val.texts))
    return Val(
        F.when(ok, val.col).when(k == "BOO", flag.cast("int").cast("variant")),
        t=F.when(ok, val.texts).when(k == "BOO", flag),
    )


def _flag_of_text(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low.isin("true", "1"), True).when(low.isin("false", "0"), False)


def _to_boolean(val: Val) -> Val:
    if val.form == "bool":
        return val
    if val.form != "variant":
        return Val(_flag_of_text(val.as_text()), "bool")
    k = val.codes
    return Val(
        F.when(k == "BOO", val.texts == "true")
        .when(code_is_number(k), val.texts.try_cast("double") != 0)
        .when(k == "STR", _flag_of_text(val.texts)),
        "bool",
    )


def _to_temporal(val: Val) -> Val:
    if val.form == "stamp":
        return val
    if val.form != "variant":
        return Val(text_timestamp(val.as_text()), "stamp")
    k = val.codes
    return Val(
        F.when(k == "STR", text_timestamp(val.texts)).when(
            code_is_number(k), millis_timestamp(val.texts.try_cast("double"))
        ),
        "stamp",
    )


def _checked_json(text: Column) -> Column:
    return F.when(F.try_parse_json(text).isNotNull(), text).otherwise(json_text(text.cast("variant")))


def _to_json(val: Val) -> Val:
    if val.form == "bool":
        return Val(val.as_text(), "text")
    if val.form != "variant":
        return Val(_checked_json(val.as_text()), "text")
    k = val.codes
    return Val(
        F.when(k == "STR", _checked_json(val.texts)).when(~val.missing, json_text(val.col)),
        "text",
    )


# What is wrong when a family does not accept a value.
COERCIONS: dict[str, tuple[Callable[[Val], Val], str]] = {
    "string": (_to_string, "not text"),
    "numeric": (_to_numeric, "not a finite number"),
    "boolean": (_to_boolean, "not a boolean"),
    "temporal": (_to_temporal, "not a date"),
    "json": (_to_json, "not JSON"),
}


def misfit_text(target: str | None) -> str:
    """What is wrong with a value that a target does not accept."""
    bounds = integer_range(target) if family(target) == "numeric" else None
    if bounds:
        return f"not an integer from {bounds[0]} to {bounds[1]}"
    return COERCIONS.get(family(target), (None, "does not fit the type"))[1]


def coerce_value(val: Val, target: str | None, column: str, source: str | Column | None = None) -> Val:
    """Bring a value to the family of ``target``; NULL stays NULL, unknown types pass."""
    step = COERCIONS.get(family(target))
    if step is None:
        return val
    apply, detail = step[0], misfit_text(target)
    out = apply(val)
    if source is None:
        source = F.coalesce(kind_of(val.codes), F.lit("null")) if val.form == "variant" else "string"
    there = ~val.missing
    carried = Val(out.col, out.form, val.error, out.k, out.t)
    carried = carried.failing(there & out.col.isNull(), failure_text(column, source, target, detail))
    bounds = integer_range(target) if family(target) == "numeric" else None
    if bounds is None:
        return carried
    text = out.texts if out.form == "variant" else out.as_text()
    # Plain digits need a range test at most, and none if the type holds all of them.
    whole = text.try_cast("bigint")
    plain = F.lit(True) if bounds == (-(2**63), 2**63 - 1) else whole.between(*bounds)
    exact = text.try_cast("decimal(38,10)")
    # Fractions and values beyond the type are errors, never cut.
    inside = (exact == F.floor(exact)) & exact.between(*[F.lit(str(b)).cast("decimal(38,0)") for b in bounds])
    # Texts in other notations (hexadecimal) are accepted as they are.
    fits = F.when(whole.isNotNull(), plain).otherwise(F.coalesce(inside, text.try_cast("double").isNull()))
    wrong = out.col.isNotNull() & ~fits
    limited = Val(F.when(~wrong, out.col), carried.form, carried.error, None, F.when(~wrong, text) if out.form == "variant" else None)
    return limited.failing(wrong, failure_text(column, source, target, detail))


def convert_column(v: Column | Val, column: str, rule: FieldRule | None, target_type: str | None) -> Val:
    """Rule, then coercion: what one output column of a record goes through."""
    val = v if isinstance(v, Val) else Val(v)
    if rule is None:
        return coerce_value(val, target_type, column)
    out = convert_value(val, rule)
    return coerce_value(out, target_type, rule.output, rule.target_type or rule.source_type)


# --- document sinks ------------------------------------------------------------

def is_search_string(target: str | None) -> bool:
    t = (target or "").strip().lower()
    return family(t) == "string" or t in SEARCH_STRING_NAMES


def coerce_for_search(v: Column, target: str | None) -> Column:
    """Search default: nested values become JSON text in string-like fields only."""
    if not is_search_string(target):
        return v
    return F.when(code_is_nested(code(v)), json_text(v).cast("variant")).otherwise(v)
