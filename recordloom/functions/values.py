"""Kinds, texts and numbers of dynamic (VARIANT) values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of the accepted date and number texts.
ISO_DATE_TIME_PREFIX = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}"
ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"
DATE_TEXT = (
    r"^\d{4}(-\d{2}(-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?)?)?$"
)
COMPLETE_STAMP = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"
ZONELESS_STAMP = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?$"
DECIMAL_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
RADIX_TEXT = r"^\s*0([xX][0-9a-fA-F]+|[bB][01]+|[oO][0-7]+)\s*$"
USUAL_NUMBER = r"^(?!-?0\.000000)-?\d{1,21}(\.\d*[1-9])?$"
NUMBER_TEXT = (
    r"^\s*([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|0([xX][0-9a-fA-F]+|[bB][01]+|[oO][0-7]+))\s*$"
)
MAX_SAFE_INTEGER = 9007199254740991
MAX_EPOCH_MILLIS = 8640000000000000


# First letters of the schema text of a variant, and what they stand for.
KIND_OF_CODE = {
    "STR": "string",
    "BIG": "number",
    "DEC": "number",
    "DOU": "number",
    "FLO": "number",
    "BOO": "boolean",
    "VOI": "null",
    "ARR": "array",
    "OBJ": "object",
}
NUMBER_CODES = tuple(c for c, k in KIND_OF_CODE.items() if k == "number")


def code(v: Column) -> Column:
    """Three letters that tell the JSON type of a variant; NULL if absent."""
    return F.substring(F.schema_of_variant(v), 1, 3)


def kind_of(k: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in KIND_OF_CODE.items() for x in pair])
    return F.try_element_at(table, k)


def kind(v: Column) -> Column:
    """``null, boolean, number, string, array`` or ``object``; NULL if absent."""
    return kind_of(code(v))


def code_is_number(k: Column) -> Column:
    return k.isin(*NUMBER_CODES)


def code_is_nested(k: Column) -> Column:
    return k.isin("ARR", "OBJ")


def code_is_missing(k: Column) -> Column:
    return k.isNull() | (k == "VOI")


def is_null(v: Column) -> Column:
    """True for an absent value and for a JSON null."""
    return v.isNull() | F.is_variant_null(v)


def json_text(v: Column) -> Column:
    return F.to_json(v)


def as_text(v: Column) -> Column:
    """Scalar text without any number formatting, JSON text for nested values."""
    return F.try_variant_get(v, "$", "string")


def staged_text(v: Column, k: Column, j: Column) -> Column:
    """:func:`as_text` from the JSON text ``j`` and code ``k`` of the same value.

    Writing JSON costs a fraction of extracting a string, and apart from quotes
    the two texts only differ for strings that hold an escape.
    """
    bare = F.substr(j, F.lit(2), F.length(j) - 2)
    return F.when(k == "STR", F.when(j.contains("\\"), as_text(v)).otherwise(bare)).otherwise(j)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often it is used.

    Meant for rarely taken branches: a lambda is not compiled, but it keeps the
    code of the common branch small.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def _unusual_number(raw: Column) -> Column:
    """Texts with exponents, trailing zeros or very small fractions."""
    number = raw.try_cast("double")
    size = F.abs(number)
    digits = F.coalesce(raw.try_cast("decimal(38,24)"), raw.try_cast("decimal(38,16)"))
    fixed = F.regexp_replace(F.regexp_replace(digits.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    short = F.regexp_replace(number.cast("string"), r"\.0(?=E)", "")
    scientific = F.regexp_replace(F.regexp_replace(short, r"E(?=\d)", "e+"), "E-", "e-")
    return F.when(number == 0, "0").when((size >= 1e-6) & (size < 1e21), fixed).otherwise(scientific)


def plain_number(raw: Column) -> Column:
    """Shortest text of a number text: exponents only below 1e-6 and from 1e21 on."""
    return F.when(raw.rlike(USUAL_NUMBER), raw).otherwise(let(raw, _unusual_number))


def number_text(v: Column) -> Column:
    """Text of a number value; integers and decimals keep all their digits."""
    return plain_number(as_text(v))


def string_of(v: Column, k: Column | None = None, t: Column | None = None) -> Column:
    """``String(value)`` for scalars, JSON text for arrays and objects."""
    k = code(v) if k is None else k
    t = as_text(v) if t is None else t
    return (
        F.when(code_is_missing(k), F.lit("null"))
        .when(k.isin("DOU", "DEC", "FLO"), plain_number(t))
        .otherwise(t)
    )


def _unusual_text_number(text: Column) -> Column:
    clean = F.trim(F.regexp_replace(text, r"\s+", " "))
    radix, digits = F.lower(F.substring(clean, 2, 1)), F.substring(clean, 3, 64)
    base = F.when(radix == "x", 16).when(radix == "b", 2).otherwise(8)
    from_radix = F.coalesce(*[F.when(base == b, F.conv(digits, b, 10)) for b in (16, 2, 8)])
    return F.when(~text.rlike(r"\S"), F.lit(0.0)).when(
        text.rlike(RADIX_TEXT), from_radix.try_cast("double")
    )


def text_number(text: Column) -> Column:
    """The finite number a text stands for, else NULL.  Blank text is 0."""
    parsed = F.when(text.rlike(DECIMAL_TEXT), F.trim(text).try_cast("double")).otherwise(
        let(text, _unusual_text_number)
    )
    return F.when(F.abs(parsed) < float("inf"), parsed)


def value_number(v: Column, k: Column | None = None, t: Column | None = None) -> Column:
    """``Number(value)`` when finite, else NULL; nested values have none."""
    k = code(v) if k is None else k
    t = as_text(v) if t is None else t
    return (
        F.when(code_is_number(k), t.try_cast("double"))
        .when(k == "BOO", F.when(t == "true", 1.0).otherwise(0.0))
        .when(k == "STR", text_number(t))
        .when(k == "VOI", F.lit(0.0))
    )


def _unusual_stamp(text: Column) -> Column:
    """Instants of dates, and of times without seconds, zone or colon in the zone."""
    day = (
        F.when(F.length(text) == 4, F.concat(text, F.lit("-01-01T00:00:00Z")))
        .when(F.length(text) == 7, F.concat(text, F.lit("-01T00:00:00Z")))
        .otherwise(F.concat(text, F.lit("T00:00:00Z")))
    )
    zoned = F.when(text.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), text).otherwise(F.concat(text, F.lit("Z")))
    seconds = F.regexp_replace(zoned, r"^(.{13}:\d{2})(?=Z|[+-])", "$1:00")
    moment = F.regexp_replace(seconds, r"([+-]\d{2})(\d{2})$", "$1:$2")
    full = F.when(F.length(text) <= 10, day).otherwise(moment)
    return F.when(text.rlike(DATE_TEXT), full.try_cast("timestamp"))


def text_timestamp(text: Column) -> Column:
    """Instant of an ISO 8601 text (missing zone = UTC), NULL for anything else.

    Plain days are common, so they are counted as days since 1970 and parse no time zone; texts that are no date never reach the lambda.
    """
    day = (F.length(text) == 10) & text.rlike(ISO_DATE)
    return (
        F.when(day, F.timestamp_micros(F.unix_date(text.try_cast("date")).cast("bigint") * F.lit(86_400_000_000)))
        .when(text.rlike(COMPLETE_STAMP), text.try_cast("timestamp"))
        .when(text.rlike(ZONELESS_STAMP), F.concat(text, F.lit("Z")).try_cast("timestamp"))
        .when(text.rlike(DATE_TEXT), let(text, _unusual_stamp))
    )


def millis_timestamp(millis: Column) -> Column:
    """Instant of epoch milliseconds, NULL outside the representable range."""
    return F.when(
        F.abs(millis) <= MAX_EPOCH_MILLIS, F.timestamp_millis(millis.try_cast("bigint"))
    )


def iso_millis(ts: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ss.SSSZ`` in UTC, whatever the session time zone is."""
    seconds = F.unix_micros(ts).cast("decimal(20,0)") / F.lit(1000000).cast("decimal(7,0)")
    wall = F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)")
    )
    text = wall.cast("string")
    fraction = F.rpad(F.substring(text, 21, 3), 3, "0")
    return F.concat(
        F.substring(text, 1, 10), F.lit("T"), F.substring(text, 12, 8), F.lit("."), fraction, F.lit("Z")
    )


def map_last_wins(keys: Column, values: Column) -> Column:
    """Map from parallel arrays; a repeated key keeps its first place and last value."""
    names = F.array_distinct(keys)
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
    last = lambda name: F.element_at(
        F.filter(pairs, lambda p: p["k"] == name), -1
    )["v"]
    return F.when(F.size(names) == F.size(keys), F.map_from_arrays(keys, values)).otherwise(
        F.map_from_arrays(names, F.transform(names, last))
    )


#: JSON as the standard has it: double quotes only, no NaN or Infinity.
STRICT_JSON = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def _mark(text: Column) -> Column:
    return F.xxhash64(text)


def parse_wrapped(text: Column) -> Column:
    """Text to ``array<map<string,variant>>`` with the JSON object in front, see :func:`only_record`.

    The parser stops after the first value, so the text is read as the first of two elements of an array; the second is an object
    that holds a hash of the text.  Anything behind the record, brackets included, then shifts or loses that object, and the
    line is malformed.  The hash is a value, since the parser keeps every new key that it meets.
    """
    wrapped = F.concat(F.lit("["), text, F.lit(',{"":'), _mark(text).cast("string"), F.lit("}]"))
    # Trimming a set of characters walks the whole text, so it is left to texts that need it.
    closed = text.endswith("}") | F.rtrim(text, F.lit(" \t\r\n")).endswith("}")
    return F.when(closed, F.from_json(wrapped, "array<map<string,variant>>", STRICT_JSON))


def only_record(wrapped: Column, text: Column) -> Column:
    """The record of :func:`parse_wrapped`, NULL for any text that is no object; repeated keys are still in it."""
    seal = F.try_variant_get(F.try_element_at(F.get(wrapped, 1), F.lit("")), "$", "bigint")
    return F.when((F.size(wrapped) == 2) & (seal == _mark(text)), F.get(wrapped, 0))


def unique_keys(rec: Column) -> Column:
    """The record with the last value of every repeated key."""
    keys = F.map_keys(rec)
    return F.when(F.size(F.array_distinct(keys)) == F.size(rec), rec).otherwise(
        map_last_wins(keys, F.map_values(rec))
    )
