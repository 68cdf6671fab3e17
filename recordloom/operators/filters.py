"""Predicates: SQL fragments, a bounded search query language, graph and name search."""

from __future__ import annotations

import json
import operator
import re
from collections.abc import Callable
from datetime import datetime, timedelta, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def where(df: DataFrame, fragment: str | None) -> DataFrame:
    """Filter by a SQL predicate without its keyword; empty means no filter."""
    if fragment is None or not fragment.strip():
        return df
    return df.filter(F.expr(fragment.strip()))


def _all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def _any(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


# Units of relative dates.
DATE_UNITS = {"s": "seconds", "m": "minutes", "h": "hours", "d": "days", "w": "weeks"}
RELATIVE = re.compile(r"now(?:([+-])(\d+)([smhdw]))?(/d)?")


class FilterCompiler:
    """Folds a query object into one Column, so it reaches the scan like any filter."""

    def __init__(self, df: DataFrame, id_column: str | None = None, now: datetime | None = None):
        self.types = {f.name: f.dataType for f in df.schema.fields}
        self.id_column = id_column
        self.now = now or datetime.now(timezone.utc)
        self.clauses = {
            "match_all": lambda _: F.lit(True),
            "term": self.term,
            "terms": self.terms,
            "range": self.range,
            "exists": self.exists,
            "prefix": self.prefix,
            "wildcard": self.wildcard,
            "ids": self.ids,
            "bool": self.bool,
        }

    def compile(self, query: dict) -> Column:
        if not isinstance(query, dict):
            raise ValueError("a query must be an object")
        if len(query) != 1:
            raise ValueError("a query must have exactly one clause")
        name, body = next(iter(query.items()))
        if name not in self.clauses:
            raise ValueError(f"unknown clause: {name}")
        return self.clauses[name](body)

    def strict(self, query: dict) -> Column:
        """Never NULL: a missing value does not match, hence is kept by a negation."""
        return F.coalesce(self.compile(query), F.lit(False))

    def field(self, name: str) -> tuple[Column, T.DataType]:
        """A column, or a field inside of one, and its type; a field of a list of records is the list of its values."""
        if name in self.types:
            return F.col(f"`{name}`"), self.types[name]
        head, *path = name.split(".")
        if head not in self.types:
            raise ValueError(f"unknown field: {name}")
        column, dt, listed = F.col(f"`{head}`"), self.types[head], False
        for step in path:
            if isinstance(dt, T.ArrayType) and not listed:
                dt, listed = dt.elementType, True
            if not isinstance(dt, T.StructType) or step not in dt.names:
                raise ValueError(f"unknown field: {name}")
            column, dt = column[step], dt[step].dataType
        if listed and isinstance(dt, T.ArrayType):
            raise ValueError(f"lists inside of lists: {name}")
        return column, T.ArrayType(dt) if listed else dt

    def test(self, name: str, passes: Callable[[Column, T.DataType], Column]) -> Column:
        """Whether the field passes; of a list, whether any of its values does."""
        column, dt = self.field(name)
        if isinstance(dt, T.ArrayType):
            return F.exists(column, lambda v: passes(v, dt.elementType))
        return passes(column, dt)

    def operands(self, column: Column, dt: T.DataType, value: object) -> tuple[Column, Column]:
        """What is compared: a relative date compares texts as points in time, so that a text that is none does not match."""
        if isinstance(dt, T.StringType) and isinstance(value, str) and RELATIVE.fullmatch(value):
            return column.try_cast("timestamp"), F.lit(self.date(value)).cast("timestamp")
        return column, self.literal(dt, value)

    def literal(self, dt: T.DataType, value: object) -> Column:
        if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            text = self.date(value) if isinstance(value, str) else None
            if text is not None:
                return F.lit(text).cast(dt)
            if isinstance(value, (int, float)) and not isinstance(value, bool):
                return F.timestamp_millis(F.lit(int(value))).cast(dt)
        return F.lit(value)

    def date(self, text: str) -> str:
        """``now``, ``now-7d``, ``now-1d/d`` or a date text."""
        found = RELATIVE.fullmatch(text)
        if not found:
            return text
        sign, amount, unit, rounded = found.groups()
        moment = self.now.astimezone(timezone.utc)
        if amount:
            step = timedelta(**{DATE_UNITS[unit]: int(amount)})
            moment = moment - step if sign == "-" else moment + step
        if rounded:
            moment = moment.replace(hour=0, minute=0, second=0, microsecond=0)
        return moment.strftime("%Y-%m-%d %H:%M:%S.%f")

    @staticmethod
    def single(body: object, clause: str) -> tuple[str, object]:
        if not isinstance(body, dict) or len(body) != 1:
            raise ValueError(f"{clause} needs exactly one field")
        return next(iter(body.items()))

    def term(self, body: object) -> Column:
        name, value = self.single(body, "term")
        value = value["value"] if isinstance(value, dict) else value
        return self.test(name, lambda c, dt: operator.eq(*self.operands(c, dt, value)))

    def terms(self, body: object) -> Column:
        name, values = self.single(body, "terms")
        if not isinstance(values, list):
            raise ValueError("terms needs a list")
        relative = [v for v in values if isinstance(v, str) and RELATIVE.fullmatch(v)]
        plain = [v for v in values if v not in relative]

        def passes(column: Column, dt: T.DataType) -> Column:
            # Plain values stay one list, which reaches the scan.
            listed = [column.isin([self.literal(dt, v) for v in plain])] if plain else []
            return _any([*listed, *[operator.eq(*self.operands(column, dt, v)) for v in relative]])

        return self.test(name, passes)

    def range(self, body: object) -> Column:
        name, bounds = self.single(body, "range")
        tests = {
            "gt": operator.gt,
            "gte": operator.ge,
            "lt": operator.lt,
            "lte": operator.le,
        }
        if not isinstance(bounds, dict) or set(bounds) - set(tests):
            raise ValueError("range takes gt, gte, lt and lte")
        return self.test(
            name, lambda c, dt: _all([c.isNotNull(), *[tests[op](*self.operands(c, dt, v)) for op, v in bounds.items()]])
        )

    def exists(self, body: object) -> Column:
        _, name = self.single(body, "exists")
        return self.test(name, lambda c, _: c.isNotNull())

    def prefix(self, body: object) -> Column:
        name, value = self.single(body, "prefix")
        value = value["value"] if isinstance(value, dict) else value
        return self.test(name, lambda c, _: c.startswith(value))

    def wildcard(self, body: object) -> Column:
        name, value = self.single(body, "wildcard")
        value = value["value"] if isinstance(value, dict) else value
        escaped = re.sub(r"([\\%_])", r"\\\1", value)
        return self.test(name, lambda c, _: c.like(escaped.replace("*", "%").replace("?", "_")))

    def ids(self, body: object) -> Column:
        if self.id_column is None:
            raise ValueError("ids needs an id column")
        values = body.get("values") if isinstance(body, dict) else None
        if not isinstance(values, list):
            raise ValueError("ids needs a list of values")
        return F.col(self.id_column).cast("string").isin([str(v) for v in values])

    def bool(self, body: object) -> Column:
        if not isinstance(body, dict):
            raise ValueError("bool needs an object")
        extra = set(body) - {"must", "filter", "should", "must_not", "minimum_should_match"}
        if extra:
            raise ValueError(f"unknown part of bool: {', '.join(sorted(extra))}")
        listed = lambda key: body[key] if isinstance(body.get(key), list) else [body[key]] if key in body else []
        required = [self.compile(q) for q in [*listed("must"), *listed("filter")]]
        optional = [self.strict(q) for q in listed("should")]
        refused = [self.strict(q) for q in listed("must_not")]
        parts = [*required, *[~q for q in refused]]
        needed = int(body.get("minimum_should_match", 0 if required else 1))
        if optional and needed == 1:
            parts.append(_any([self.compile(q) for q in listed("should")]))
        elif optional and needed > 1:
            parts.append(sum((q.cast("int") for q in optional), F.lit(0)) >= needed)
        return _all(parts)


def filter_dsl(
    df: DataFrame, query: str | dict | None, id_column: str | None = None, now: datetime | None = None
) -> DataFrame:
    """Filter by a search query; none means everything."""
    if query is None or (isinstance(query, str) and not query.strip()):
        return df
    parsed = json.loads(query) if isinstance(query, str) else query
    return df.filter(FilterCompiler(df, id_column, now).compile(parsed))


def graph_where(frame: DataFrame, kind: str, name: str, fragment: str | None = None) -> DataFrame:
    """Nodes of one label or relationships of one type that meet a predicate."""
    if kind == "node":
        member = F.array_contains("_labels", name)
    elif kind == "relationship":
        member = F.col("_type") == name
    else:
        raise ValueError(f"unknown kind: {kind}")
    return where(frame.filter(member), fragment)


def search_names(catalog: DataFrame, keyword: str | None, *columns: str) -> DataFrame:
    """Rows whose dotted name contains the keyword in any case; empty finds all."""
    if keyword is None or not keyword.strip():
        return catalog
    full = F.lower(F.concat_ws(".", *columns))
    return catalog.filter(full.contains(keyword.strip().lower()))
