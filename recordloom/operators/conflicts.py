"""Conflict policies: what happens when an incoming key is already there.

Incoming rows are reduced to one per key first, with partial aggregation inside every task, so a hot key is small
before the shuffle.  The reduced rows then meet the target in one join, so that incoming rows (often the end of a long
conversion) are computed once.  A row with a NULL in its key matches nothing: like a document without an id it is always appended.
Rows that share a key in the target stay as many as they are.

``merge_frames`` gives the whole table after the write.  For a stored table of which a write touches a part, see ``sinks.keyed``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POLICIES = ("error", "skip", "update", "overwrite")


class KeyConflict(ValueError):
    """Incoming rows whose key exists, under the policy that forbids it."""


class UnknownColumns(ValueError):
    """Incoming columns that the target lacks."""


def _keys(keys: list[str]) -> list[Column]:
    return [F.col(f"`{k}`") for k in keys]


def _keyed(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [k.isNotNull() for k in _keys(keys)])


def check_columns(target: DataFrame, incoming: DataFrame, *helpers: str | None) -> None:
    """Refuse incoming columns the target lacks; a write never drops or adds one silently."""
    unknown = [c for c in incoming.columns if c not in target.columns and c not in helpers]
    if unknown:
        raise UnknownColumns(f"columns the target lacks: {', '.join(unknown)}")


def conflicting_keys(target: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """``keys + (in_target, incoming)`` of every key that cannot simply be appended; NULL keys always can."""
    both = target.select(*_keys(keys), F.lit(1).alias("t"), F.lit(0).alias("i")).unionByName(
        incoming.select(*_keys(keys), F.lit(0).alias("t"), F.lit(1).alias("i"))
    )
    counts = both.filter(_keyed(keys)).groupBy(*_keys(keys)).agg(F.max("t").alias("t"), F.sum("i").alias("i"))
    clash = (F.col("i") > 1) | ((F.col("i") > 0) & (F.col("t") > 0))
    return counts.filter(clash).select(
        *_keys(keys), (F.col("t") > 0).alias("in_target"), F.col("i").alias("incoming")
    )


def append_or_raise(target: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Policy ``error``: the appended table, or an error naming one such key."""
    check_columns(target, incoming)
    found = conflicting_keys(target, incoming, keys).head()
    if found is not None:
        shown = ", ".join(f"{k}={found[k]}" for k in keys)
        raise KeyConflict(f"duplicate key: {shown}")
    return target.unionByName(incoming, allowMissingColumns=True)


def _padded(df: DataFrame, like: DataFrame) -> DataFrame:
    have = set(df.columns)
    return df.select(*[
        F.col(f"`{f.name}`").cast(f.dataType).alias(f.name)
        if f.name in have
        else F.lit(None).cast(f.dataType).alias(f.name)
        for f in like.schema.fields
    ])


def reduce_rows(incoming: DataFrame, keys: list[str], fed: list[str], first: bool, seq: str, presence: str | None = None) -> DataFrame:
    """``keys + _new``: the first or last incoming row of each key; a row with a NULL in its key stays by itself.

    With ``presence`` the last row that has a column decides on that column alone, and an absent one is a NULL struct.
    """
    order = F.col(f"`{seq}`")
    nothing = [F.lit(None).alias("_none")]
    # Rows with a NULL in their key are told apart by their place, so that one pass serves both kinds.
    grouped = incoming.groupBy(*_keys(keys), F.when(~_keyed(keys), order).alias("_own"))
    if presence is None:
        pick = F.min_by if first else F.max_by
        return grouped.agg(pick(F.struct(*[F.col(f"`{c}`") for c in fed] or nothing), order).alias("_new")).drop("_own")
    has = F.col(f"`{presence}`")
    picks = [F.max_by(F.struct(F.col(f"`{c}`").alias("v")), F.when(F.array_contains(has, c), order)).alias(f"_c{i}") for i, c in enumerate(fed)]
    picked = grouped.agg(*picks or nothing)
    return picked.select(*_keys(keys), F.struct(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(fed)] or nothing).alias("_new"))


def merge_frames(
    target: DataFrame,
    incoming: DataFrame,
    keys: list[str],
    policy: str,
    seq: str,
    presence: str | None = None,
) -> DataFrame:
    """The table after the write, with the columns of ``target``.

    ``seq`` is a unique ascending sequence of the incoming rows.  ``presence``
    names an ``ARRAY<STRING>`` column with the columns a row really has, so that
    an update can tell an absent value from a null one; without it every column
    of ``incoming`` counts as present.
    """
    helpers = [c for c in (seq, presence) if c and c not in target.columns]
    if policy == "error":
        return append_or_raise(target, incoming.drop(*helpers), keys)
    if policy not in POLICIES:
        raise ValueError(f"unknown policy: {policy}")
    check_columns(target, incoming, *helpers)
    if policy == "skip":
        return target.unionByName(_padded(rows_to_append(target, incoming.drop(*[h for h in helpers if h != seq]), keys, seq), target))
    fed = [c for c in target.columns if c not in keys and c in incoming.columns and c not in helpers]
    by_column = presence is not None and policy == "update"
    reduced = reduce_rows(incoming, keys, fed, False, seq, presence if by_column else None)
    kinds = {f.name: f.dataType for f in target.schema.fields}
    old = target.select(*_keys(keys), F.struct(*[F.col(f"`{c}`") for c in target.columns]).alias("_old"))
    # One full join: a stored row keeps or changes its cells, a new row has no stored one.  NULL keys meet nothing.
    new = reduced.select(*[F.col(f"`{k}`").cast(kinds[k]).alias(k) for k in keys], "_new")
    both = old.join(new, keys, "full_outer")
    hit, stored = F.col("_new").isNotNull(), F.col("_old").isNotNull()

    def cell(c: str) -> Column:
        before = F.col(f"_old.`{c}`")
        if c in keys:
            return F.when(stored, before).otherwise(F.col(f"`{c}`")).alias(c)
        if c not in fed:
            return (F.when(~hit, before) if policy == "overwrite" else before).alias(c)
        changed = F.col(f"_new.`{c}`").isNotNull() if by_column else hit
        value = F.col(f"_new.`{c}`.v") if by_column else F.col(f"_new.`{c}`")
        return F.when(changed, value.cast(kinds[c])).otherwise(before).alias(c)

    return both.select(*[cell(c) for c in target.columns])


def rows_to_append(target: DataFrame, incoming: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Policy ``skip`` for an append-only sink: first incoming row of each new key, and all rows with a NULL key.

    Reads only the key columns of the target; nothing of it is rewritten.
    """
    columns = [c for c in incoming.columns if c != seq or c in keys]
    rest = [c for c in columns if c not in keys]
    fresh = reduce_rows(incoming, keys, rest, True, seq).join(target.select(*_keys(keys)), keys, "left_anti")
    return fresh.select(*[F.col(f"`{c}`") if c in keys else F.col(f"_new.`{c}`") for c in columns])
