"""Continuing a transfer: by offset, line, key, slice or table, and commit positions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.operators.ordinal import with_ordinal


#: Splitters of a range of keys, and rows of a range that is small enough to be sorted.
SPLITTERS, SORTED_ROWS = 32, 20_000


class _Keys:
    """Key columns, compared as tuples with NULLs first, and their values as literals by way of exact texts."""

    def __init__(self, df: DataFrame, keys: list[str]) -> None:
        self.keys = keys
        self.kinds = [df.schema[k].dataType.simpleString() for k in keys]
        self.tuple = F.struct(*[F.col(f"`{k}`") for k in keys])

    def texts(self) -> list[Column]:
        shown = [F.base64(F.col(f"`{k}`")) if t == "binary" else F.col(f"`{k}`").cast("string") for k, t in zip(self.keys, self.kinds)]
        return [c.alias(f"_t{i}") for i, c in enumerate(shown)]

    def literal(self, texts: tuple) -> Column:
        made = [F.unbase64(F.lit(x)) if t == "binary" else F.lit(x).cast(t) for x, t in zip(texts, self.kinds)]
        return F.struct(*[c.alias(k) for c, k in zip(made, self.keys)])

    def between(self, low: tuple | None, high: tuple | None) -> Column:
        """Strictly between; the bounds of the first key stand alone as well, so that files are pruned by them."""
        test, first = F.lit(True), F.col(f"`{self.keys[0]}`")
        if low is not None:
            test = test & (self.tuple > self.literal(low))
            test = test & (first >= self.literal(low)[self.keys[0]]) if low[0] is not None else test
        if high is not None:
            test = test & (self.tuple < self.literal(high))
            if high[0] is not None:
                test = test & (first.isNull() | (first <= self.literal(high)[self.keys[0]]))
        return test


def key_at(df: DataFrame, keys: list[str], n: int) -> tuple[tuple, int] | None:
    """The key (as texts) of the row at place ``n`` in key order, from 0, and the number of rows with smaller keys; None beyond the end.

    A few rows drawn at random split the range of keys; one pass over the key columns counts the rows below and up to each splitter;
    only the part that holds the place is split again, until a splitter is its key or few rows are left.
    """
    of = _Keys(df, keys)
    low = high = None
    below, rows = 0, None
    while rows is None or rows > SORTED_ROWS:
        part = df.filter(of.between(low, high)).select(*[F.col(f"`{k}`") for k in keys])
        drawn = part.select("*", F.rand(17).alias("_r")).orderBy("_r").limit(SPLITTERS).drop("_r")
        splits = [tuple(r) for r in drawn.distinct().orderBy(*[F.col(f"`{k}`") for k in keys]).select(*of.texts()).collect()]
        counts = [F.count(F.lit(1))]
        for s in splits:
            counts += [F.count_if(of.tuple < of.literal(s)), F.count_if(of.tuple <= of.literal(s))]
        total, *found = part.agg(*[c.alias(f"c{i}") for i, c in enumerate(counts)]).head()
        if n >= below + total:
            return None
        upto, top = 0, total
        for s, less, most in zip(splits, found[::2], found[1::2]):
            if below + less <= n < below + most:
                return s, below + less
            if n >= below + most:
                low, upto = s, most
            else:
                high, top = s, less
                break
        below, rows = below + upto, top - upto
    part = df.filter(of.between(low, high)).orderBy(*[F.col(f"`{k}`") for k in keys]).offset(n - below).limit(1)
    key = tuple(part.select(*of.texts()).head())
    return key, below + df.filter(of.between(low, high) & (of.tuple < of.literal(key))).count()


def resume_offset(df: DataFrame, keys: list[str], done: int) -> DataFrame:
    """Rows after the first ``done`` in key order (NULLs first; of equal keys by all columns).

    The key at that place is found by counting, see :func:`key_at`.  Rows with greater keys pass a filter; only rows with that very key are put
    in order, if some of them are done.  Nothing else is sorted or stored.
    """
    if not keys:
        raise ValueError("resuming by offset needs keys")
    if done < 0:
        raise ValueError("the offset is negative")
    if done == 0:
        return df
    found = key_at(df, keys, done)
    if found is None:
        return df.limit(0)
    key, below = found
    of = _Keys(df, keys)
    rest = df.filter(of.between(key, None))
    ties = df.filter(of.tuple == of.literal(key))
    if done > below:
        ties = with_ordinal(ties, df.columns, "_ord").filter(F.col("_ord") >= done - below).drop("_ord")
    return rest.unionByName(ties)


def resume_lines(lines: DataFrame, cursor: DataFrame | dict[str, int]) -> DataFrame:
    """Lines after the last committed one of each file; a line commits as a whole."""
    if isinstance(cursor, dict):
        if not cursor:
            return lines
        done = F.create_map(*[F.lit(x) for pair in cursor.items() for x in pair])
        return lines.filter(F.col("line_no") > F.coalesce(F.try_element_at(done, F.col("file")), F.lit(0)))
    marks = cursor.select("file", F.col("line_no").alias("_done"))
    joined = lines.join(marks, "file", "left")
    return joined.filter(F.col("line_no") > F.coalesce("_done", F.lit(0))).drop("_done")


def after_key(keys: list[str], last: list) -> Column:
    """``keys`` greater than ``last`` in order, written so that sources can use it.

    The leading key's bound stands alone, hence file statistics and JDBC sources
    prune by it; the exact comparison of all keys follows.
    """
    if len(keys) != len(last):
        raise ValueError("the cursor has another number of keys")
    terms = []
    for i, (key, value) in enumerate(zip(keys, last)):
        same = [F.col(f"`{k}`") == F.lit(v) for k, v in zip(keys[:i], last[:i])]
        terms.append(reduce(lambda a, b: a & b, [*same, F.col(f"`{key}`") > F.lit(value)]))
    exact = reduce(lambda a, b: a | b, terms)
    return exact if len(keys) == 1 else (F.col(f"`{keys[0]}`") >= F.lit(last[0])) & exact


def resume_keyset(df: DataFrame, keys: list[str], last: list | None) -> DataFrame:
    """Rows behind the cursor; no cursor means from the start."""
    return df if last is None else df.filter(after_key(keys, last))


def next_keyset(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row with the cursor to continue at: the largest key."""
    return df.agg(F.max(F.struct(*[F.col(f"`{k}`") for k in keys])).alias("c")).select("c.*")


def check_advance(previous: list | None, current: list | None) -> None:
    if previous is not None and current is not None and tuple(current) <= tuple(previous):
        raise ValueError("the cursor did not advance")


def resume_slices(sliced: DataFrame, cursors: DataFrame, key: str, slices: int) -> DataFrame:
    """Rows behind the cursor of their slice.

    ``cursors(slice, rows, last_key, slices)`` has at most one row per slice and
    fixes the number of slices of the transfer.  There are at most 32 slices,
    so their cursors are a constant of the plan.
    """
    known = cursors.select("slice", "last_key", "slices").collect()
    if any(r["slices"] != slices for r in known):
        raise ValueError("a transfer continues with the number of slices it began with")
    if len(known) > slices:
        raise ValueError("more cursors than slices")
    marks = [(r["slice"], r["last_key"]) for r in known if r["last_key"] is not None]
    if not marks:
        return sliced
    last = F.create_map(*[F.lit(x) for pair in marks for x in pair])
    mark = F.try_element_at(last, F.col("slice"))
    return sliced.filter(mark.isNull() | (F.col(f"`{key}`") > mark))


def slice_cursors(sliced: DataFrame, key: str, slices: int) -> DataFrame:
    """``(slice, rows, last_key, slices)`` of what was transferred."""
    return sliced.groupBy("slice").agg(
        F.count(F.lit(1)).alias("rows"),
        F.max(F.col(f"`{key}`")).alias("last_key"),
        F.lit(slices).alias("slices"),
    )


def resume_tables(tables: list[tuple[str, DataFrame, list[str]]], cursor: dict) -> dict[str, DataFrame]:
    """What is left of a list of tables after ``{table_index, rows}``."""
    index, rows = cursor["table_index"], cursor["rows"]
    left = {}
    for i, (name, df, keys) in enumerate(tables):
        if i > index:
            left[name] = df
        elif i == index:
            left[name] = resume_offset(df, keys, rows)
    return left


def commit_watermark(batches: DataFrame, group: str | None = None) -> DataFrame:
    """End line of the longest committed prefix of ``(seq, end_line, committed)``.

    A run of committed batches ends where the next sequence is missing; the
    prefix is the first run if it starts at 1.  Runs are found by an anti join
    on the sequence itself, whose keys are unique, so the batches of one
    transfer never have to meet in one task.
    """
    by = [group] if group else ["_all"]
    frame = batches if group else batches.withColumn("_all", F.lit(0))
    done = frame.filter("committed").select(*by, "seq", "end_line")
    followed = done.select(*by, (F.col("seq") - 1).alias("seq"))
    ends = done.join(followed, [*by, "seq"], "left_anti")
    tail = ends.groupBy(*by).agg(F.min_by("end_line", "seq").alias("end"), F.min("seq").alias("last"))
    first = frame.groupBy(*by).agg(F.min(F.when(F.col("committed"), F.col("seq"))).alias("first"))
    begun = F.coalesce(F.col("first") == 1, F.lit(False))
    out = first.join(tail, by, "left").select(
        *by,
        F.when(begun, F.col("end")).otherwise(F.lit(0)).alias("watermark"),
        F.when(begun, F.col("last")).otherwise(F.lit(0)).alias("batches"),
    )
    return out if group else out.drop("_all")
