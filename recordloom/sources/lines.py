"""Text lines with their file and an exact or a free position.

Two numberings are offered, because only one of them costs something:

* ``position``: block start (bytes) plus the row index inside the task.  It
  grows with the line order of a file and is unique in it, needs no pass over
  the data and is all that ordering operators (first column seen, last
  duplicate wins) ask for.
* ``exact``: the 1-based line number, which error texts and cursors need.
  One narrow pass counts the lines per input block.  The block table (one row
  per block, never per line) is kept, a running total over the blocks of each
  file gives every block its offset, and the table meets the lines as two
  numbers a block: a key and a shift.  Marks of files (a cursor, the first
  broken line) travel in the same table.  Lines are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordloom.session import cut_lineage

# monotonically_increasing_id keeps the row index of a task in its low 33 bits.
_ROW_BITS = (1 << 33) - 1
# Blocks of one broadcast table, some 64 bytes each: 256 MB for 500 TB in blocks of 128 MB.  Beyond, files are read in groups.
MOST_BLOCKS = 4 << 20


def raw_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Lines with file, block start and a number that grows inside a task."""
    return spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("mid"),
        "value",
    )


def block_table(raw: DataFrame, **measures: Column) -> DataFrame:
    """``(file, block, n, first_mid, before)`` and any further aggregates of each input block; ``before`` counts the file's earlier lines."""
    counted = cut_lineage(raw.groupBy("file", "block").agg(
        F.count(F.lit(1)).alias("n"), F.min("mid").alias("first_mid"), *[c.alias(n) for n, c in measures.items()]
    ))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return cut_lineage(counted.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))))


def _block_key(seed: int) -> Column:
    return F.xxhash64("file", "block", F.lit(seed))


def numbered_lines(raw: DataFrame, blocks: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """``(file, line_no, value)``, and ``mark``, a number of the line's file in ``marks(file, mark)`` (NULL without one).

    The table is joined by one number a block, which hashes its file and start; should two blocks share it, another hash is taken.
    """
    seed = 0
    while blocks.select(_block_key(seed).alias("key")).groupBy("key").count().filter("count > 1").head() is not None:
        seed += 1
    table = blocks.select("file", _block_key(seed).alias("_key"), (F.col("before") - F.col("first_mid") + 1).alias("_shift"))
    if marks is not None:
        table = table.join(marks.select("file", F.col("mark").cast("bigint").alias("mark")), "file", "left")
    joined = raw.withColumn("_key", _block_key(seed)).join(F.broadcast(table.drop("file")), "_key")
    kept = ["mark"] if marks is not None else []
    return joined.select("file", (F.col("mid") + F.col("_shift")).alias("line_no"), "value", *kept)


def file_groups(blocks: DataFrame, most: int) -> list[list[str]]:
    """Files in groups of at most ``most`` blocks (or one file); one group if they all fit."""
    if blocks.count() <= most:
        return []
    groups: list[list[str]] = [[]]
    held = 0
    for row in blocks.groupBy("file").count().orderBy("file").collect():
        if held and held + row["count"] > most:
            groups.append([])
            held = 0
        groups[-1].append(row["file"])
        held += row["count"]
    return groups


def read_lines(
    spark: SparkSession, paths: str | list[str], numbering: str = "exact", after: DataFrame | None = None
) -> DataFrame:
    """``(file, line_no, value)`` for every line, blank ones included.

    ``after(file, line_no)`` leaves out the lines up to a cursor of their file; the cursors come with the block table.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    raw = raw_lines(spark, paths)
    if numbering == "position" and after is None:
        position = F.col("block") + F.col("mid").bitwiseAND(F.lit(_ROW_BITS))
        return raw.select("file", position.alias("line_no"), "value")
    if numbering != "exact":
        raise ValueError(f"unknown numbering: {numbering}")
    blocks = block_table(raw)
    groups = file_groups(blocks, MOST_BLOCKS)
    if len(groups) > 1:
        parts = [read_lines(spark, g, numbering, after) for g in groups]
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part)
        return whole
    if after is None:
        return numbered_lines(raw, blocks)
    marked = numbered_lines(raw, blocks, after.select("file", F.col("line_no").alias("mark")))
    return marked.filter(F.col("line_no") > F.coalesce("mark", F.lit(0))).drop("mark")


def number_lines(df: DataFrame, value: str = "value", order: str | list[str] | None = None) -> DataFrame:
    """Give an in-memory column of lines the ``(file, line_no, value)`` shape.

    ``order`` names a column that already is a unique ascending line number.
    """
    if order is None:
        raise ValueError("order must name the line number column")
    return df.select(
        F.lit("memory").alias("file"),
        F.col(order).cast("bigint").alias("line_no"),
        F.col(value).alias("value"),
    )


def is_blank(value: Column) -> Column:
    return ~value.rlike(r"\S")


def barrier(df: DataFrame, *names: str) -> DataFrame:
    """The same frame, with ``names`` finished before any filter looks at them.

    A plain projection is substituted into every filter above it, which would
    parse or convert each value again.  A generator stops that: the filter stays
    above it and reads the finished columns.  The generator itself only passes
    references; the work stays in the projections below, where common parts are
    shared and long code is split.
    """
    return df.select(
        *[F.col(f"`{c}`") for c in df.columns if c not in names],
        F.inline(F.array(F.struct(*[F.col(f"`{c}`").alias(c) for c in names]))),
    ).select(*[f"`{c}`" for c in df.columns])


def pin(df: DataFrame, **columns: Column) -> DataFrame:
    """Append columns that are evaluated exactly once, see :func:`barrier`."""
    kept = [F.col(f"`{c}`") for c in df.columns]
    staged = df.select(*kept, *[c.alias(name) for name, c in columns.items()])
    return barrier(staged, *columns)
