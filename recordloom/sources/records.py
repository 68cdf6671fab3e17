"""JSON lines of every accepted shape to one frame of dynamic records.

The canonical frame is ``(file, line_no, row_idx, rec, error)``:
``rec MAP<STRING,VARIANT>`` keeps key order, presence and JSON type of every
value; ``error`` is NULL for a good record and otherwise says what is wrong
with the line, in which case ``rec`` is NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions.values import as_text, code, map_last_wins, only_record, parse_wrapped, unique_keys
from recordloom.sources.lines import barrier, block_table, is_blank, numbered_lines, pin, raw_lines, read_lines

META = ["file", "line_no", "row_idx"]
# Keys of a search hit that are not part of the document.
HIT_META = ["_id", "_index", "_type", "_routing"]


def line_error(line_no: Column, *parts: Column | str) -> Column:
    rest = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    return F.concat(F.lit("line "), line_no.cast("string"), *rest)


def parse_lines(lines: DataFrame) -> DataFrame:
    """``(file, line_no, value)`` to one record per non-blank line.

    A filter on the result never parses a line twice, see :func:`barrier`.
    """
    rec0 = F.col("rec0")
    message = F.when(rec0.isNull(), line_error(F.col("line_no"), " is not a JSON object"))
    # Each step refers to the one before more than once, which keeps them apart.
    staged = lines.filter(~is_blank(F.col("value"))).select(
        "file", "line_no", "value", parse_wrapped(F.col("value")).alias("wrapped")
    )
    staged = staged.select("file", "line_no", only_record(F.col("wrapped"), F.col("value")).alias("one"))
    staged = staged.select("file", "line_no", unique_keys(F.col("one")).alias("rec0"))
    staged = staged.select(
        "file", "line_no", F.lit(0).alias("row_idx"), rec0.alias("rec"), message.alias("error")
    )
    return barrier(staged, "rec", "error")


def _array(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def expand_envelopes(records: DataFrame, detect: str = "both") -> DataFrame:
    """Batch envelopes ``{columns, rows}`` to one record per row.

    ``detect='both'`` takes a line as an envelope when ``columns`` and ``rows``
    are arrays; ``'either'`` as soon as one of the keys is there, and then the
    other one missing is an error.  Other records pass through.
    """
    rec, line_no = F.col("rec"), F.col("line_no")
    columns, rows = F.try_element_at(rec, F.lit("columns")), F.try_element_at(rec, F.lit("rows"))
    cols_arr, rows_arr = _array(columns), _array(rows)
    if detect == "both":
        envelope = cols_arr.isNotNull() & rows_arr.isNotNull()
    elif detect == "either":
        envelope = F.map_contains_key(rec, "columns") | F.map_contains_key(rec, "rows")
    else:
        raise ValueError(f"unknown detection: {detect}")
    envelope = F.coalesce(envelope, F.lit(False))
    names = F.try_variant_get(columns, "$", "array<string>")
    # The schema text of an array says whether all its elements are strings.
    all_text = (F.schema_of_variant(columns) == "ARRAY<STRING>") | (F.size(cols_arr) == 0)
    env = F.when(
        envelope, F.struct(F.when(all_text, names).alias("names"), rows_arr.alias("r"))
    )
    staged = records.select(*META, "rec", "error", env.alias("env"))

    staged = staged.select(*META, "rec", "error", "env", "env.names")
    body = F.col("env.r")
    is_env = F.col("env").isNotNull()
    whole_line_error = F.when(F.col("error").isNotNull(), F.col("error")).when(
        is_env,
        F.when(F.col("names").isNull(), line_error(line_no, ": columns must be an array of strings"))
        .when(body.isNull(), line_error(line_no, ": rows must be an array")),
    )
    # One element per output record; a line that yields one record needs no row value.
    one = F.array(F.lit(None).cast("variant"))
    expandable = F.col("names").isNotNull() & body.isNotNull()
    staged = staged.select(
        "file",
        "line_no",
        F.col("row_idx").alias("base_idx"),
        F.when(~is_env, rec).alias("single"),
        "names",
        whole_line_error.alias("line_err"),
        F.when(expandable, body).otherwise(one).alias("body"),
    )
    # The outer form keeps the optimizer from adding a filter that would evaluate
    # the array twice; an empty envelope gives no record.
    rows_df = staged.select(
        "file", "line_no", "base_idx", "single", "names", "line_err",
        F.posexplode_outer("body").alias("pos", "row"),
    ).filter(F.col("pos").isNotNull())
    is_row = F.col("names").isNotNull() & F.col("line_err").isNull()
    vals = F.when(is_row, _array(F.col("row")))
    count = F.size(F.col("vals"))
    where = F.concat(F.lit(": rows["), F.col("pos").cast("string"), F.lit("]"))
    row_error = (
        F.when(F.col("line_err").isNotNull(), F.col("line_err"))
        .when(~is_row, F.lit(None).cast("string"))
        .when(F.col("vals").isNull(), line_error(line_no, where, " must be an array"))
        .when(
            count != F.size(F.col("names")),
            line_error(
                line_no, where, " has ", count, " values for ", F.size(F.col("names")), " columns"
            ),
        )
    )
    row_rec = F.when(
        is_row & (count == F.size(F.col("names"))), map_last_wins(F.col("names"), F.col("vals"))
    ).when(F.col("names").isNull() & F.col("line_err").isNull(), F.col("single"))
    out = rows_df.withColumn("vals", vals).select(
        "file",
        "line_no",
        F.when(is_row, F.col("pos")).otherwise(F.col("base_idx")).alias("row_idx"),
        row_rec.alias("rec"),
        row_error.alias("error"),
    )
    return barrier(out, "rec", "error")


def expand_row_envelopes(records: DataFrame, target_columns: list[str] | None = None) -> DataFrame:
    """``{table, columns, values}`` lines to one record per line.

    Values are positional against ``target_columns`` when given, else against
    the line's own ``columns``; the counts must agree.
    """
    rec = F.col("rec")
    vals = _array(F.try_element_at(rec, F.lit("values")))
    own = F.transform(_array(F.try_element_at(rec, F.lit("columns"))), as_text)
    names = F.array(*[F.lit(c) for c in target_columns]) if target_columns else own
    staged = pin(records, row=F.struct(names.alias("n"), vals.alias("v")))
    n, v = F.col("row.n"), F.col("row.v")
    message = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(v.isNull(), line_error(F.col("line_no"), ": values must be an array"))
        .when(
            F.coalesce(F.size(n), F.lit(-1)) != F.size(v),
            line_error(
                F.col("line_no"), ": ", F.size(v), " values for ",
                F.coalesce(F.size(n), F.lit(0)), " columns",
            ),
        )
    )
    return staged.select(
        *META,
        F.when(F.size(n) == F.size(v), map_last_wins(n, v)).alias("rec"),
        message.alias("error"),
    )


def _non_empty_text(v: Column) -> Column:
    return F.when((code(v) == "STR") & (F.length(as_text(v)) > 0), as_text(v))


def unwrap_hits(records: DataFrame) -> DataFrame:
    """Search hits to documents: ``rec`` becomes the body, ``_id``/``_routing`` columns.

    A flat document loses its metadata keys from the body but keeps them as
    columns; a ``_source`` that is no object is an error.
    """
    rec = F.col("rec")
    hit = F.map_contains_key(rec, "_source")
    body = F.try_variant_get(
        F.try_element_at(rec, F.lit("_source")), "$", "map<string,variant>"
    )
    flat = F.map_filter(rec, lambda k, _: ~k.isin(*HIT_META))
    staged = pin(
        records,
        body=F.when(hit, body).otherwise(flat),
        _id=_non_empty_text(F.try_element_at(rec, F.lit("_id"))),
        _routing=_non_empty_text(F.try_element_at(rec, F.lit("_routing"))),
    )
    message = F.coalesce(
        F.col("error"),
        F.when(
            rec.isNotNull() & F.col("body").isNull(),
            line_error(F.col("line_no"), ": _source must be a JSON object"),
        ),
    )
    return staged.select(
        *META, "_id", "_routing", F.col("body").alias("rec"), message.alias("error")
    )


def read_records(
    spark: SparkSession,
    paths: str | list[str],
    numbering: str = "exact",
    detect: str = "both",
) -> DataFrame:
    """JSON lines below ``paths`` to the canonical frame, envelopes expanded."""
    return expand_envelopes(parse_lines(read_lines(spark, paths, numbering)), detect)


#: Lines of the first read of a sample, and characters that a sample holds at most.
FIRST_LINES, SAMPLE_CHARS = 64, 64 << 20


def read_first_records(
    spark: SparkSession, paths: str | list[str], n: int, detect: str = "both", most_lines: int | None = None
) -> tuple[DataFrame, DataFrame, int]:
    """``(good, bad, lines_read)``: the first ``n`` good records in order of file names and lines, the bad lines before them, and the cost.

    Files are read in order, one after another, and the lines of a file twice as many each time, until enough good records came: a
    sample of a large folder reads its beginning only.  ``most_lines`` and 64 million characters bound the sample, which the driver holds.
    """
    if n < 1:
        raise ValueError("a sample has at least one record")
    listed = spark.read.format("binaryFile").load([paths] if isinstance(paths, str) else list(paths)).select("path", "length")
    files = [r["path"] for r in listed.filter("length > 0").orderBy("path").collect()]
    held: list[tuple[str, int, str]] = []
    read = chars = good = 0
    for file in files:
        want, taken = FIRST_LINES, 0
        while good < n and chars < SAMPLE_CHARS and (most_lines is None or len(held) < most_lines):
            limit = want if most_lines is None else min(want, taken + most_lines - len(held))
            # Taking rows goes through a file's blocks from the front and stops when there are enough.
            rows = spark.read.text(file).take(limit)
            read += len(rows)
            fresh = [(file, i + 1, rows[i]["value"]) for i in range(taken, len(rows))]
            held += fresh
            chars += sum(len(x[2]) for x in fresh)
            lines = spark.createDataFrame(fresh, "file string, line_no bigint, value string")
            good += records_of(lines, detect).filter("error IS NULL").count() if fresh else 0
            taken = len(rows)
            if taken < limit or limit < want:
                break
            want *= 2
        if good >= n:
            break
    records = records_of(spark.createDataFrame(held, "file string, line_no bigint, value string"), detect)
    first = records.filter("error IS NULL").orderBy(*META).limit(n)
    last = first.agg(F.max(F.struct(*META)).alias("m")).head()["m"]
    bad = records.filter("error IS NOT NULL")
    return first, bad if last is None or good < n else bad.filter(F.struct(*META) < F.struct(*[F.lit(last[c]).cast(records.schema[c].dataType).alias(c) for c in META])), read


def records_of(lines: DataFrame, detect: str = "both") -> DataFrame:
    """The same for a frame that already is ``(file, line_no, value)``."""
    return expand_envelopes(parse_lines(lines), detect)


def _is_edge(rec: Column) -> Column:
    return F.map_contains_key(rec, "_type") & F.map_contains_key(rec, "_src")


def _graph_frame(records: DataFrame, own: Column, other: Column, fields: dict[str, Column]) -> DataFrame:
    """Lines of one kind with their fields; bad lines and lines of neither kind stay, with an error and without fields."""
    no = F.lit(False)
    mine = F.coalesce(own, no)
    error = F.coalesce(F.col("error"), F.when(~mine, line_error(F.col("line_no"), " is neither a node nor a relationship")))
    properties = F.try_variant_get(F.try_element_at("rec", F.lit("properties")), "$", "map<string,variant>")
    return records.filter(mine | ~F.coalesce(other, no)).select(
        *META,
        *[F.when(mine, c).alias(n) for n, c in {**fields, "properties": properties}.items()],
        error.alias("error"),
    )


def graph_nodes(records: DataFrame) -> DataFrame:
    """Node lines ``{_id, _labels, properties}`` to a node frame; relationships are left to :func:`graph_edges`."""
    rec = F.col("rec")
    labels = F.try_variant_get(F.try_element_at(rec, F.lit("_labels")), "$", "array<string>")
    fields = {"_id": as_text(F.try_element_at(rec, F.lit("_id"))), "_labels": labels}
    return _graph_frame(records, F.map_contains_key(rec, "_labels"), _is_edge(rec), fields)


def graph_edges(records: DataFrame) -> DataFrame:
    """Relationship lines ``{_id, _type, _src, _dst, properties}`` to an edge frame; nodes are left to :func:`graph_nodes`."""
    rec = F.col("rec")
    fields = {n: as_text(F.try_element_at(rec, F.lit(n))) for n in ("_id", "_type", "_src", "_dst")}
    node = F.map_contains_key(rec, "_labels") & ~F.coalesce(_is_edge(rec), F.lit(False))
    return _graph_frame(records, _is_edge(rec), node, fields)


def read_complete_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(file, line_no, value)``: what an interrupted writer finished of each file, blank lines left out.

    The pass that counts the lines of a block finds its first broken line too, so no file is parsed twice and no line is shuffled.
    """
    raw = raw_lines(spark, [paths] if isinstance(paths, str) else list(paths))
    value = F.col("value")
    parsed = raw.select("*", F.when(~is_blank(value), parse_wrapped(value)).alias("wrapped"))
    bad = F.when(~is_blank(value) & only_record(F.col("wrapped"), value).isNull(), F.col("mid"))
    blocks = block_table(parsed.select("file", "block", "mid", bad.alias("bad")), broken=F.min("bad"))
    first = blocks.groupBy("file").agg(F.min(F.col("broken") - F.col("first_mid") + F.col("before") + 1).alias("mark"))
    lines = numbered_lines(raw, blocks, first)
    return lines.filter(~is_blank(F.col("value")) & (F.col("mark").isNull() | (F.col("line_no") < F.col("mark")))).drop("mark")


def recover_complete_lines(lines: DataFrame) -> DataFrame:
    """Keep, per file, what an interrupted writer finished.

    Everything from the first line on that is no JSON object is discarded;
    blank lines do not count as broken.  The frame holds one row per file that
    has a broken line, so the join side stays far smaller than the lines.
    """
    broken = (
        parse_lines(lines)
        .groupBy("file")
        .agg(F.min(F.when(F.col("error").isNotNull(), F.col("line_no"))).alias("first_broken"))
        .filter(F.col("first_broken").isNotNull())
    )
    return (
        lines.filter(~is_blank(F.col("value")))
        .join(broken, "file", "left")
        .filter(F.col("first_broken").isNull() | (F.col("line_no") < F.col("first_broken")))
        .select("file", "line_no", "value")
    )
