"""The two continuous flows: resumable ingest and the log tail, with their metrics."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from recordloom.plans.import_plan import ImportSpec, import_once
from recordloom.session import scratch
from recordloom.sinks.keyed import KeyedTable, Store
from recordloom.sources.records import META, read_records
from recordloom.streaming.tail import FORMAT, GrowingLines

LOG_FIELDS = ("timestamp", "level", "service", "message")


def arriving_files(spark: SparkSession, directory: str, files_per_trigger: int) -> DataFrame:
    """``(file, bytes)`` of each file that arrives.  Only paths and sizes are asked for, so files are listed here but read in the batch."""
    return (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("maxFilesPerTrigger", files_per_trigger)
        .load(directory)
        .select(F.col("path").alias("file"), F.col("length").alias("bytes"))
    )


def stream_ingest(
    spark: SparkSession,
    directory: str,
    target: str,
    dead_letters: str,
    checkpoint: str,
    spec: ImportSpec,
    files_per_trigger: int = 1000,
    on_batch: Callable[[int, dict], None] | None = None,
) -> StreamingQuery:
    """Import the JSONL files that arrive in ``directory`` until none is left.

    The stream only tracks which files are new; the cursor is its checkpoint,
    written after the data.  Each micro-batch writes its own ``batch=`` folder in
    overwrite mode, so a batch that is run again replaces itself: every
    ``(file, line, row)`` is stored exactly once.  Line numbers are exact, since
    a batch is made of whole files.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        # Names of the new files of one trigger: bounded by files_per_trigger.
        began = time.monotonic()
        found = {r["file"]: r["bytes"] for r in batch.collect()}
        files = list(found)
        if not files:
            return
        good, dead, counts = import_once(read_records(session, files), spec, scratch(session, "ingest"))
        good.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")
        dead.write.mode("overwrite").parquet(f"{dead_letters}/batch={batch_id}")
        if on_batch:
            on_batch(batch_id, {**counts, "bytes": sum(found.values()), "seconds": time.monotonic() - began})

    return (
        arriving_files(spark, directory, files_per_trigger).writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_ingest_keyed(
    spark: SparkSession,
    directory: str,
    table: KeyedTable,
    dead_letters: str,
    checkpoint: str,
    spec: ImportSpec,
    policy: str = "skip",
    files_per_trigger: int = 1000,
    on_batch: Callable[[int, dict], None] | None = None,
) -> StreamingQuery:
    """Import the JSONL files that arrive in ``directory`` into a keyed table, under a conflict policy, until none is left.

    Rows, batch number and names of the files read are committed in one version of the table.  A batch that died before it is run
    again from the start, as none of it shows; one that died after it, before the stream noted it, is recognised by its number.
    Rows, skipped rows, files, bytes and seconds of all batches add up there too (``table.progress()``), whatever was restarted in between.
    If the checkpoint is lost, files whose rows are in the table are not read again.  Of rows with one key the order of
    file, line and row decides; an update leaves columns alone that a record does not have.
    Dead letters of a batch go to the folder of the version it becomes, which a batch that is run again overwrites.
    """
    store = Store(spark, checkpoint)
    if store.text("stream-id") is None:
        store.publish("stream-id", uuid.uuid4().hex)
    stream = store.text("stream-id")

    def write(batch: DataFrame, batch_id: int) -> None:
        if table.committed(stream) >= batch_id:
            return
        session = batch.sparkSession
        # Names of the new files of one trigger: bounded by files_per_trigger.
        began = time.monotonic()
        found = {r["file"]: r["bytes"] for r in batch.join(table.sources(), "file", "left_anti").collect()}
        files = sorted(found)
        if not files:
            return
        version = table.state()["version"] + 1
        good, dead, counts = import_once(read_records(session, files), spec, scratch(session, "ingest"), presence="_present")
        rows = good.withColumn("_seq", F.struct(*META)).drop(*META)
        dead.write.mode("overwrite").parquet(f"{dead_letters}/version={version}")
        named = session.createDataFrame([(f,) for f in files], "file string")
        commit = {"stream": stream, "batch": batch_id, "sources": table.put_sources(named.coalesce(1))}
        commit["progress"] = {**{k: counts[k] or 0 for k in ("rows", "skipped", "lines")}, "files": len(files), "bytes": sum(found.values()), "seconds": time.monotonic() - began}
        presence = "_present" if policy == "update" else None
        done = table.write(rows if presence else rows.drop("_present"), policy, "_seq", presence, commit, stored=True)
        if on_batch:
            on_batch(batch_id, {**counts, **commit["progress"], **done})

    return (
        arriving_files(spark, directory, files_per_trigger).writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def parse_log_lines(lines: DataFrame) -> DataFrame:
    """Structured log lines: the fixed fields, everything else in ``fields``."""
    rec = F.from_json("value", "map<string,variant>")
    staged = lines.filter(F.col("value").rlike(r"\S")).select("value", rec.alias("rec"))
    text = lambda n: F.try_variant_get(F.try_element_at("rec", F.lit(n)), "$", "string").alias(n)
    rest = F.map_filter("rec", lambda k, _: ~k.isin(*LOG_FIELDS))
    return staged.select(
        *[text(n) for n in LOG_FIELDS],
        F.transform_values(rest, lambda _, v: F.try_variant_get(v, "$", "string")).alias("fields"),
        "value",
    )


def stream_log_batches(
    spark: SparkSession,
    directory: str,
    checkpoint: str,
    deliver: Callable[[DataFrame, int], None],
    interval: str | None = "5 seconds",
    since: datetime | None = None,
) -> StreamingQuery:
    """Hand over new, non-blank log lines, one batch per interval.

    A batch whose delivery raises stays uncommitted and is handed over again on
    the next start.  ``since`` leaves out log files last written before it: the
    way to begin at the current end of a log.  ``interval=None`` drains what
    there is and stops.
    """
    lines = spark.readStream.format("text").load(directory).filter(F.col("value").rlike(r"\S"))
    if since is not None:
        lines = lines.filter(F.col("_metadata.file_modification_time") >= F.lit(since)).select("value")

    def hand_over(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            deliver(parse_log_lines(batch), batch_id)

    writer = lines.writeStream.foreachBatch(hand_over).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.start()


def stream_log_growing(
    spark: SparkSession,
    directory: str,
    checkpoint: str,
    deliver: Callable[[DataFrame, int], None],
    interval: str | None = "5 seconds",
    start: str = "end",
) -> StreamingQuery:
    """Hand over the lines that are added to the log files of a folder, one batch per interval, see :mod:`recordloom.streaming.tail`.

    The first start begins at the current end of each file (``start="begin"``: at its beginning); later ones go on where the
    checkpoint is.  ``interval=None`` drains what there is and stops.
    """
    spark.dataSource.register(GrowingLines)
    lines = spark.readStream.format(FORMAT).option("start", start).load(directory).filter(F.col("value").rlike(r"\S"))

    def hand_over(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            deliver(parse_log_lines(batch), batch_id)

    writer = lines.writeStream.foreachBatch(hand_over).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def with_progress(df: DataFrame, name: str = "progress") -> tuple[DataFrame, Observation]:
    """Count rows, lines and skipped records while the frame is written."""
    seen = Observation(name)
    failed = F.col("error").isNotNull() if "error" in df.columns else F.lit(False)
    measures = [F.count(F.lit(1)).alias("seen"), F.count_if(failed).alias("skipped")]
    if all(c in df.columns for c in META):
        measures.append(F.max("line_no").alias("lines"))
    return df.observe(seen, *measures), seen


def line_bytes(lines: DataFrame) -> DataFrame:
    """``(file, bytes)`` of numbered lines, line ends included: one sum a file, taken by the tasks that read it."""
    return lines.groupBy("file").agg(F.sum(F.octet_length("value").cast("bigint") + 1).alias("bytes"))


def progress_metrics(records: DataFrame) -> DataFrame:
    """``(file, rows, lines, skipped)`` per file of a converted frame; join :func:`line_bytes` for the bytes of its lines."""
    return records.groupBy("file").agg(
        F.count_if(F.col("error").isNull()).alias("rows"),
        F.max("line_no").alias("lines"),
        F.count_if(F.col("error").isNotNull()).alias("skipped"),
    )


class ProgressLog(StreamingQueryListener):
    """Keeps rows and duration of every finished micro-batch."""

    def __init__(self) -> None:
        self.batches: list[dict] = []

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self.batches.append(
            {"batch": p.batchId, "rows": p.numInputRows, "duration_ms": dict(p.durationMs).get("triggerExecution", 0)}
        )

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass
