"""A streaming source that follows growing log files, line by line.

An offset names for every file its inode, the byte behind its last complete line, and a checksum of its first bytes.  So a file is known
again after it was renamed, a line that is still being written waits for its end, and a file that was cut and written anew
(shorter than before, or with another beginning) is read from its start.  Bytes between two offsets are read by tasks in
ranges; a batch that is run again reads the same bytes.  The folder must be mounted where the driver and the tasks run, as
logs that grow are; files that arrive whole in any store are followed by ``flows.stream_log_batches``.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

FORMAT = "growing_lines"
SCHEMA = "file string, position bigint, value string"
#: Bytes of a file by which it is known, of a read, and of a task.
HEAD, CHUNK, RANGE = 256, 64 << 10, 64 << 20
#: Rows and bytes of a batch that a task hands over.
_ROWS, _BYTES = 10_000, 4 << 20


def _head(path: str, length: int) -> int:
    with open(path, "rb") as f:
        return zlib.crc32(f.read(length))


def complete_end(path: str, size: int) -> int:
    """The byte behind the last line end among the first ``size`` bytes."""
    with open(path, "rb") as f:
        upto = size
        while upto > 0:
            at = max(0, upto - CHUNK)
            f.seek(at)
            found = f.read(upto - at).rfind(b"\n")
            if found >= 0:
                return at + found + 1
            upto = at
    return 0


def scan(folder: str) -> dict[str, dict]:
    """Every file of the folder by device and inode: name, end of its complete lines, checksum of its head."""
    found = {}
    for entry in sorted(os.scandir(folder), key=lambda e: e.name):
        if not entry.is_file() or entry.name.startswith((".", "_")):
            continue
        try:
            status = entry.stat()
            end = complete_end(entry.path, status.st_size)
            length = min(HEAD, end)
            found[f"{status.st_dev}:{status.st_ino}"] = {"name": entry.name, "end": end, "head": [length, _head(entry.path, length)]}
        except FileNotFoundError:
            continue
    return found


@dataclass
class Span(InputPartition):
    """Lines of a file that begin in [start, end); ``first`` is where reading began, which is the start of a line."""

    path: str
    first: int
    start: int
    end: int


def new_spans(folder: str, start: dict, end: dict) -> list[Span]:
    """What was added between two offsets."""
    spans = []
    for key, file in end["files"].items():
        path, done = os.path.join(folder, file["name"]), 0
        before = start["files"].get(key)
        if before is not None and before["end"] <= file["end"]:
            length, crc = before["head"]
            if length <= file["head"][0] and _head(path, length) == crc:
                done = before["end"]
        for at in range(done, file["end"], RANGE):
            spans.append(Span(path, done, at, min(at + RANGE, file["end"])))
    return spans


def read_span(span: Span) -> Iterator[tuple[int, bytes]]:
    """``(position, line)`` of the lines that begin in a span."""
    with open(span.path, "rb") as f:
        f.seek(span.start)
        if span.start > span.first:
            # A line that began before belongs to the span before.
            f.seek(span.start - 1)
            f.readline()
        while (at := f.tell()) < span.end:
            line = f.readline()
            if not line.endswith(b"\n"):
                return
            yield at, line[:-1].removesuffix(b"\r")


class _Reader(DataSourceStreamReader):
    def __init__(self, folder: str, from_end: bool) -> None:
        self.folder, self.from_end = folder, from_end

    def initialOffset(self) -> dict:  # noqa: N802
        return {"files": scan(self.folder) if self.from_end else {}}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"files": scan(self.folder)}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        return new_spans(self.folder, start, end)

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.string()]
        held: tuple[list, list] = ([], [])
        size = 0

        def batch() -> pa.RecordBatch:
            texts = [x.decode("utf-8", "replace") for x in held[1]]
            columns = [[partition.path] * len(texts), held[0], texts]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["file", "position", "value"])

        for at, line in read_span(partition):
            held[0].append(at)
            held[1].append(line)
            size += len(line)
            if len(held[0]) >= _ROWS or size >= _BYTES:
                yield batch()
                held, size = ([], []), 0
        if held[0]:
            yield batch()


class GrowingLines(DataSource):
    """``spark.readStream.format("growing_lines").option("start", "end").load(folder)``; ``start`` is ``begin`` (default) or ``end``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> _Reader:  # noqa: N802
        start = self.options.get("start", "begin")
        if start not in ("begin", "end"):
            raise ValueError(f"unknown start: {start}")
        return _Reader(self.options["path"].removeprefix("file://"), start == "end")
