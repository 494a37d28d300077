"""Message logs with offsets: a Spark data source over segmented, append-only files.

A topic is a folder with one folder for each of its partitions. A partition's messages have
offsets 0, 1, 2 …; they lie in segments that are never changed, named by their first offset
and the number of their messages:

    <topic>/<partition>/<first offset>-<count>.log      a line: arrival in ms, tab, message

So the end of a partition is known from the names alone, a range of offsets is the same rows
whenever it is read, and a stream goes on at the offsets in its checkpoint: what was planned
but not finished is read again, nothing is left out.

    register(spark)
    spark.readStream.format("message_log").load(path)
    df.write.format("message_log").mode("append").save(path)    # value [, partition]
"""

from __future__ import annotations

import sys
import time
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as files
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage,
)

SCHEMA = "value string, partition int, offset long, arrived timestamp"
#: Messages handed on together.
_ROWS = 1 << 13
_ARROW = pa.schema([("value", pa.string()), ("partition", pa.int32()), ("offset", pa.int64()), ("arrived", pa.timestamp("us", "UTC"))])

# the processes that plan a source know only what comes with it
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class Segment:
    path: str
    partition: int
    first: int
    count: int

    @property
    def end(self) -> int:
        return self.first + self.count


class Topic:
    """The files of one topic."""

    def __init__(self, path: str):
        self.files, self.path = files.FileSystem.from_uri(path) if "://" in path else (files.LocalFileSystem(), path)
        self.path = self.path.rstrip("/")

    def segments(self) -> dict[int, list[Segment]]:
        """Of each partition, in order."""
        out: dict[int, list[Segment]] = {}
        for f in self.files.get_file_info(files.FileSelector(self.path, recursive=True, allow_not_found=True)):
            folder, _, name = f.path.rpartition("/")
            part, numbers = folder.rpartition("/")[2], name.removesuffix(".log").split("-")
            if name.endswith(".log") and part.isdigit() and len(numbers) == 2:
                out.setdefault(int(part), []).append(Segment(f.path, int(part), int(numbers[0]), int(numbers[1])))
        return {p: sorted(s, key=lambda x: x.first) for p, s in sorted(out.items())}

    def ends(self) -> dict[int, int]:
        return {p: s[-1].end for p, s in self.segments().items()}

    def ranges(self, start: dict[int, int], end: dict[int, int]) -> list[Range]:
        """What lies between offsets, one range for each segment."""
        return [Range(s.path, p, s.first, max(s.first, start.get(p, 0)), min(s.end, end[p]))
                for p, own in self.segments().items() if p in end
                for s in own if s.first < end[p] and s.end > start.get(p, 0)]

    def read(self, r: Range) -> Iterator[pa.RecordBatch]:
        rows = []
        with self.files.open_input_stream(r.path) as source:
            for number, line in enumerate(_lines(source), r.first):
                if number >= r.end:
                    break
                if number >= r.start:
                    arrived, _, value = line.decode().partition("\t")
                    rows.append((value, r.partition, number, int(arrived) * 1000))
                if len(rows) == _ROWS:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)

    def stage(self, messages: Sequence[tuple[str, int]]) -> str:
        """Write messages (value, arrival in ms) to a file of their own that no reader sees."""
        self.files.create_dir(f"{self.path}/_staged", recursive=True)
        path = f"{self.path}/_staged/{uuid.uuid4().hex}"
        with self.files.open_output_stream(path) as out:
            # one line each: line ends inside a message are not part of JSON's values
            out.write("".join(f"{ms}\t{' '.join(value.splitlines())}\n" for value, ms in messages).encode())
        return path

    def publish(self, staged: Sequence[tuple[str, int, int]]) -> None:
        """Move staged files (path, partition, count) behind the ends of their partitions."""
        ends = self.ends()
        for path, partition, count in staged:
            first = ends.get(partition, 0)
            self.files.create_dir(f"{self.path}/{partition}", recursive=True)
            self.files.move(path, f"{self.path}/{partition}/{first:020d}-{count}.log")
            ends[partition] = first + count


@dataclass
class Range(InputPartition):
    path: str
    partition: int
    #: Offset of the segment's first message; offsets from ``start`` up to ``end`` are read.
    first: int
    start: int
    end: int


def _lines(source, size: int = 1 << 20) -> Iterator[bytes]:
    rest = b""
    while chunk := source.read(size):
        *whole, rest = (rest + chunk).split(b"\n")
        yield from whole


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


class MessageLogReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> Sequence[InputPartition]:
        topic = Topic(self.path)
        return topic.ranges({}, topic.ends())

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        return iter(()) if partition is None else Topic(self.path).read(partition)


class MessageLogStream(DataSourceStreamReader):
    """Offsets are the next message of each partition, as JSON keeps them: by the partition's name."""

    def __init__(self, path: str, starting: str, limit: int | None):
        self.path, self.starting, self.limit = path, starting, limit
        self.planned: dict[int, int] | None = None

    def initialOffset(self) -> dict:
        ends = Topic(self.path).ends()
        return {str(p): end if self.starting == "latest" else 0 for p, end in ends.items()}

    def latestOffset(self) -> dict:
        ends = Topic(self.path).ends()
        if self.limit and self.planned is not None:
            ends = {p: min(end, self.planned.get(p, 0) + self.limit) for p, end in ends.items()}
        elif self.limit and self.starting != "latest":
            ends = {p: min(end, self.limit) for p, end in ends.items()}
        return {str(p): end for p, end in ends.items()}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        self.planned = {int(p): n for p, n in end.items()}
        return Topic(self.path).ranges({int(p): n for p, n in start.items()}, self.planned)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return Topic(self.path).read(partition)

    def commit(self, end: dict) -> None:
        """The checkpoint holds the offsets; segments are not deleted here."""


@dataclass
class Staged(WriterCommitMessage):
    files: list[tuple[str, int, int]]


class MessageLogWriter(DataSourceArrowWriter):
    """Appends the rows of all tasks once all have been staged."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        topic, now, out = Topic(self.path), int(time.time() * 1000), []
        for batch in iterator:
            parts = batch.column("partition").to_pylist() if "partition" in batch.schema.names else [0] * batch.num_rows
            own: dict[int, list[tuple[str, int]]] = {}
            for value, p in zip(batch.column("value").to_pylist(), parts):
                own.setdefault(int(p or 0), []).append((value or "", now))
            out += [(topic.stage(rows), p, len(rows)) for p, rows in own.items()]
        return Staged(out)

    def commit(self, messages: list[Staged | None]) -> None:
        Topic(self.path).publish([f for m in messages if m is not None for f in m.files])

    def abort(self, messages: list[Staged | None]) -> None:
        topic = Topic(self.path)
        for m in messages:
            for path, _, _ in m.files if m is not None else ():
                topic.files.delete_file(path)


class MessageLog(DataSource):
    """Options: ``startingOffsets`` (earliest or latest) and ``maxOffsetsPerTrigger`` for each partition."""

    @classmethod
    def name(cls) -> str:
        return "message_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return MessageLogReader(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        limit = self.options.get("maxOffsetsPerTrigger")
        return MessageLogStream(self.options["path"], self.options.get("startingOffsets", "earliest"), int(limit) if limit else None)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return MessageLogWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MessageLog)
