"""Lines of snapshots as a Spark data source: batch and stream by byte ranges of files, and a sink that keeps each micro-batch once.

The folder is any that pyarrow reads and that driver and executors share. Rows are (file, offset, value), with the offset in
bytes at which the line begins. A task reads `split` bytes, and the line that begins in them last to its end, so a line longer
than a split is one task's. Invalid UTF-8 is replaced; empty lines are rows; names that begin with _ or . are left out.

A stream takes files in the order of their names: only the last may still grow, and of it whole lines alone are read. Its
offset is a name and a place, however many files there are. The sink's tasks write files that nothing refers to yet; the
driver then names them in a manifest of the batch's number. A batch that comes again, since a query died between the
manifest and Spark's own log, finds its manifest and is dropped. Reading the sink's folder reads what manifests name.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, InputPartition, WriterCommitMessage

NAME, SCHEMA, MANIFESTS = "snapshot_lines", "file string, offset long, value string", "_batches"
SPLIT, CHUNK, ROWS = 64 << 20, 1 << 20, 4000


def place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def sizes(path: str) -> dict[str, int]:
    """Bytes of each file in the folder by name, in order."""
    of, root = place(path)
    found = of.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return {i.base_name: i.size for i in sorted(found, key=lambda i: i.base_name) if i.type == fs.FileType.File and i.base_name[0] not in "_."}


def manifests(path: str) -> list[str] | None:
    """The sink's files that batches name, or None where no sink has written."""
    of, root = place(path)
    if of.get_file_info(f"{root}/{MANIFESTS}").type != fs.FileType.Directory:
        return None
    found = [i.path for i in of.get_file_info(fs.FileSelector(f"{root}/{MANIFESTS}")) if i.base_name[0] not in "_."]
    return [name for p in sorted(found) for name in json.loads(of.open_input_stream(p).read())]


def lines(f: pa.NativeFile, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines that begin at start or behind it and before stop."""
    at, skip, held = max(0, start - 1), start > 0, b""
    f.seek(at)
    while chunk := f.read(max(CHUNK, len(held))):
        *whole, held = (held + chunk).split(b"\n")
        for line in whole:
            if not skip:
                if at >= stop:
                    return
                yield at, line
            skip, at = False, at + len(line) + 1
        if at >= stop and not skip:
            return
    if held and not skip and at < stop:
        yield at, held


@dataclass
class Range(InputPartition):
    file: str
    start: int
    stop: int


class Ranges:
    """What batch and stream readers share."""

    def __init__(self, options: dict):
        self.path, self.split = options["path"].rstrip("/"), int(options.get("split", SPLIT))

    def ranges(self, file: str, start: int, stop: int) -> list[Range]:
        return [Range(file, a, min(stop, a + self.split)) for a in range(start, stop, self.split)]

    def read(self, part: Range | None) -> Iterator[pa.RecordBatch]:
        """A folder without bytes has one task, without a range."""
        if part is None:
            return
        of, root = place(self.path)
        held, size = [], 0
        with of.open_input_file(f"{root}/{part.file}") as f:
            for at, line in lines(f, part.start, part.stop):
                held.append((at, line.decode("utf-8", "replace")))
                size += len(line)
                if len(held) >= ROWS or size >= CHUNK:
                    yield self.batch(part.file, held)
                    held, size = [], 0
        if held:
            yield self.batch(part.file, held)

    def batch(self, file: str, held: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([file] * len(held), pa.string()), pa.array([a for a, _ in held], pa.int64()), pa.array([v for _, v in held], pa.string())], ["file", "offset", "value"])


class BatchReader(Ranges, DataSourceReader):
    def partitions(self) -> list[Range]:
        known, named = sizes(self.path), manifests(self.path)
        return [r for file in (known if named is None else named) for r in self.ranges(file, 0, known[file])]


class StreamReader(Ranges, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"file": "", "at": 0}

    def latestOffset(self) -> dict:
        """The end of the last whole line of the last file."""
        if manifests(self.path) is not None:
            raise ValueError("a sink's folder is read in batch: its files' names aren't in order")
        known = sizes(self.path)
        if not known:
            return self.initialOffset()
        file, at = list(known.items())[-1]
        of, root = place(self.path)
        with of.open_input_file(f"{root}/{file}") as f:
            while at:
                start = max(0, at - CHUNK)
                f.seek(start)
                if (found := f.read(at - start).rfind(b"\n")) >= 0:
                    return {"file": file, "at": start + found + 1}
                at = start
        return {"file": file, "at": 0}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        inside = {f: n for f, n in sizes(self.path).items() if start["file"] <= f <= end["file"]}
        return [r for f, n in inside.items() for r in self.ranges(f, start["at"] if f == start["file"] else 0, end["at"] if f == end["file"] else n)]


@dataclass
class Written(WriterCommitMessage):
    file: str | None


class StreamWriter(DataSourceStreamWriter):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")

    def write(self, rows: Iterator) -> Written:
        first = next(rows, None)
        if first is None:
            return Written(None)
        (of, root), name = place(self.path), f"part-{uuid.uuid4().hex}.jsonl"
        of.create_dir(root)
        with of.open_output_stream(f"{root}/{name}") as out:
            row = first
            while row is not None:
                if row[0] is None or "\n" in row[0]:
                    raise ValueError("a record must be one line")
                out.write(row[0].encode() + b"\n")
                row = next(rows, None)
        return Written(name)

    def commit(self, messages: list, batchId: int) -> None:
        of, root = place(self.path)
        mine = f"{root}/{MANIFESTS}/{batchId:020d}.json"
        if of.get_file_info(mine).type == fs.FileType.File:
            return self.abort(messages, batchId)
        of.create_dir(f"{root}/{MANIFESTS}")
        draft = f"{root}/{MANIFESTS}/.{uuid.uuid4().hex}"
        with of.open_output_stream(draft) as out:
            out.write(json.dumps([m.file for m in messages if m and m.file]).encode())
        of.move(draft, mine)

    def abort(self, messages: list, batchId: int) -> None:
        of, root = place(self.path)
        for m in messages:
            if m and m.file:
                of.delete_file(f"{root}/{m.file}")


class SnapshotLines(DataSource):
    """Options: path, and split (bytes a task reads). A stream's sink takes rows of one text column."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BatchReader:
        return BatchReader(self.options)

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(self.options)

    def streamWriter(self, schema, overwrite: bool) -> StreamWriter:
        return StreamWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SnapshotLines)
