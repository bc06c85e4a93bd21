"""Feedback as JSON lines behind Spark's data source interface: `spark.read.format("feedback_jsonl")` and its stream.

A folder holds files whose names ascend; only the last may still grow. Batch reads cut files into ranges of bytes. A
stream's offset is the last file and the bytes read of it, so it stays small and a restarted stream goes on where its
checkpoint ends: complete lines only, none twice. A sink writes hidden files first; the commit gives them their names, an
abort removes them, and a stream's batch that is committed again leaves what it has committed before.

Lines that are no JSON object of the schema's names give nulls for what is missing, and a line that is no JSON at all gives
a row of nulls, so nothing vanishes. Empty lines are no rows. The folder is one that driver and executors share.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import BooleanType, LongType, StringType, StructType

from assay.session import ship

SPLIT = 32 << 20
SCHEMA = "scan_id string, agree boolean, note string, at string"


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _files(path: str) -> list[tuple[str, int]]:
    """(name, bytes) of the visible files, in order of their names."""
    store, root = _place(path)
    found = store.get_file_info(pafs.FileSelector(root, allow_not_found=True))
    return sorted((f.base_name, f.size) for f in found if f.is_file and f.base_name[0] not in "._")


@dataclass
class Range(InputPartition):
    name: str
    start: int
    stop: int


class _Lines:
    """Rows of byte ranges."""

    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path, self.split = schema, options["path"], int(options.get("split", SPLIT))

    def ranges(self, name: str, start: int, stop: int) -> list[Range]:
        return [Range(name, at, min(at + self.split, stop)) for at in range(start, stop, self.split)]

    def rows(self, part: Range) -> Iterator[tuple]:
        """The lines whose first byte lies in the range."""
        store, root = _place(self.path)
        with store.open_input_file(f"{root}/{part.name}") as f:
            at = part.start
            f.seek(max(at - 1, 0))
            if at and f.read(1) != b"\n":  # in the middle of a line that the range before reads
                at += len(self._line(f))
            else:
                f.seek(at)
            while at < part.stop:
                line = self._line(f)
                if not line:
                    return
                at += len(line)
                if line.strip():
                    yield self.parse(line)

    @staticmethod
    def _line(f) -> bytes:
        out = b""
        while piece := f.read(1 << 12):
            end = piece.find(b"\n")
            if end >= 0:
                f.seek(f.tell() - len(piece) + end + 1)
                return out + piece[: end + 1]
            out += piece
        return out

    def parse(self, line: bytes) -> tuple:
        try:
            record = json.loads(line)
        except ValueError:
            record = None
        record = record if isinstance(record, dict) else {}

        def fit(value, kind):
            if isinstance(kind, BooleanType):
                return value if isinstance(value, bool) else None
            if isinstance(kind, LongType):
                return value if isinstance(value, int) and not isinstance(value, bool) else None
            return value if isinstance(value, str) else None if value is None else json.dumps(value)

        return tuple(fit(record.get(f.name), f.dataType) for f in self.schema.fields)


class BatchReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.lines = _Lines(schema, options)

    def partitions(self) -> list[Range]:
        return [r for name, size in _files(self.lines.path) for r in self.lines.ranges(name, 0, size)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        return self.lines.rows(partition) if partition.name else iter(())


class StreamReader(DataSourceStreamReader):
    def __init__(self, schema: StructType, options: dict):
        self.lines = _Lines(schema, options)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"file": "", "at": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        """The end of the last complete line of the last file."""
        files = _files(self.lines.path)
        if not files:
            return self.initialOffset()
        name, size = files[-1]
        store, root = _place(self.lines.path)
        with store.open_input_file(f"{root}/{name}") as f:
            end = size
            while end:  # back over a line that is still being written
                start = max(0, end - (1 << 16))
                f.seek(start)
                found = f.read(end - start).rfind(b"\n")
                if found >= 0:
                    return {"file": name, "at": start + found + 1}
                end = start
        return {"file": name, "at": 0}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for name, size in _files(self.lines.path):
            if start["file"] <= name <= end["file"]:
                out += self.lines.ranges(name, start["at"] if name == start["file"] else 0, end["at"] if name == end["file"] else size)
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        return self.lines.rows(partition)


@dataclass
class Written(WriterCommitMessage):
    name: str


class _Sink:
    def __init__(self, schema: StructType, options: dict, overwrite: bool = False):
        self.names, self.path, self.overwrite = schema.names, options["path"], overwrite
        self.kinds = [type(f.dataType) for f in schema.fields]
        if any(k not in (StringType, BooleanType, LongType) for k in self.kinds):
            raise ValueError("feedback has columns of strings, booleans and longs")

    def write(self, iterator: Iterator) -> Written:
        store, root = _place(self.path)
        store.create_dir(root)
        name = f"_{uuid.uuid4().hex}"
        with store.open_output_stream(f"{root}/{name}") as out:
            for row in iterator:
                out.write(json.dumps({k: v for k, v in zip(self.names, row, strict=True) if v is not None}, ensure_ascii=False).encode() + b"\n")
        return Written(name)

    def publish(self, messages: list, prefix: str) -> None:
        store, root = _place(self.path)
        done = {n for n, _ in _files(self.path) if n.startswith(prefix)}
        old = [n for n, _ in _files(self.path)] if self.overwrite else []
        for i, m in enumerate(messages):
            if m is None:
                continue
            target = f"{prefix}-{i:06d}.jsonl"
            if target in done:
                store.delete_file(f"{root}/{m.name}")
            else:
                store.move(f"{root}/{m.name}", f"{root}/{target}")
        for n in old:
            store.delete_file(f"{root}/{n}")

    def discard(self, messages: list) -> None:
        store, root = _place(self.path)
        for m in messages:
            if m is not None and store.get_file_info(f"{root}/{m.name}").is_file:
                store.delete_file(f"{root}/{m.name}")


class BatchWriter(_Sink, DataSourceWriter):
    def commit(self, messages: list) -> None:
        """Names go on from those that are there, so that a stream of the folder reads on."""
        last = max((int(n.split("-")[1]) for n, _ in _files(self.path) if n.startswith("feedback-")), default=-1)
        self.publish(messages, f"feedback-{last + 1:010d}")

    def abort(self, messages: list) -> None:
        self.discard(messages)


class StreamWriter(_Sink, DataSourceStreamWriter):
    def commit(self, messages: list, batchId: int) -> None:  # noqa: N803
        self.publish(messages, f"feedback-{batchId:010d}")

    def abort(self, messages: list, batchId: int) -> None:  # noqa: N803
        self.discard(messages)


class FeedbackSource(DataSource):
    """Options: path, and split (bytes of a range)."""

    @classmethod
    def name(cls) -> str:
        return "feedback_jsonl"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return BatchReader(schema, self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return StreamReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return BatchWriter(schema, self.options, overwrite)

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:  # noqa: N802
        return StreamWriter(schema, self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to the session; workers get the package."""
    ship(spark)
    spark.dataSource.register(FeedbackSource)
