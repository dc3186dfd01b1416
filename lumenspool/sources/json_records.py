"""A data source for typed JSON records in line files: ``spark.read.format("json_records")``.

Options: path (a folder or file), kind (``packet`` or ``annotation``), max_bytes of a record, split_bytes. A file is
read in byte ranges, a task each; a range owns the lines that start in it. Every line gives a row: record (the JSON
text) if it is of the kind asked for, else reason. A line beyond max_bytes is skipped over, not held, and gives a
row as well. Filters on ``file`` (= and IN) are taken over by the source, so other files are not opened.

Defined cases: blank lines are no records; bytes that are no UTF-8, no JSON or no object are rows with a reason; a file
without a last line break ends its last record; an empty folder gives an empty table; a missing path is an error.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

SCHEMA = "file string, start bigint, bytes bigint, candidate_id string, record string, reason string"
#: Fields that a record of a kind must have, and what they must be.
KINDS: dict[str, dict[str, type | tuple[type, ...]]] = {
    "packet": {"candidate_id": str, "frames": list, "questions": list, "max_span_ms": int},
    "annotation": {"candidate_id": str, "visual_state": str, "claims": list, "frame_ids": list},
}
_NAMES = {str: "text", list: "list", int: "number"}


def fault(raw: bytes, kind: str) -> tuple[str | None, dict | None]:
    """(reason, record): why a line is no record of the kind, or the record."""
    try:
        record = json.loads(raw.decode("utf-8"))
    except UnicodeDecodeError:
        return "not utf-8", None
    except (ValueError, RecursionError):
        return "not json", None
    if not isinstance(record, dict):
        return "not an object", None
    for name, kind_of in KINDS[kind].items():
        if name not in record:
            return f"missing {name}", record
        if not isinstance(record[name], kind_of) or isinstance(record[name], bool):
            return f"{name} is no {_NAMES[kind_of]}", record
    if any(not isinstance(f, dict) or not isinstance(f.get("frame_id"), str) for f in record.get("frames", [])):
        return "frame without frame_id", record
    return None, record


@dataclass
class Range(InputPartition):
    file: str
    start: int
    end: int


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class RecordReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.kind = options["path"], options.get("kind", "packet")
        if self.kind not in KINDS:
            raise ValueError(f"unknown kind of records: {self.kind}")
        self.max_bytes, self.split_bytes = int(options.get("max_bytes", 2 << 20)), int(options.get("split_bytes", 64 << 20))
        self.files: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("file",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.files = wanted if self.files is None else self.files & wanted
            else:
                yield f

    def partitions(self) -> list[Range]:
        from pyarrow import fs

        system, path = _system(self.path)
        info = system.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.is_file else [x for x in system.get_file_info(fs.FileSelector(path, recursive=True)) if x.is_file and not x.base_name.startswith(("_", "."))]
        found = [x for x in found if self.files is None or x.base_name in self.files]
        return [Range(x.path, at, min(at + self.split_bytes, x.size)) for x in sorted(found, key=lambda x: x.path) for at in range(0, x.size, self.split_bytes)]

    def _lines(self, part: Range) -> Iterator[tuple[int, int, bytes | None]]:
        """(start, length, bytes) of the lines that start in a range; bytes is None where a line is longer than max_bytes."""
        system, _ = _system(self.path)
        with system.open_input_file(part.file) as f:
            size = f.size()
            at = part.start
            if at:  # the line that reaches into the range belongs to the range before
                f.seek(at - 1)
                while at - 1 < size:
                    piece = f.read(1 << 16)
                    cut = piece.find(b"\n")
                    if cut >= 0:
                        at += cut
                        break
                    if not piece:
                        return
                    at += len(piece)
            f.seek(at)
            held, length, whole = [], 0, True
            while at < part.end:
                piece = f.read(1 << 16)
                if not piece:
                    if length:
                        yield at, length, b"".join(held) if whole else None
                    return
                pos = 0
                while at < part.end:
                    cut = piece.find(b"\n", pos)
                    chunk = piece[pos:] if cut < 0 else piece[pos:cut]
                    length += len(chunk)
                    whole = whole and length <= self.max_bytes
                    held = [*held, chunk] if whole else []
                    if cut < 0:
                        break
                    yield at, length, b"".join(held) if whole else None
                    at, pos = at + length + 1, cut + 1
                    held, length, whole = [], 0, True

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        name, rows, held = part.file.rsplit("/", 1)[-1], [], 0
        fields = ["file", "start", "bytes", "candidate_id", "record", "reason"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        batch = lambda: pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=fields)
        for start, length, raw in self._lines(part):
            if raw is None:
                rows.append((name, start, length, None, None, "too large"))
            elif raw.strip():
                reason, record = fault(raw, self.kind)
                candidate = record.get("candidate_id") if record else None
                rows.append((name, start, length, candidate if isinstance(candidate, str) else None, raw.decode() if reason is None else None, reason))
                held += length
            if len(rows) >= 4096 or held >= 8 << 20:
                yield batch()
                rows, held = [], 0
        if rows:
            yield batch()


class JsonRecords(DataSource):
    @classmethod
    def name(cls) -> str:
        return "json_records"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RecordReader:
        return RecordReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the source known to a session; filters on the file reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(JsonRecords)
