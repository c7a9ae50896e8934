"""Statements as a data source of Spark's own: ``spark.read.format("mt940")`` and ``spark.readStream.format("mt940")``.

A row is one statement: its file, the byte that it begins at, and its text.  Files are cut by ranges of bytes: a range has the
statements that begin in it, and is read on to the end of the last; short ranges and small files share a partition.  Files are read by pyarrow, so a path may be
local or in any store that pyarrow knows.  ``read_mt940`` makes movements of such rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ledgerloom.sources import statements

SPLIT = 16 << 20
BLOCK, LEAST = 1 << 20, 1 << 12
#: Partitions that files are spread over before these hold more than one range.
SPREAD = 256
#: A statement begins with a line of this tag.
BEGIN = re.compile(rb"(?:^|(?<=\n)|(?<=\r)):20:")
SCHEMA = "path string, begin long, text string"


class Range(NamedTuple):
    path: str
    begin: int
    end: int


class Ranges(InputPartition):
    def __init__(self, parts: list[Range]) -> None:
        self.parts = parts


def listed(uri: str) -> tuple[fs.FileSystem, list[fs.FileInfo]]:
    """The files at a path or in a folder, in the order of (time, name); names that begin with a dot or an underscore are passed over."""
    system, path = fs.FileSystem.from_uri(uri)
    info = system.get_file_info(path)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(uri)
    found = [info] if info.is_file else system.get_file_info(fs.FileSelector(path, recursive=True))
    kept = [f for f in found if f.is_file and not f.base_name.startswith((".", "_"))]
    return system, sorted(kept, key=lambda f: (f.mtime_ns or 0, f.path))


def ranges(files: list[fs.FileInfo], split: int) -> list[Range]:
    return [Range(f.path, begin, min(begin + split, f.size)) for f in files for begin in range(0, f.size, split)]


def shared(parts: list[Range]) -> list[Ranges]:
    """Ranges in order, those of up to a share of all bytes, at most ``SPLIT``, in one partition."""
    size = lambda p: p.end - p.begin
    most, out, held = min(SPLIT, sum(map(size, parts)) // SPREAD), [], 0
    for p in parts:
        if not out or held + size(p) > most:
            out.append([])
            held = 0
        out[-1].append(p)
        held += size(p)
    return [Ranges(p) for p in out]


def statements_in(source: pa.NativeFile, begin: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(place, bytes) of the statements that begin within [begin, end).  A range is read from one byte before it, to see the end of line there."""
    at = max(begin - 1, 0)
    source.seek(at)
    held, first = b"", None  # bytes from ``at`` on; where in them the open statement begins
    while True:
        block = source.read(min(BLOCK, max(end - at - len(held), LEAST)))
        held += block
        last = len(held) if not block else len(held) - 4  # a tag may be cut by the block's end
        place = 0 if first is None else first + 1
        for found in BEGIN.finditer(held, place):
            if found.start() >= last or (found.start() == 0 and at > 0 and first is None):
                continue
            if first is not None:
                yield at + first, held[first:found.start()]
            first = found.start()
            if at + first >= end:
                return
        if not block:
            if first is not None:
                yield at + first, held[first:]
            return
        if first is None:
            if at + last >= end:
                return
            at, held = at + max(last - 1, 0), held[max(last - 1, 0):]
        else:
            at, held, first = at + first, held[first:], 0


def _read(uri: str, parts: list[Range]) -> Iterator[tuple[str, int, str]]:
    system, _ = fs.FileSystem.from_uri(uri)
    for path, own in groupby(parts, key=lambda p: p.path):
        with system.open_input_file(path) as source:
            for part in own:
                for begin, raw in statements_in(source, part.begin, part.end):
                    try:
                        text = raw.decode()
                    except UnicodeDecodeError:
                        text = raw.decode("cp1252", "replace")
                    yield path, begin, text


class _Files:
    def __init__(self, options: dict[str, str]) -> None:
        self.uri, self.split = options["path"], int(options.get("splitBytes", SPLIT))

    def read(self, partition: Ranges) -> Iterator[tuple[str, int, str]]:
        return _read(self.uri, partition.parts)


class _Batch(_Files, DataSourceReader):
    def partitions(self) -> list[Ranges]:
        return shared(ranges(listed(self.uri)[1], self.split))


class _Stream(_Files, DataSourceStreamReader):
    """An offset is the (time, name) of the last file; a file that appears with an earlier one is not seen."""

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        files = listed(self.uri)[1]
        return {"time": files[-1].mtime_ns or 0, "path": files[-1].path} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        mark = lambda o: (o["time"], o["path"])
        return shared(ranges([f for f in listed(self.uri)[1] if mark(start) < (f.mtime_ns or 0, f.path) <= mark(end)], self.split))


class Mt940Source(DataSource):
    """Options: ``path``, a file or a folder; ``splitBytes``, of a range."""

    @classmethod
    def name(cls) -> str:
        return "mt940"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Mt940Source)


def read_folder(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Movements of all statements in a folder, each statement by its own name: its file's and its first byte."""
    register(spark)
    rows = spark.read.format("mt940").options(**options).load(path)
    return statements.read_mt940(rows.select(F.concat_ws("#", "path", "begin").alias("path"), "text"))
