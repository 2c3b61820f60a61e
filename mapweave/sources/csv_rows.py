"""CSV files in byte ranges, with row numbers, line breaks inside quotes included.

Whether a line break ends a record depends on all quotes before it. A first pass reads every range by itself and counts its
quotes and, for either state at its beginning, the records that end in it. Prefix sums of these few numbers give each range
its state and its first row number; the second pass then reads each range from its first record that begins there to the end
of the last one. So one file of any size is read by many tasks, and its rows are numbered as a plain reader numbers them.

Quotes stand around whole fields, a quote in a field is doubled. Records end in a line feed, with or without a carriage return before it
(elsewhere a carriage return stands in quotes); empty lines are no records. The first record names the columns; a field that a record lacks, or that is empty, is null. A byte order
mark is skipped. A file without records gives no rows.
"""

from __future__ import annotations

import csv
import io
import json
import os
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RANGE_BYTES = 32 << 20
_CHUNK = 1 << 20


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))


def list_files(path: str) -> list[tuple[str, int]]:
    """(name, size) of a file, or of all files below a folder but hidden ones."""
    fs, root = _filesystem(path)
    info = fs.get_file_info(root)
    if info.type == pafs.FileType.File:
        return [(root, info.size)]
    found = fs.get_file_info(pafs.FileSelector(root, recursive=True))
    return sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File and f.size and f.base_name[:1] not in "._")


def record_ends(data: bytes, quoted: bool, before: bytes) -> np.ndarray:
    """Places of the line feeds that end a record, if the bytes begin inside quotes or not; ``before``: the two bytes ahead of them."""
    raw = np.frombuffer(data, dtype=np.uint8)
    state = (np.cumsum(raw == 0x22) + quoted) % 2
    ends = np.flatnonzero((raw == 0x0A) & (state == 0))
    # a line feed right behind another (or behind that and a carriage return), or at the file's beginning, ends an empty line
    padded = np.frombuffer(b"\n\n"[len(before):] + before + data, dtype=np.uint8)
    one, two = padded[ends + 1], padded[ends]
    return ends[(one != 0x0A) & ~((one == 0x0D) & (two == 0x0A))]


@dataclass
class Range(InputPartition):
    file: str
    start: int
    stop: int
    quoted: bool = False
    row: int = 0


@dataclass
class Share(InputPartition):
    """Ranges that follow each other, read by one task."""
    ranges: list[Range]


def _ranges(files: Sequence[tuple[str, int]], size: int) -> list[Range]:
    return [Range(name, at, min(total, at + size)) for name, total in files for at in range(0, total, size)]


def _shares(ranges: Sequence[Range], tasks: int) -> list[Share]:
    """Short ranges and files are dealt together: a share has a ``tasks``-th of all bytes, RANGE_BYTES at most, or is one range."""
    bound = min(RANGE_BYTES, -(-sum(r.stop - r.start for r in ranges) // tasks))
    found, room = [], 0
    for r in ranges:
        if not found or r.stop - r.start > room:
            found.append(Share([]))
            room = bound
        found[-1].ranges.append(r)
        room -= r.stop - r.start
    return found or [Share([])]


class _Scan(DataSourceReader):
    def __init__(self, options):
        self.path, self.size, self.tasks = options["path"], int(options["rangeBytes"]), int(options.get("tasks", 1))

    def partitions(self) -> list[Share]:
        return _shares(_ranges(list_files(self.path), self.size), self.tasks)

    def read(self, share: Share) -> Iterator[tuple]:
        return map(self._scanned, share.ranges)

    def _scanned(self, part: Range) -> tuple:
        fs, _ = _filesystem(self.path)
        with fs.open_input_file(part.file) as file:
            ahead = min(2, part.start)
            data = file.read_at(part.stop - part.start + ahead, part.start - ahead)
        before, data = data[:ahead], data[ahead:]
        plain, inside = (len(record_ends(data, q, before)) for q in (False, True))
        ended = not part.start or before[-1:] == b"\n"
        empty = before[-1:] == b"\r" and before[:-1] in (b"", b"\n") and data[:1] == b"\n"
        return part.file, part.start, part.stop, data.count(b'"'), plain, inside, not (ended or empty)


class _Rows(DataSourceReader):
    def __init__(self, options):
        self.path, self.plan, self.tasks = options["path"], json.loads(options["plan"]), int(options.get("tasks", 1))
        self.columns, self.headers = json.loads(options["columns"]), json.loads(options["headers"])

    def __getstate__(self) -> dict:
        """What a task gets: its own share comes beside it, the plan of all ranges stays."""
        return {**self.__dict__, "plan": None}

    def partitions(self) -> list[Share]:
        return _shares([Range(*r) for r in self.plan], self.tasks)

    def _records(self, part: Range) -> bytes:
        """The bytes of the records that begin in the range."""
        fs, _ = _filesystem(self.path)
        with fs.open_input_file(part.file) as file:
            size = file.size()
            ahead = min(3, part.start)
            data = file.read_at(part.stop - part.start + ahead, part.start - ahead)
            before, data = data[:ahead], data[ahead:]
            state, at, tail = (data.count(b'"') + part.quoted) % 2, part.stop, b""
            ends = _all_ends(data, part.quoted)
            begin = 0
            if part.start and (part.quoted or before[-1:] != b"\n"):
                if not len(ends):
                    return b""  # the range lies inside one record
                begin = int(ends[0]) + 1
            if begin >= len(data):
                return b""
            if len(ends) and int(ends[-1]) + 1 == len(data):
                return data[begin:]
            while at < size:  # the last record goes on
                more = file.read_at(_CHUNK, at)
                found = _all_ends(more, bool(state))
                if len(found):
                    tail += more[: int(found[0]) + 1]
                    break
                tail, state, at = tail + more, (more.count(b'"') + state) % 2, at + len(more)
        return data[begin:] + tail

    def read(self, share: Share) -> Iterator[pa.RecordBatch]:
        kept = []
        for part in share.ranges:
            text = self._records(part).decode("utf-8-sig" if part.start == 0 else "utf-8", "replace")
            place = [self.headers[part.file].index(c) if c in self.headers[part.file] else None for c in self.columns]
            row = part.row
            for record in csv.reader(io.StringIO(text, newline="")):
                if record:
                    if row > 0:  # row 0 names the columns
                        kept.append((part.file, row - 1, *[(record[i] or None) if i is not None and i < len(record) else None for i in place]))
                    row += 1
                if len(kept) >= 10_000:
                    yield self._batch(kept)
                    kept = []
        if kept:
            yield self._batch(kept)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), *[pa.string()] * len(self.columns)]
        return pa.record_batch([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["file", "row_number", *self.columns])


def _all_ends(data: bytes, quoted: bool) -> np.ndarray:
    raw = np.frombuffer(data, dtype=np.uint8)
    return np.flatnonzero((raw == 0x0A) & ((np.cumsum(raw == 0x22) + quoted) % 2 == 0))


class CsvScan(DataSource):
    @classmethod
    def name(cls) -> str:
        return "csv_scan"

    def schema(self) -> str:
        return "file string, start long, stop long, quotes long, plain long, inside long, amid boolean"

    def reader(self, schema) -> _Scan:
        return _Scan(self.options)


class CsvRows(DataSource):
    @classmethod
    def name(cls) -> str:
        return "csv_rows"

    def schema(self) -> str:
        return ", ".join(["file string", "row_number long", *[f"`{c}` string" for c in json.loads(self.options["columns"])]])

    def reader(self, schema) -> _Rows:
        return _Rows(self.options)


def header_of(path: str, file: str) -> list[str]:
    """The names in a file's first record."""
    fs, _ = _filesystem(path)
    with fs.open_input_stream(file, compression=None) as stream:
        text = io.TextIOWrapper(stream, encoding="utf-8-sig", errors="replace", newline="")
        return next((r for r in csv.reader(text) if r), [])


def read_rows(spark: SparkSession, path: str, columns: Sequence[str], required: Sequence[str] = (), range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(file, row_number, columns): the rows of all CSV files at ``path``, numbered from 0 in each file; all columns as text, null
    where a file lacks them. A file without a ``required`` column is an error."""
    for source in (CsvScan, CsvRows):
        spark.dataSource.register(source)
    headers = {name: header_of(path, name) for name, _ in list_files(path)}
    for name, header in headers.items():
        missing = [c for c in required if c not in header]
        if missing:
            raise ValueError(f"{name}: missing required columns: {', '.join(missing)}")
    tasks = 2 * spark.sparkContext.defaultParallelism
    # a few numbers for each range
    scanned = spark.read.format("csv_scan").option("path", path).option("rangeBytes", range_bytes).option("tasks", tasks).load().orderBy("file", "start").collect()
    plan, at, quoted, row = [], None, 0, 0
    for r in scanned:
        if r["file"] != at:
            at, quoted, row = r["file"], 0, 0
        # a record that goes on into the range is the one after those that have ended; the next is the first to begin here
        plan.append([r["file"], r["start"], r["stop"], bool(quoted), row + int(bool(quoted) or r["amid"])])
        row += r["inside"] if quoted else r["plain"]
        quoted = (quoted + r["quotes"]) % 2
    reader = spark.read.format("csv_rows").option("path", path).option("plan", json.dumps(plan)).option("tasks", tasks)
    return reader.option("columns", json.dumps(list(columns))).option("headers", json.dumps(headers)).load()


def row_key(row_number: str) -> Column:
    """Name of a row in error messages: its line, if each record takes one and the header the first."""
    return F.concat(F.lit("row_"), (F.col(row_number) + 2).cast("string"))
