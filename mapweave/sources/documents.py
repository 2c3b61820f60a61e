"""One file out of ordered lines: a Spark data source whose tasks write parts and whose commit joins them.

Tasks write their lines as parts beside the file and report how many bytes each part has. The commit adds the lengths up, copies the parts
in the order of their tasks into a hidden file, a buffer at a time, holds its length against the sum and gives it the
file's name in one move. Parts of tasks that were tried again are never listed, so no line is doubled; a failed job leaves no file.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

_BUFFER = 8 << 20


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))


@dataclass
class _Part(WriterCommitMessage):
    number: int
    name: str
    size: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path
        self.parts = f"{path}.parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = _filesystem(self.parts)
        fs.create_dir(root, recursive=True)
        part = _Part(TaskContext.get().partitionId(), uuid.uuid4().hex, 0)
        with fs.open_output_stream(f"{root}/{part.name}", compression=None) as out:
            for batch in iterator:
                data = "".join(f"{line}\n" for line in batch.column("line").to_pylist() if line is not None).encode()
                out.write(data)
                part.size += len(data)
        return part

    def commit(self, messages) -> None:
        fs, root = _filesystem(self.parts)
        _, target = _filesystem(self.path)
        parts = sorted((m for m in messages if m is not None and m.size), key=lambda m: m.number)
        fs.create_dir(root, recursive=True)
        hidden = f"{root}/document"
        with fs.open_output_stream(hidden, compression=None) as out:
            for part in parts:
                with fs.open_input_stream(f"{root}/{part.name}", compression=None) as lines:
                    while data := lines.read(_BUFFER):
                        out.write(data)
        total, written = sum(p.size for p in parts), fs.get_file_info(hidden).size
        if written != total:
            raise OSError(f"{written} bytes written of {total}")
        if fs.get_file_info(target).type == pafs.FileType.Directory:
            fs.delete_dir(target)
        fs.create_dir(os.path.dirname(target), recursive=True)
        fs.move(hidden, target)
        fs.delete_dir(root)

    def abort(self, messages) -> None:
        fs, root = _filesystem(self.parts)
        if fs.get_file_info(root).type == pafs.FileType.Directory:
            fs.delete_dir(root)


class TextDocument(DataSource):
    """Format ``text_document``: rows (line), in the order of partitions and rows, as one file at ``path``."""

    @classmethod
    def name(cls) -> str:
        return "text_document"

    def schema(self) -> str:
        return "line string"

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"])


def write_document(lines: DataFrame, path: str) -> None:
    """``lines`` (line, in order) as one UTF-8 file; a file that is there is replaced."""
    lines.sparkSession.dataSource.register(TextDocument)
    lines.select("line").write.format("text_document").mode("append").option("path", path).save()


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """(block, at, line): the lines of one file. They follow each other by block (the place in the file of the byte range that a task
    reads, of ``spark.sql.files.maxPartitionBytes`` at most) and, inside a block, by ``at``."""
    return spark.read.text(path).select(
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
