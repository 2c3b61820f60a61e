"""Media columns: a Spark data source over directories of archives.

``write_archives`` stores every payload losslessly as an 8-bit grayscale PNG (rows of 576 samples) and packs the
images into ZIP archives. ``read_archives`` plans byte ranges over the archives: a partition reads the members whose
header begins in its range, in Arrow batches of bounded size, and a member that can't be read (I/O error, bad CRC) is
read again from its own offset, without starting the partition anew.

A null payload is stored as an empty one is: never; callers pad first (``padded``). Repeated keys are members of their
own. An empty table makes a directory without archives, which reads as no rows.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage,
)

ROW = 576
READ_SCHEMA = "key string, archive string, offset long, media binary, attempts int, error string"
_ARROW = pa.schema([("key", pa.string()), ("archive", pa.string()), ("offset", pa.int64()), ("media", pa.binary()),
                    ("attempts", pa.int32()), ("error", pa.string())])
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def padded(text: Column) -> Column:
    """UTF-8 of a text (null: empty) and bytes 255 up to a positive multiple of 576."""
    raw = F.coalesce(text, F.lit("")).cast("binary")
    size = F.octet_length(raw)
    missing = F.greatest(F.lit(1), F.ceil(size / ROW)).cast("int") * ROW - size
    return F.concat(raw, F.unhex(F.repeat(F.lit("FF"), missing)))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes, level: int = 6) -> bytes:
    """A grayscale PNG of rows of 576 samples; the payload's length is a positive multiple of 576."""
    if not payload or len(payload) % ROW:
        raise ValueError("payload must be a positive multiple of 576 bytes")
    rows = np.zeros((len(payload) // ROW, ROW + 1), dtype=np.uint8)  # each row starts with filter type 0
    rows[:, 1:] = np.frombuffer(payload, dtype=np.uint8).reshape(-1, ROW)
    head = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def decode_png(media: bytes) -> bytes:
    """The samples of such an image; raises ValueError on anything else or on a damaged chunk."""
    if media[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, body, width, height = 8, [], 0, 0
    while at + 12 <= len(media):
        size, kind = struct.unpack(">I4s", media[at: at + 8])
        part = media[at + 8: at + 8 + size]
        if zlib.crc32(kind + part) != struct.unpack(">I", media[at + 8 + size: at + 12 + size])[0]:
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            width, height, depth, colour = struct.unpack(">IIBB", part[:10])
            if (depth, colour) != (8, 0):
                raise ValueError("not 8-bit grayscale")
        elif kind == b"IDAT":
            body.append(part)
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(body)), dtype=np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows are not supported")
    return rows[:, 1:].tobytes()


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


class _Sink(io.RawIOBase):
    """Only what ZipFile needs to write to a stream that can't seek; counts bytes."""

    def __init__(self, stream):
        self._stream, self.size = stream, 0

    def writable(self):
        return True

    def seekable(self):
        return False

    def tell(self):
        raise OSError("a stream")

    def write(self, data):
        self._stream.write(data)
        self.size += len(data)
        return len(data)


@dataclass
class _Written(WriterCommitMessage):
    archives: list


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, archive_bytes: int, level: int):
        self.path, self.archive_bytes, self.level = path, archive_bytes, level

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = _filesystem(self.path)
        fs.create_dir(root, recursive=True)
        done, stream, sink, archive, number = [], None, None, None, 0
        for batch in iterator:
            for key, payload in zip(batch.column("key"), batch.column("payload"), strict=True):
                if archive is None:
                    name = f"{uuid.uuid4().hex}.zip"
                    stream = fs.open_output_stream(f"{root}/{name}")
                    sink = _Sink(stream)
                    archive = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED)
                    done.append([name, 0])
                # a fixed time: equal rows make equal archives
                info = zipfile.ZipInfo(f"{number}/{'' if key.as_py() is None else key.as_py()}", (1980, 1, 1, 0, 0, 0))
                archive.writestr(info, encode_png(payload.as_py(), self.level))
                number += 1
                if sink.size >= self.archive_bytes:
                    archive.close()
                    stream.close()
                    done[-1][1], archive = sink.size, None
        if archive is not None:
            archive.close()
            stream.close()
            done[-1][1] = sink.size
        return _Written(done)

    def commit(self, messages) -> None:
        """Only archives of tasks that succeeded are listed; what lost tasks left is never read."""
        fs, root = _filesystem(self.path)
        fs.create_dir(root, recursive=True)
        listed = [x for m in messages if m is not None for x in m.archives]
        with fs.open_output_stream(f"{root}/_archives-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps(listed).encode())

    def abort(self, messages) -> None:
        fs, root = _filesystem(self.path)
        for name, _ in (x for m in messages if m is not None for x in m.archives):
            fs.delete_file(f"{root}/{name}")


@dataclass
class ByteRange(InputPartition):
    archive: str
    start: int
    stop: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int, batch_bytes: int, retries: int, keep_errors: bool):
        self.path, self.range_bytes, self.batch_bytes = path, range_bytes, batch_bytes
        self.retries, self.keep_errors = retries, keep_errors

    def partitions(self) -> list[ByteRange]:
        fs, root = _filesystem(self.path)
        found = []
        for entry in fs.get_file_info(pafs.FileSelector(root)):
            if entry.base_name.startswith("_archives-"):
                with fs.open_input_stream(entry.path) as lines:
                    found += json.loads(lines.read())
        return [ByteRange(name, at, min(size, at + self.range_bytes))
                for name, size in sorted(found) for at in range(0, size, self.range_bytes)] or [ByteRange("", 0, 0)]

    def _member(self, fs, path: str, info: zipfile.ZipInfo) -> tuple[bytes | None, int, str | None]:
        """One member, read from its offset until its CRC holds."""
        problem = None
        for attempt in range(1, self.retries + 2):
            try:
                with fs.open_input_file(path) as file:
                    head = file.read_at(30, info.header_offset)
                    skip = 30 + sum(struct.unpack("<HH", head[26:30]))
                    body = file.read_at(info.compress_size, info.header_offset + skip)
                if zlib.crc32(body) != info.CRC or len(body) != info.file_size:
                    raise OSError("CRC differs")
                return body, attempt, None
            except (OSError, struct.error) as error:
                problem = f"{type(error).__name__}: {error}"
                time.sleep(min(2.0, 0.1 * 2**attempt))
        return None, self.retries + 1, problem

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        fs, root = _filesystem(self.path)
        path = f"{root}/{partition.archive}"
        with fs.open_input_file(path) as file, zipfile.ZipFile(file) as archive:
            members = [x for x in archive.infolist() if partition.start <= x.header_offset < partition.stop]
        rows, size = [], 0
        for info in members:
            media, attempts, problem = self._member(fs, path, info)
            if problem and not self.keep_errors:
                raise OSError(f"{path} at {info.header_offset}: {problem}")
            key = info.filename.partition("/")[2]
            rows.append((key or None, path, info.header_offset, media, attempts, problem))
            size += info.file_size
            if size >= self.batch_bytes:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)


class MediaArchives(DataSource):
    """Format ``media_archives``. Options: path, archiveBytes, level (writing); rangeBytes, batchBytes, retries,
    keepErrors (reading; true: a member that can't be read is a row with its error instead of a failure)."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return READ_SCHEMA

    def writer(self, schema, overwrite: bool) -> _Writer:
        o = self.options
        return _Writer(o["path"], int(o.get("archiveBytes", 128 << 20)), int(o.get("level", 6)))

    def reader(self, schema) -> _Reader:
        o = self.options
        return _Reader(o["path"], int(o.get("rangeBytes", 16 << 20)), int(o.get("batchBytes", 4 << 20)),
                       int(o.get("retries", 3)), str(o.get("keepErrors", "false")).lower() == "true")


def write_archives(df: DataFrame, path: str, key: str, payload: Column, level: int = 6) -> None:
    """Stores ``payload`` of every row under the text of ``key`` in archives of about 128 MB."""
    df.sparkSession.dataSource.register(MediaArchives)
    rows = df.select(F.col(key).cast("string").alias("key"), payload.alias("payload"))
    rows.write.format("media_archives").mode("append").option("path", path).option("level", level).save()


def read_archives(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(MediaArchives)
    reader = spark.read.format("media_archives").option("path", path)
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.load()


def feature(payload: bytes) -> str:
    """A 64-bit hash of the mean 24 x 24 tile (8 x 8 blocks against their median), mean and entropy of the samples."""
    samples = np.frombuffer(payload, dtype=np.uint8)
    tile = samples.reshape(-1, 24, 24).mean(axis=0, dtype=np.float64)
    blocks = tile.reshape(8, 3, 8, 3).mean(axis=(1, 3)).ravel()
    bits = np.packbits(blocks > np.median(blocks)).tobytes().hex()
    share = np.bincount(samples, minlength=256) / len(samples)
    share = share[share > 0]
    return f"{bits}:{samples.mean(dtype=np.float64):.4f}:{-(share * np.log2(share)).sum():.4f}"


FEATURES = "key string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in FEATURES.split(", ")]
    for batch in batches:
        out = []
        for key, media in zip(batch.column("key"), batch.column("media"), strict=True):
            media = media.as_py()
            payload = decode_png(media)
            out.append((key.as_py(), len(payload.rstrip(b"\xff")), len(payload), hashlib.sha256(payload).hexdigest(),
                        zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload)))
        if out:
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.record_batch([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def media_features(archives: DataFrame) -> DataFrame:
    """Digests and features of the stored images, from the bytes read back."""
    return archives.select("key", "media").mapInArrow(_features, FEATURES)
