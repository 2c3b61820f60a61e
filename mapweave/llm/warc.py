"""WARC archives: writing with segmented records, reading with segment reassembly.

``write_warc`` stores one record per row: a ``response`` (HTTP headers and the payload in chunked transfer framing) or, where the row
says whose payload it repeats, a ``revisit`` without payload. A block longer than ``segmentBytes`` becomes a first record and
``continuation`` records, each with its segment number and the first record's id as origin; the last says the total length.
Every record is a gzip member of its own. Files are cut at about ``fileBytes``, also between the segments of a record.

``read_warc`` gives the records as rows. ``payloads`` makes whole responses of them: records without segments are decoded where
they are read; only continuations and their first records are shuffled, to ranges of origin ids, put in the order of their segment
numbers, joined and held against the total length. Then chunked framing is decoded and the payload held against its digest. Each
task streams its rows and holds the segments of one record at a time.

A record that can't be made whole is a row with ``error``: a missing or repeated segment, a wrong total length, broken framing, a
digest that differs, a damaged gzip member. ``rebuild`` of pages raises the first error instead.

A null payload is written as an empty one, null keys and urls are left out of the headers and read back as null. Repeated rows and
equal keys are records of their own: ids are made of the key and the row's place. Equal payloads: the smallest key is the response (of
equal keys the first row), null keys come last. An empty table makes a folder without records. Columns besides key, url
and payload are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from mapweave.llm.common import materialize

RECORD_SCHEMA = ("record_id string, record_type string, key string, url string, refers_to string, payload_digest string, "
                 "segment_number int, origin_id string, total_length long, block binary, error string")
_RECORD = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("key", pa.string()), ("url", pa.string()),
                     ("refers_to", pa.string()), ("payload_digest", pa.string()), ("segment_number", pa.int32()),
                     ("origin_id", pa.string()), ("total_length", pa.int64()), ("block", pa.binary()), ("error", pa.string())])
_DATE = "2024-01-01T00:00:00Z"  # equal rows make equal archives
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def to_chunks(payload: bytes, size: int) -> bytes:
    """Chunked transfer framing in chunks of ``size`` bytes."""
    out = []
    for at in range(0, len(payload), size):
        part = payload[at: at + size]
        out += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*out, b"0\r\n\r\n"])


def from_chunks(body: bytes) -> bytes:
    """The payload of chunked framing (extensions and trailers are allowed); ValueError on anything else."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk without size line")
        digits = body[at:end].split(b";")[0].strip()
        if not digits or digits.strip(b"0123456789abcdefABCDEF"):
            raise ValueError("chunk size is not a number")
        size, at = int(digits, 16), end + 2
        if size == 0:
            if body[at:] != b"\r\n" and not body.endswith(b"\r\n\r\n"):
                raise ValueError("body ends in the trailer")
            return b"".join(out)
        if body[at + size: at + size + 2] != b"\r\n":
            raise ValueError("chunk is shorter or longer than its size")
        out.append(body[at: at + size])
        at += size + 2


def decode_response(block: bytes) -> bytes:
    """The payload of an HTTP response; chunked framing is taken off where its headers say so."""
    head, blank, body = block.partition(b"\r\n\r\n")
    if not blank or not head.startswith(b"HTTP/"):
        raise ValueError("not an HTTP response")
    fields = [line.partition(b":") for line in head.split(b"\r\n")[1:]]
    coding = [v.strip().lower() for k, _, v in fields if k.strip().lower() == b"transfer-encoding"]
    return from_chunks(body) if coding and coding[-1].endswith(b"chunked") else body


def _member(fields: list[tuple[str, object]], block: bytes, level: int) -> bytes:
    """One record as a gzip member."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields if v is not None), f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


_ESCAPES = {c: f"%{ord(c):02X}" for c in "% \t\r\n"}


def _header_value(value: str | None) -> str | None:
    """Blanks and line breaks would be lost in a header: they are percent-encoded."""
    return None if value is None else value.translate(str.maketrans(_ESCAPES))


def _plain_value(value: str | None) -> str | None:
    return None if value is None else unquote(value)


@dataclass
class _Written(WriterCommitMessage):
    files: list


class _Writer(DataSourceArrowWriter):
    def __init__(self, options):
        self.path = options["path"]
        self.file_bytes = int(options.get("fileBytes", 64 << 20))
        self.segment_bytes = int(options.get("segmentBytes", 1 << 20))
        self.chunk_bytes = int(options.get("chunkBytes", 8192))
        self.level = int(options.get("level", 3))

    def _records(self, row: dict) -> Iterator[bytes]:
        about = [("WARC-Record-ID", row["record_id"]), ("WARC-Date", _DATE), ("WARC-Target-URI", _header_value(row["url"])),
                 ("WARC-Source-Key", _header_value(row["key"])), ("WARC-Payload-Digest", f"sha1:{base32_sha1(row['payload'])}")]
        if row["refers_to"] is not None:
            yield _member([("WARC-Type", "revisit"), *about, ("WARC-Profile", _PROFILE), ("WARC-Refers-To", row["refers_to"]),
                           ("Content-Type", "application/http; msgtype=response")], _HTTP, self.level)
            return
        block = _HTTP + to_chunks(row["payload"], self.chunk_bytes)
        parts = [block[at: at + self.segment_bytes] for at in range(0, len(block), self.segment_bytes)]
        for i, part in enumerate(parts, 1):
            last = i == len(parts)
            if i == 1:
                fields = [("WARC-Type", "response"), *about, ("Content-Type", "application/http; msgtype=response"),
                          ("WARC-Segment-Number", None if last else 1)]
            else:
                fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{row['record_id'][:-1]}:{i}>"), ("WARC-Date", _DATE),
                          ("WARC-Segment-Origin-ID", row["record_id"]), ("WARC-Segment-Number", i),
                          ("WARC-Segment-Total-Length", len(block) if last else None)]
            yield _member([*fields, ("WARC-Block-Digest", f"sha1:{base32_sha1(part)}")], part, self.level)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(root, recursive=True)
        done, stream, size = [], None, 0
        for batch in iterator:
            for i in range(len(batch)):
                row = {name: batch.column(name)[i].as_py() for name in ("record_id", "key", "url", "refers_to", "payload")}
                for record in self._records(row):
                    if stream is None:
                        done.append(f"{uuid.uuid4().hex}.warc.gz")
                        stream = fs.open_output_stream(f"{root}/{done[-1]}", compression=None)
                        size = stream.write(_member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", _DATE),
                                                     ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n", self.level))
                    size += stream.write(record)
                    if size >= self.file_bytes:
                        stream.close()
                        stream = None
        if stream is not None:
            stream.close()
        return _Written(done)

    def commit(self, messages) -> None:
        """Only files of tasks that succeeded are listed; what lost tasks left is never read."""
        fs, root = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/_files-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps([x for m in messages if m is not None for x in m.files]).encode())

    def abort(self, messages) -> None:
        fs, root = pafs.FileSystem.from_uri(self.path)
        for name in (x for m in messages if m is not None for x in m.files):
            fs.delete_file(f"{root}/{name}")


@dataclass
class _File(InputPartition):
    name: str


def _members(stream) -> Iterator[tuple[bytes | None, str | None]]:
    """The inflated gzip members of a file, one after the other; after a damaged one there is nothing to go on from."""
    left = b""
    while True:
        left = left or stream.read(1 << 16)
        if not left:
            return
        unpacker, out = zlib.decompressobj(31), []
        while not unpacker.eof:
            if not left and not (left := stream.read(1 << 16)):
                yield None, "file ends inside a record"
                return
            try:
                out.append(unpacker.decompress(left))
            except zlib.error as problem:
                yield None, f"damaged record: {problem}"
                return
            left = b""
        left = unpacker.unused_data
        yield b"".join(out), None


def parse_record(data: bytes) -> dict:
    """One record by the names of RECORD_SCHEMA; its block is held against its length and digest."""
    try:
        return _parsed(data)
    except ValueError as problem:
        return {"error": f"header: {problem}"}


def _parsed(data: bytes) -> dict:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip(" \t") for k, _, v in (line.partition(":") for line in lines[1:])}
    if not lines[0].startswith("WARC/"):
        return {"error": "not a WARC record"}
    length = int(fields.get("content-length", -1))
    block, problem = rest[: max(0, length)], None
    if length < 0 or rest[length:] != b"\r\n\r\n":
        problem = "block differs from its length"
    elif (digest := fields.get("warc-block-digest", "").removeprefix("sha1:")) and digest != base32_sha1(block):
        problem = "block differs from its digest"
    number, total = fields.get("warc-segment-number"), fields.get("warc-segment-total-length")
    return {"record_id": fields.get("warc-record-id"), "record_type": fields.get("warc-type"), "key": _plain_value(fields.get("warc-source-key")),
            "url": _plain_value(fields.get("warc-target-uri")), "refers_to": fields.get("warc-refers-to"),
            "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:") or None, "segment_number": number and int(number),
            "origin_id": fields.get("warc-segment-origin-id"), "total_length": total and int(total), "block": block, "error": problem}


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.parts = options["path"], options.get("parts", "all")
        self.batch_bytes = int(options.get("batchBytes", 4 << 20))

    def partitions(self) -> list[_File]:
        fs, root = pafs.FileSystem.from_uri(self.path)
        found = []
        for entry in fs.get_file_info(pafs.FileSelector(root)):
            if entry.base_name.startswith("_files-"):
                with fs.open_input_stream(entry.path) as lines:
                    found += json.loads(lines.read())
        return [_File(name) for name in sorted(found)] or [_File("")]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        fs, root = pafs.FileSystem.from_uri(self.path)
        rows, size = [], 0
        with fs.open_input_stream(f"{root}/{partition.name}", compression=None) as stream:
            for data, problem in _members(stream):
                record = {"error": f"{partition.name}: {problem}"} if data is None else parse_record(data)
                segmented = record.get("segment_number") is not None
                if self.parts != "all" and segmented != (self.parts == "segments"):
                    continue
                rows.append(record)
                size += len(record.get("block") or b"") + 500
                if size >= self.batch_bytes:
                    yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)


class Warc(DataSource):
    """Format ``warc``. Options: path, fileBytes, segmentBytes, chunkBytes, level (writing); batchBytes and parts (reading; ``whole``:
    records without segment numbers, ``segments``: the others, ``all``)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return RECORD_SCHEMA

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options)

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def read_warc(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(Warc)
    reader = spark.read.format("warc").option("path", path)
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.load()


_PAYLOAD = ("record_id string, record_type string, key string, url string, refers_to string, payload_digest string, payload_bytes long, "
            "payload binary, error string")
_PAYLOAD_ARROW = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("key", pa.string()), ("url", pa.string()),
                            ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()),
                            ("payload", pa.binary()), ("error", pa.string())])


def reassemble(segments: list[dict]) -> dict:
    """The whole record of its segments, in order of their numbers; ``error`` says what is missing or wrong."""
    first = dict(segments[0])
    numbers = [s["segment_number"] for s in segments]
    problem = next((s["error"] for s in segments if s["error"]), None)
    if problem is None and (numbers != list(range(1, len(segments) + 1)) or first["record_type"] == "continuation"):
        problem = f"segments {numbers}, should be 1 to {max(numbers)}"
    total = segments[-1]["total_length"]
    first["block"] = b"".join(s["block"] for s in segments)
    if problem is None and total is None:
        problem = "the last segment is missing"
    if problem is None and total != len(first["block"]):
        problem = f"{len(first['block'])} bytes of {total}"
    return first | {"error": problem}


def _payload_row(record: dict, with_payload: bool) -> dict:
    row = {k: record[k] for k in ("record_id", "record_type", "key", "url", "refers_to", "payload_digest", "error")}
    if row["record_type"] == "response" and row["error"] is None:
        try:
            payload = decode_response(record["block"])
            found = base32_sha1(payload)
            if row["payload_digest"] not in (None, found):
                row["error"] = "payload differs from its digest"
            row |= {"payload_digest": found, "payload_bytes": len(payload)} | ({"payload": payload} if with_payload else {})
        except ValueError as problem:
            row["error"] = str(problem)
    return row


def _rows_out(rows: Iterator[dict], batch_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    kept, size = [], 0
    for row in rows:
        kept.append(row)
        size += len(row.get("payload") or b"") + 300
        if size >= batch_bytes:
            yield pa.RecordBatch.from_pylist(kept, schema=_PAYLOAD_ARROW)
            kept, size = [], 0
    if kept:
        yield pa.RecordBatch.from_pylist(kept, schema=_PAYLOAD_ARROW)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(len(batch)):
            yield {name: column[i].as_py() for name, column in zip(batch.schema.names, batch.columns, strict=True)}


def payloads(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Responses and revisits of the archives under ``path``, responses with their whole payloads."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _rows_out(_payload_row(r, with_payload) for r in _each(batches) if r["error"] or r["record_type"] in ("response", "revisit"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[dict]:
            held = []
            for row in _each(batches):
                if held and row["origin"] != held[0]["origin"]:
                    yield _payload_row(reassemble(held), with_payload)
                    held = []
                held.append(row)
            if held:
                yield _payload_row(reassemble(held), with_payload)

        yield from _rows_out(records())

    parts = read_warc(spark, path, parts="segments").withColumn("origin", F.coalesce("origin_id", "record_id"))
    dealt = parts.repartition("origin").sortWithinPartitions("origin", "segment_number")
    return read_warc(spark, path, parts="whole").mapInArrow(whole, _PAYLOAD).unionByName(dealt.mapInArrow(joined, _PAYLOAD))


#: A value that more than a 1000th of all rows have is common: there are fewer than 1000 of them, which may be broadcast.
COMMON = 1000


def look_up(rows: DataFrame, key: str, table: DataFrame, count: str) -> DataFrame:
    """Left join with ``table`` (one row for each ``key``; ``count``: how many of ``rows`` have it), safe for common values.

    The fewer than COMMON values that more than a share of all counted rows have are broadcast. Their rows then go to the
    shuffled join under keys of their own, so that no task gets all of them.
    """
    table = materialize(table)
    total = table.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    names = [c for c in table.columns if c not in (key, count)]
    common = table.where(F.col(count) * COMMON > total)
    fetched = rows.join(F.broadcast(common.select(key, F.struct(*names).alias("_common"))), key, "left")
    spread = F.when(F.col("_common").isNotNull(), F.concat_ws("/", key, F.xxhash64(*rows.columns))).otherwise(F.col(key))
    rest = table.where(F.col(count) * COMMON <= total).select(F.col(key).alias("_key"), F.struct(*names).alias("_rest"))
    found = fetched.withColumn("_key", spread).join(rest, "_key", "left").withColumn("_found", F.coalesce("_common", "_rest"))
    return found.select(*rows.columns, *[F.col(f"_found.{c}").alias(c) for c in names])


def with_origins(rows: DataFrame, least: int = 0) -> DataFrame:
    """(record_id, key, url, payload) to the same with ``refers_to``: the id of the record with the smallest key among those
    with an equal payload of ``least`` bytes or more; null for that record itself and for shorter payloads."""
    seen = rows.withColumn("digest", F.concat_ws(":", F.sha1("payload"), F.octet_length("payload")))
    order = F.struct(F.col("key").isNull(), F.col("sort_key"), F.col("record_id"))
    groups = seen.where(F.octet_length("payload") >= least).groupBy("digest").agg(
        F.min_by("record_id", order).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1")
    found = look_up(seen, "digest", groups, "times")
    return found.withColumn("refers_to", F.when(F.col("first") != F.col("record_id"), F.col("first"))).drop("digest", "first")


def write_warc(df: DataFrame, path: str, key: str, url: str, payload: Column, row_id: Column | None = None, least: int = 0, **options) -> None:
    """One record per row of ``df``; of equal payloads of ``least`` bytes or more all but one are revisits.

    ``row_id`` tells rows apart and is the same whenever they are read. Without it the rows are written first, which keeps their places.
    """
    df.sparkSession.dataSource.register(Warc)
    rows = df.select(F.col(key).cast("string").alias("key"), F.col(key).alias("sort_key"), F.col(url).alias("url"),
                     F.coalesce(payload.cast("binary"), F.lit("").cast("binary")).alias("payload"),
                     (F.monotonically_increasing_id() if row_id is None else row_id).cast("string").alias("row_id"))
    rows = materialize(rows) if row_id is None else rows
    name = F.concat_ws("/", F.concat(F.lit("key:"), F.col("key")), "row_id")
    rows = rows.withColumn("record_id", F.concat(F.lit("<urn:sha1:"), F.sha1(name), F.lit(">"))).drop("row_id")
    writer = with_origins(rows, least).select("record_id", "key", "url", "refers_to", "payload").write.format("warc").mode("append").option("path", path)
    for option, value in options.items():
        writer = writer.option(option, value)
    writer.save()


def rebuild(spark: SparkSession, path: str) -> DataFrame:
    """(key, record_type, payload_bytes, payload_digest, refers_to) of every record, sizes and keys of revisits from the responses
    they refer to. Raises an error if a record is damaged or a response is not there."""
    records = materialize(payloads(spark, path, with_payload=False))
    revisits = records.where("record_type = 'revisit'")
    times = revisits.groupBy(F.col("refers_to").alias("record_id")).agg(F.count(F.lit(1)).alias("times"))
    origins = records.where("record_type = 'response' AND error IS NULL").join(times, "record_id").select(
        F.col("record_id").alias("refers_to"), F.col("key").alias("origin"), F.struct("payload_bytes").alias("size"), "times")
    found = look_up(revisits.select("key", "refers_to", "payload_digest"), "refers_to", origins, "times")
    known = origins.agg(F.sum("times")).first()[0] or 0
    problem = records.where("error IS NOT NULL").select("record_id", "error").first()
    if problem:
        raise ValueError(f"{problem['record_id']}: {problem['error']}")
    if known != revisits.count():
        raise ValueError("a response that is referred to is not in the archives")
    kinds = [("key", "string"), ("record_type", "string"), ("payload_bytes", "long"), ("payload_digest", "string"), ("refers_to", "string")]
    own = records.where("record_type = 'response'").select("key", "record_type", "payload_bytes", "payload_digest", F.lit(None).cast("string").alias("refers_to"))
    others = found.select("key", F.lit("revisit").alias("record_type"), F.col("size.payload_bytes").alias("payload_bytes"), "payload_digest", F.col("origin").alias("refers_to"))
    return own.unionByName(others).select(*[F.col(c).cast(t).alias(c) for c, t in kinds])
