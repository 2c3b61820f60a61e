"""WARC archives: exact round trips, the query against plain Python and SQL, damaged and incomplete records."""

import base64
import glob
import gzip
import hashlib
import os

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mapweave.llm import warc
from mapweave.llm.common import scratch_path
from mapweave.llm.plans import QUERIES, SQL


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=300), st.integers(1, 40))
def test_chunked_framing_round_trip(payload, size):
    assert warc.from_chunks(warc.to_chunks(payload, size)) == payload


@pytest.mark.parametrize("body,want", [
    (b"3;name=x\r\nabc\r\n0\r\nTrailer: y\r\n\r\n", b"abc"), (b"A\r\n0123456789\r\n0\r\n\r\n", b"0123456789"), (b"0\r\n\r\n", b""),
    (b"", None), (b"3\r\nabcd\r\n0\r\n\r\n", None), (b"3\r\nabc\r\n", None), (b"x\r\nabc\r\n0\r\n\r\n", None), (b"3\r\nabc\r\n0\r\n", None), (b"-1\r\n", None)])
def test_chunked_framing_by_hand(body, want):
    if want is None:
        with pytest.raises(ValueError):
            warc.from_chunks(body)
    else:
        assert warc.from_chunks(body) == want


def segment(number, block, total=None, kind="continuation", error=None):
    return {"segment_number": number, "block": block, "total_length": total, "record_type": kind, "error": error, "record_id": "r"}


@pytest.mark.parametrize("parts,problem", [
    ([segment(1, b"ab", kind="response"), segment(2, b"c", 3)], None), ([segment(1, b"ab", kind="response"), segment(3, b"c", 3)], "segments"),
    ([segment(1, b"ab", kind="response"), segment(2, b"c"), segment(2, b"c", 3)], "segments"), ([segment(2, b"c", 3)], "segments"),
    ([segment(1, b"ab", kind="response"), segment(2, b"c")], "last segment"), ([segment(1, b"ab", kind="response"), segment(2, b"c", 4)], "3 bytes of 4"),
    ([segment(1, b"ab"), segment(2, b"c", 3)], "segments"), ([segment(1, b"ab", kind="response"), segment(2, b"c", 3, error="bad")], "bad")])
def test_reassembly(parts, problem):
    whole = warc.reassemble(parts)
    assert (problem is None and whole["error"] is None and whole["block"] == b"abc") or problem in whole["error"]


def plain(rows):
    first = {}
    for key, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(html or "", key)
    used, out = set(), []
    for key, _, html in rows:
        data = (html or "").encode()
        own = key == first[html or ""] and (html or "") not in used
        if own:
            used.add(html or "")
        out.append((key, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if own else "revisit", None if own else first[html or ""]))
    return sorted(out, key=str)


def awkward():
    rows = [(i, f"http://x/{i}", f"<p>{i % 7}</p>") for i in range(60)] + [(100, None, None), (101, "", ""), (102, "u", None), (5, "http://x/5", "<p>5</p>")]
    rows += [(200, "a b\r\nWARC-Type: evil %0D", "é" * 50_000), (199, "a", "é" * 50_000), (201, "b", "\r\n\r\n0\r\n\r\n"), (202, "c", "x" * 400_000)]
    return rows + [(None, "n", "<p>null</p>"), (None, "n", "<p>null</p>"), (None, "m", "<p>1</p>")]


def write(spark, path, rows):
    wide = [(*r, "k", 1, "f", "o") for r in rows]
    spark.createDataFrame(wide, "page_id long, url string, html string, key string, times int, first string, refers_to string").repartition(4).write.parquet(f"{path}/pages.parquet")
    return str(path)


def test_query_equals_plain_python(spark, tmp_path):
    path = write(spark, tmp_path / "t", awkward())
    got = QUERIES["op13_warc_segments"](spark, path)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(awkward())


def test_no_pages(spark, tmp_path):
    assert QUERIES["op13_warc_segments"](spark, write(spark, tmp_path / "t", [])).count() == 0


def test_query_equals_sql(spark):
    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{path}/pages.parquet'")
    got = sorted(map(tuple, QUERIES["op13_warc_segments"](spark, path).collect()))
    assert got == sorted(con.execute(SQL["op13_warc_segments"]).fetchall()) and len(got) == 50


def archive(spark, rows, **options):
    path = scratch_path(spark, "warc")
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    warc.write_warc(df, path, "page_id", "url", df["html"], **options)
    return path, path.removeprefix("file://")


def test_payloads_round_trip_over_files_and_segments(spark):
    path, folder = archive(spark, awkward(), segmentBytes=700, chunkBytes=64, fileBytes=3000)
    assert len(glob.glob(f"{folder}/*.warc.gz")) > 20
    got = [r for r in warc.payloads(spark, path).collect()]
    assert not [r for r in got if r["error"]]
    texts = {r["payload_digest"]: r["payload"].decode() for r in got if r["record_type"] == "response"}
    assert sorted((str(r["key"]), str(r["url"]), texts[r["payload_digest"]]) for r in got) == sorted((str(k), str(u), h or "") for k, u, h in awkward())
    records = warc.read_warc(spark, path)
    assert records.where("record_type = 'continuation'").count() > 100 and records.where("error IS NOT NULL").isEmpty()


def test_short_payloads_are_not_revisited(spark):
    path, _ = archive(spark, [(1, "a", "xx"), (2, "b", "xx"), (3, "c", "yyyy"), (4, "d", "yyyy")], least=3)
    assert {(r["key"], r["record_type"]) for r in warc.rebuild(spark, path).collect()} == {("1", "response"), ("2", "response"), ("3", "response"), ("4", "revisit")}


def rewrite(name, change):
    """The records of a file, each changed, packed again."""
    with open(name, "rb") as file:
        records = [data for data, _ in warc._members(file)]
    with open(name, "wb") as file:
        for data in records:
            data = change(data)
            if data is not None:
                file.write(gzip.compress(data))


@pytest.mark.parametrize("change,problem", [
    (lambda d: None if b"WARC-Segment-Number: 2" in d else d, "segments"), (lambda d: None if b"Total-Length" in d else d, "last segment"),
    (lambda d: d.replace(b"Total-Length: ", b"Total-Length: 1"), "bytes of"), (lambda d: d.replace(b"zz", b"yy"), "block differs"),
    (lambda d: d.replace(b"WARC/1.1", b"WARK/1.1") if b"Number: 2" in d else d, "not a WARC"), (lambda d: d.replace(b"Number: 2", b"Number: two"), "header")])
def test_damage_is_told(spark, change, problem):
    path, folder = archive(spark, [(1, "u", "z" * 5000), (2, "v", "short")], segmentBytes=1500)
    for name in glob.glob(f"{folder}/*.warc.gz"):
        rewrite(name, change)
    rows = warc.payloads(spark, path).collect()
    assert any(problem in r["error"] for r in rows if r["error"]) and any(r["payload"] == b"short" for r in rows)
    with pytest.raises(ValueError):
        warc.rebuild(spark, path)


def test_damaged_file(spark):
    path, folder = archive(spark, [(i, "u", os.urandom(600).hex()) for i in range(4)])
    name = sorted(glob.glob(f"{folder}/*.warc.gz"))[0]
    with open(name, "r+b") as file:
        file.seek(-40, 2)
        file.write(b"\x00" * 8)
    assert [r["error"] for r in warc.payloads(spark, path).collect() if r["error"]]


def test_common_values_are_looked_up(spark):
    rows = spark.range(5000).selectExpr("id", "CASE WHEN id % 2 = 0 THEN 'hot' WHEN id % 7 = 0 THEN NULL ELSE concat('k', id % 900) END AS k")
    table = rows.groupBy("k").count().where("k IS NOT NULL AND k <> 'k13'").selectExpr("k", "upper(k) AS v", "count AS n")
    got = warc.look_up(rows, "k", table, "n").collect()
    assert len(got) == 5000 and all(r["v"] == (None if r["k"] in (None, "k13") else r["k"].upper()) for r in got)
