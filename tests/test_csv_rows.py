"""CSV ranges against a plain reader, at any range size."""

import csv
import io
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mapweave.sources import bulk, csv_rows

FIELD = st.lists(st.sampled_from([*'ab ,"\né;', "\r\n"]), max_size=8).map("".join)


def by_ranges(path, size, columns):
    """What the source gives, without Spark: both passes over all ranges."""
    scan = csv_rows._Scan({"path": path, "rangeBytes": size})
    found = [r for part in scan.partitions() for r in scan.read(part)]
    plan, quoted, row = [], 0, 0
    for file, start, stop, quotes, plain, inside, amid in found:
        plan.append([file, start, stop, bool(quoted), row + int(bool(quoted) or amid)])
        row += inside if quoted else plain
        quoted = (quoted + quotes) % 2
    header = {name: csv_rows.header_of(path, name) for name, _ in csv_rows.list_files(path)}
    rows = csv_rows._Rows({"path": path, "plan": json.dumps(plan), "columns": json.dumps(columns), "headers": json.dumps(header)})
    return [tuple(x) for part in rows.partitions() for batch in rows.read(part) for x in zip(*[c.to_pylist() for c in batch.columns], strict=True)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(FIELD, FIELD), max_size=12), st.sampled_from(["\n", "\r\n"]), st.lists(st.integers(0, 12), max_size=3),
       st.booleans(), st.integers(1, 40))
def test_rows_and_numbers_equal_a_plain_reader(tmp_path_factory, rows, line_end, blanks, ended, size):
    out = io.StringIO(newline="")
    writer = csv.writer(out, lineterminator=line_end)
    writer.writerow(["x", "query"])
    for i, row in enumerate(rows):
        if i in blanks:
            out.write(line_end)
        writer.writerow(row)
    data = out.getvalue() if ended else out.getvalue().removesuffix(line_end)
    path = str(tmp_path_factory.mktemp("csv") / "f.csv")
    with open(path, "w", newline="", encoding="utf-8") as file:
        file.write(data)
    with open(path, newline="", encoding="utf-8") as file:
        plain = [r for r in csv.reader(file) if r]
    want = [(path, i, r[1] or None if len(r) > 1 else None, None, r[0] or None) for i, r in enumerate(plain[1:])]
    assert by_ranges(path, size, ["query", "absent", "x"]) == want


def test_files_of_a_folder_with_errors_by_row(spark, tmp_path):
    (tmp_path / "up").mkdir()
    (tmp_path / "up" / "a.csv").write_text('﻿query,max_results\n"climate\n""change""",20\n\n ,5\nok,many\n', encoding="utf-8")
    (tmp_path / "up" / "b.csv").write_text("language,query\r\nda,x\r\n,y", encoding="utf-8")
    (tmp_path / "up" / "empty.csv").write_text("query\n")
    for size in (3, 7, 1000):
        checked = bulk.validate(bulk.read_bulk_csv(spark, str(tmp_path / "up"), range_bytes=size))
        errors = {r["file"].rsplit("/", 1)[1]: r["validation_errors"] for r in bulk.validation_errors(checked).collect()}
        assert errors == {"a.csv": {"row_3": ["Query is required"], "row_4": ["max_results must be a number"]}}
        stored, status = bulk.stored_rows(spark, str(tmp_path / "up"), range_bytes=size)
        assert sorted((r["query"], r["language"]) for r in stored.collect()) == [("x", "da"), ("y", "en")]
        assert {r["file"].rsplit("/", 1)[1]: (r["row_count"], r["invalid_rows"]) for r in status.collect()} == {"a.csv": (3, 2), "b.csv": (2, 0)}
    (tmp_path / "up" / "c.csv").write_text("framing\nx\n")
    with pytest.raises(ValueError, match="missing required columns: query"):
        bulk.read_bulk_csv(spark, str(tmp_path / "up"))


def test_short_ranges_share_tasks_and_tasks_do_not_get_the_plan(spark, tmp_path):
    import pickle

    lines = [f'"q\n{i}",{i % 9}' for i in range(3000)]
    for name in ("a.csv", "b.csv"):
        (tmp_path / name).write_text("query,max_results\n" + "\n".join(lines) + "\n")
    found = csv_rows.read_rows(spark, str(tmp_path), ("query", "max_results"), range_bytes=50)
    assert found.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism + 1
    rows = sorted((r["file"][-5:], r["row_number"], r["query"], r["max_results"]) for r in found.collect())
    assert rows == [(f, i, f"q\n{i}", str(i % 9)) for f in ("a.csv", "b.csv") for i in range(3000)]
    plan = [["f", i, i + 1, False, 0] for i in range(5000)]
    reader = csv_rows._Rows({"path": "p", "plan": json.dumps(plan), "columns": "[]", "headers": "{}"})
    assert len(pickle.dumps(reader)) < 1000 and sum(len(s.ranges) for s in reader.partitions()) == 5000
