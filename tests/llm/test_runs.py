"""Periodic runs against a plain search over all periods and starts."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mapweave.llm import runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def smallest_period(words):
    return next(p for p in range(1, len(words) + 1) if words[p:] == words[: len(words) - p])


def plain_runs(words, exponent=4, least=6):
    found, n = [], len(words)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i + q - start
            if length >= max(least, exponent * q) and smallest_period(words[start: start + length]) == q:
                found.append((start, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    found = plain_runs(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *best, best[1] * 1000 // best[2] if found else None,
            sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=60), min_size=1, max_size=4), st.integers(3, 5), st.integers(1, 9))
def test_runs_equal_a_plain_search(texts, exponent, least):
    codes = np.array([w for t in texts for w in t], dtype=np.int64)
    at = np.cumsum([0] + [len(t) for t in texts])
    got = [tuple(map(int, r)) for r in np.array(runs.runs_of_batch(codes, at, exponent, least)).T]
    assert got == [(i, *r) for i, t in enumerate(texts) for r in plain_runs(t, exponent, least)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 5), min_size=1, max_size=7), st.integers(1, 9)), min_size=1, max_size=12))
def test_runs_of_repeated_phrases(parts):
    words = [w for phrase, times in parts for w in phrase * times]
    got = [tuple(map(int, r[1:])) for r in np.array(runs.runs_of_batch(np.array(words), np.array([0, len(words)]))).T]
    assert got == plain_runs(words)


def test_blocks_whose_hashes_are_equal_by_chance_are_compared():
    assert runs._exact(np.array([1, 2, 1, 3, 1, 3, 1, 3, 5, 5]), 2, 0, 10, 6) == [(2, 8)]
    words = np.array([1, 2, 1, 2, 1, 2, 9, 9])
    assert runs._exact(words, 2, 0, 8, 6) == [(0, 6)]


def test_long_texts_take_little_more_than_linear_time():
    words = np.random.default_rng(1).integers(0, 50, size=200_000)
    words[50_000:150_000] = np.tile(words[50_000:60_000], 10)
    words[160_000:190_000] = 7
    got = {(int(s), int(n), int(q)) for _, s, n, q in np.array(runs.runs_of_batch(words, np.array([0, len(words)]))).T}
    assert any(q == 10_000 and n >= 100_000 for _, n, q in got) and any(q == 1 and n >= 30_000 for _, n, q in got)


def test_query_on_awkward_rows_and_extra_columns(spark, tmp_path):
    phrase = "Ab cd ab "
    texts = [None, "", " \t\r\n\x0b\x0c", "a " * 5, "a " * 6, phrase * 3 + "Ab cd", phrase * 4, "x y " * 9, "é " * 30, "A a " * 8,
             "one two three four " * 150 + "end", "w " * 1_500, " ".join(str(i % 97) for i in range(1200)), "same", "same"]
    rows = [(i, texts[i % len(texts)], "k", 1, "r", "c", 3) for i in range(90)] + [(None, phrase * 5, "k", 1, "r", "c", 3), (4, "a " * 6, "k", 1, "r", "c", 3)]
    path = str(tmp_path / "t" / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, key string, n_words long, runs string, collapsed string, best int").repartition(5).write.parquet(path)
    from mapweave.llm.plans import QUERIES

    got = QUERIES["op11_periodic_runs"](spark, str(tmp_path / "t"))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted((plain_row(r[0], r[1]) for r in rows), key=str)


def test_query_equals_a_plain_search_on_given_documents(spark):
    from mapweave.llm.plans import QUERIES

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 2500").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r) for r in QUERIES["op11_periodic_runs"](spark, "/root/testdata/sf0.001").collect()}
    assert all(got[d["doc_id"]] == plain_row(d["doc_id"], d["text"]) for d in docs) and len(docs) > 50
    assert sum(r[1] > 0 for r in got.values()) > 5


def test_few_periods_are_refused(spark):
    with pytest.raises(ValueError, match="three periods"):
        runs.periodic_runs(spark.range(1).selectExpr("id", "'a' AS text"), "id", "text", exponent=2)
