"""Ranked search against plain scoring of every document for every query."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mapweave.llm import ranked
from mapweave.llm.plans import QUERIES, SQL

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def plain_search(docs, items, k=10):
    split = [(d[0], terms(d[1])) for d in docs]
    n_docs, n_terms = sum(bool(t) for _, t in split), sum(len(t) for _, t in split)
    df = Counter(t for _, ts in split for t in set(ts))
    out = []
    for item_id, text in items:
        rows = []
        for doc_id, ts in split:
            tf, score = Counter(ts), 0
            m = 100 - 75 + (75 * len(ts) * n_docs) // n_terms if n_terms else 0
            for t in terms(text):
                if tf[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((1000000000 * tf[t]) // (1000 * tf[t] + 8 * m))
            if score > 0:
                rows.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, i + 1, r[3], -r[0]) for i, r in enumerate(sorted(rows)[:k])]
    return out


def awkward():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)] + ["Über", "ÜBER", "x-y", "A_B", "9", "日本語"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.randint(1, 60)))) for i in range(300)]
    docs += [(400 + i, docs[7][1]) for i in range(50)] + [(390, docs[7][1].upper()), docs[7], docs[7], (None, docs[7][1]), (None, None)]
    docs += [(500, None), (501, ""), (502, " -- \n"), (503, "w1 " * 30_000), (504, "w0\x00w1"), (505, "a" * 100_000)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(20)]
    items += [(50, None), (51, ""), (52, "?"), (53, "absent"), (54, "w1 W1 w1"), (55, docs[7][1]), (56, "日本語"), items[3], (None, "w2 w3")]
    return docs, items


def write(spark, path, docs, items, parts=6):
    extra = ("k", 1, 2, 3)
    spark.createDataFrame([(*d, *extra) for d in docs], "doc_id long, text string, key string, score long, rank int, n int").repartition(parts).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(*i, *extra) for i in items], "item_id long, text string, key string, score long, rank int, query int").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_query_equals_plain_scoring(spark, tmp_path, monkeypatch):
    docs, items = awkward()
    path = write(spark, tmp_path / "t", docs, items)
    want = sorted(plain_search(docs, items), key=str)
    assert sorted(map(tuple, QUERIES["op12_best_position"](spark, path).collect()), key=str) == want
    small = ranked.search(spark.read.parquet(f"{path}/documents.parquet"), "doc_id", "text",
                          spark.read.parquet(f"{path}/benchmark.parquet"), "item_id", "text", query_bytes=150)
    assert sorted(map(tuple, small.collect()), key=str) == want


@pytest.mark.parametrize("docs,items", [([], [(1, "a")]), ([(1, "a")], []), ([(1, None)], [(1, "a")]), ([], [])])
def test_empty_tables(spark, tmp_path, docs, items):
    assert QUERIES["op12_best_position"](spark, write(spark, tmp_path / "t", docs, items)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_blocks_give_the_best_with_all_ties(data):
    docs = data.draw(st.lists(st.lists(st.integers(0, 4), min_size=1, max_size=8), min_size=1, max_size=40))
    flat = [(d, t, c) for d, ts in enumerate(docs) for t, c in sorted(Counter(ts).items())]
    doc, term, tf = (np.array(c, dtype=np.int64) for c in zip(*flat, strict=True))
    n = np.array([len(d) for d in docs])
    weights = np.array(data.draw(st.lists(st.integers(0, 9), min_size=5, max_size=5)))
    block = ranked.Block(n, doc, term, tf, ranked.Corpus(len(docs), int(n.sum()), weights))
    k, floor = data.draw(st.integers(1, 5)), data.draw(st.integers(1, 100_000))
    m = 25 + 75 * n * len(docs) // n.sum()
    score = [sum(int(weights[t]) * (10**9 * c // (1000 * c + 8 * int(m[d]))) for t, c in Counter(ts).items()) for d, ts in enumerate(docs)]
    found, got = block.best(np.arange(5), weights, k, floor)
    assert all(score[d] == s for d, s in zip(found.tolist(), got.tolist(), strict=True))
    kth = max(sorted(score)[-k] if len(score) >= k else 0, floor)
    assert {d for d, s in enumerate(score) if s >= kth} <= set(found.tolist())


def test_reading_stops_early():
    rng = np.random.default_rng(3)
    n = np.full(8000, 50)
    doc = np.repeat(np.arange(8000), 3)
    tf = rng.zipf(1.6, size=24000).clip(1, 60)
    block = ranked.Block(n, doc, np.tile(np.arange(3), 8000), tf, ranked.Corpus(8000, 400_000, np.array([5, 3, 2])))
    found, scores = block.best(np.arange(3), np.array([5, 3, 2]), 10, 1)
    assert len(found) < 4000
    all_scores = np.zeros(8000, dtype=np.int64)
    np.add.at(all_scores, block.doc, block.impact * np.repeat([5, 3, 2], np.diff(block.at)))
    assert sorted(scores)[-10:] == sorted(all_scores)[-10:]


def test_query_equals_sql(spark):
    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}/{name}.parquet'")
    got = QUERIES["op12_best_position"](spark, path)
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(SQL["op12_best_position"]).fetchall())
