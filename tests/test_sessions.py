import pytest
from pyspark.sql import functions as F

from mapweave.operators import compare, expansion, sessions, temporal
from mapweave.operators import sessions as sessions_ops


def results(spark, rows):
    return spark.createDataFrame(rows, "session_id bigint, url string, domain string, rank bigint, result_id bigint")


def test_dedup_keeps_the_first_of_a_session(spark):
    rows = [(1, 7, "https://A.com/x/", 1, 1), (1, 7, "https://a.com/x#frag", 2, 2), (1, 6, "https://a.com/x", 9, 3),
            (2, 8, "https://a.com/x", 1, 4)]
    df = spark.createDataFrame(rows, "session_id bigint, query_id bigint, url string, rank bigint, result_id bigint")
    assert {r["result_id"] for r in sessions.deduplicate_results(df).collect()} == {3, 4}
    assert {r["result_id"] for r in sessions.deduplicate_results(df, scope=("query_id",)).collect()} == {1, 3, 4}


def test_paging(spark):
    df = spark.range(95).select("id", (F.col("id") % 10).alias("v"))
    rows, facts = sessions.paginate(df, 99, 20, "v", "id", descending=True)
    assert facts == {"page": 5, "per_page": 20, "total": 95, "pages": 5, "has_next": False, "has_prev": True}
    assert rows.count() == 15
    assert [r["id"] for r in sessions.keyset_page(df, "id", 2, cursor=10).collect()] == [11, 12, 13]
    assert [r["id"] for r in sessions.keyset_page(df, "id", 2, cursor=10, backward=True).collect()] == [9, 8, 7]
    empty, facts = sessions.paginate(df.limit(0), 3, 20, "v", "id")
    assert facts["page"] == 1 and empty.isEmpty()


def test_venn(spark):
    sets = {1: (1, 2, 3), 2: (2, 3, 4), 3: (3, 5)}
    rows = [(s, f"u{x}", "d", 1, s * 10 + x) for s, xs in sets.items() for x in xs]
    got = {(r["metric"], r["label"]): r["value"] for r in compare.set_overlap(results(spark, rows), [1, 2, 3], "url").collect()}
    assert [got["only", k] for k in "123"] == [1, 1, 1]
    assert (got["and", "1_2"], got["and", "1_3"], got["and", "2_3"], got["all", ""]) == (1, 0, 0, 1)
    assert (got["jaccard", "1_2"], got["jaccard", "1_3"], got["jaccard", "2_3"]) == (0.5, 0.25, 0.25)
    two = {(r["metric"], r["label"]): r["value"] for r in compare.set_overlap(results(spark, rows), [1, 2], "url").collect()}
    assert two["only", "1"] == 1 and two["and", "1_2"] == 2
    with pytest.raises(ValueError):
        compare.set_overlap(results(spark, rows), [1], "url")
    with pytest.raises(ValueError):
        compare.compare(results(spark, rows), [1, 99])


def test_entropy_and_correlation(spark):
    rows = [(1, f"u{i}", d, i, i) for i, d in enumerate("aabc")] + [(2, f"u{i}", d, 3 - i, 10 + i) for i, d in enumerate("aabc")]
    df = results(spark, rows)
    assert compare.domain_profile(df, [1, 2]).filter("session_id = 1").first()["entropy"] == 1.5
    row = compare.rank_correlation(df, [1, 2]).first()
    assert (row["n"], row["rho"], row["p_value"]) == (4, -1.0, 0.0)


def test_trends(spark):
    seen = {"x": (1, 2), "y": (0, 1), "z": (0, 1, 2), "w": (0, 2)}
    rows = [(1, p, d, 5) for d, ps in seen.items() for p in ps]
    top = spark.createDataFrame(rows, "session_id int, period bigint, domain string, count bigint")
    got = {r["domain"]: r["trend"] for r in temporal.domain_trends(top).collect()}
    assert got == {"x": "emerging", "y": "declining", "z": "stable"}
    assert temporal.domain_trends(top.filter("period = 0")).isEmpty()


def test_candidate_score_and_filter(spark):
    terms = spark.createDataFrame([(1, "climate-policy", 6, 4, 2), (1, "2024", 9, 9, 9), (1, "ocean", 2, 0, 0)],
                                  "session_id bigint, term string, f_title bigint, f_description bigint, f_url bigint")
    seeds = spark.createDataFrame([(1, "climate change ocean")], "session_id bigint, seed string")
    corpus = terms.select("session_id", F.col("term").alias("text"), F.lit(1).cast("bigint").alias("n"))
    scored = {r["term"]: r for r in expansion.score_candidates(terms, corpus, seeds, similarity_threshold=0.0).collect()}
    row = scored["climate-policy"]
    assert row["frequency_score"] == 1.0 and row["diversity_score"] == pytest.approx(3 / 7)
    assert row["position_score"] == pytest.approx((6 * 3 + 4 * 2 + 2 * 1.5) / 12 / 3)
    assert 0 < row["similarity"] < 1 and scored["2024"]["similarity"] == 0
    score = 0.25 + 0.2 * 3 / 7 + 0.25 * row["position_score"] + 0.2 * row["similarity"]
    assert row["score"] == pytest.approx(score)
    similar = expansion.score_candidates(terms, corpus, seeds)
    assert {r["term"] for r in similar.collect()} == {"climate-policy", "ocean"}
    kept = expansion.filter_candidates(similar, seeds)
    assert [r["term"] for r in kept.collect()] == ["climate-policy"]


def test_vectors_against_a_plain_computation(spark):
    import math

    cands, corpus, seed = ["sea ice", "sea level", "tax"], ["sea", "sea", "ice tax", "level"], "sea ice loss"
    c = spark.createDataFrame([(1, x, 1) for x in cands], "k bigint, term string, copies bigint")
    t = spark.createDataFrame([(1, "sea", 2), (1, "ice tax", 1), (1, "level", 1)], "k bigint, text string, n bigint")
    s = spark.createDataFrame([(1, seed)], "k bigint, seed string")
    docs = [seed.split()] + [x.split() for x in cands] + [x.split() for x in corpus]
    idf = {w: math.log((1 + len(docs)) / (1 + sum(w in d for d in docs))) + 1 for d in docs for w in d}

    def cosine(a, b):
        va, vb = ({w: x.count(w) * idf[w] for w in x} for x in (a, b))
        dot = sum(va[w] * vb.get(w, 0) for w in va)
        return dot / math.sqrt(sum(v * v for v in va.values()) * sum(v * v for v in vb.values()))

    got = {r["term"]: r["similarity"] for r in expansion.similarity(c, t, s, "k").collect()}
    assert got == {x: pytest.approx(cosine(seed.split(), x.split())) for x in cands}


def test_generations(spark):
    stored = spark.createDataFrame([(1, "a", 1, None), (1, "b", 1, None)], "session_id bigint, term string, generation bigint, approved boolean")
    choice = spark.createDataFrame([(1, "a", True)], "session_id bigint, term string, approved boolean")
    rows = expansion.next_generation(expansion.decide(stored, choice)).collect()
    assert [(r["query_text"], r["generation"]) for r in rows] == [("a", 2)]


def test_nested_documents_are_one_json_array(spark, tmp_path):
    import json

    from mapweave.sources.documents import write_document

    frame = spark.createDataFrame
    sessions = frame([(1, 'a "x"'), (2, "b"), (7, "no queries")], "session_id bigint, name string")
    queries = frame([(1, 10, "q"), (1, 11, "none found"), (2, 5, "é")], "session_id bigint, query_id bigint, query_text string")
    results = frame([(10, i, i % 900 // 2, f"u{i}", "t\n") for i in range(2000)] + [(5, 9999, 1, "v", None)],
                    "query_id bigint, result_id bigint, rank bigint, url string, title string")
    lines = sessions_ops.result_documents(sessions, queries, results)
    write_document(lines.repartition(9).orderBy(*sessions_ops.DOCUMENT_ORDER), str(tmp_path / "s.json"))
    with open(tmp_path / "s.json", encoding="utf-8") as file:
        found = json.load(file)
    assert [(s["session_id"], s["name"], [(q["query_id"], len(q["results"])) for q in s["queries"]]) for s in found] == [
        (1, 'a "x"', [(10, 2000), (11, 0)]), (2, "b", [(5, 1)]), (7, "no queries", [])]
    urls = [r["url"] for r in found[0]["queries"][0]["results"]]
    assert urls == [f"u{i}" for i in sorted(range(2000), key=lambda i: (i % 900 // 2, i))]


def test_nested_documents_are_read_by_ranges(spark, tmp_path):
    from mapweave.sources.documents import read_document, write_document

    frame = spark.createDataFrame
    sessions = frame([(1, 'a "x"'), (2, "b"), (7, "no queries")], "session_id bigint, name string")
    queries = frame([(1, 10, "q"), (1, 11, "none found"), (2, 5, "é")], "session_id bigint, query_id bigint, query_text string")
    results = frame([(10, i, i, f"u{i}", '{"session_id":3}\n') for i in range(2000)] + [(5, 9999, None, "v", None)],
                    "query_id bigint, result_id bigint, rank bigint, url string, title string")
    path = str(tmp_path / "s.json")
    write_document(sessions_ops.result_documents(sessions, queries, results).orderBy(*sessions_ops.DOCUMENT_ORDER), path)
    bound = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")  # a query goes through many blocks
    try:
        lines = read_document(spark, path)
        assert lines.select("block").distinct().count() > 9
        rows = sessions_ops.read_result_documents(lines).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", bound)
    of = lambda kind: [r for r in rows if r["kind"] == kind]
    assert sorted((r["session_id"], r["name"]) for r in of("session")) == [(1, 'a "x"'), (2, "b"), (7, "no queries")]
    assert sorted((r["session_id"], r["query_id"], r["query_text"]) for r in of("query")) == [(1, 10, "q"), (1, 11, "none found"), (2, 5, "é")]
    assert sorted((r["session_id"], r["query_id"], r["url"]) for r in of("result")) == sorted([(1, 10, f"u{i}") for i in range(2000)] + [(2, 5, "v")])


def test_content_documents_hold_everything(spark):
    frame = spark.createDataFrame
    contents = frame([(1, "en"), (2, "da")], "content_id bigint, language string")
    words = frame([(1, "a", 2, 0.5), (1, "b", 1, 0.9)], "content_id bigint, lemma string, frequency bigint, tfidf_score double")
    names = frame([(1, "X", "ORG", 1), (1, "Y", "ORG", 3)], "content_id bigint, text string, label string, frequency bigint")
    analysis = frame([(2, "completed", 4)], "content_id bigint, status string, nouns_count bigint")
    rows = {r["content_id"]: r for r in sessions_ops.content_documents(contents, words, names, analysis).collect()}
    assert rows[1]["keywords"] == '[{"position":1,"lemma":"b","frequency":1},{"position":2,"lemma":"a","frequency":2}]'
    assert rows[1]["entities"] == '[{"text":"Y","label":"ORG","frequency":3},{"text":"X","label":"ORG","frequency":1}]'
    assert rows[1]["analysis"] is None and rows[2]["analysis"] == '{"status":"completed","nouns_count":4}' and rows[2]["keywords"] is None


@pytest.mark.parametrize("descending", [False, True])
def test_page_index_equals_sort_and_offset(spark, descending):
    rows = [(i, (i * 7919) % 13 if i % 10 else None, i) for i in range(997)]  # many ties, some nulls
    df = spark.createDataFrame(rows, "id bigint, k bigint, v bigint")
    index = sessions_ops.PageIndex(df, "k", "id", descending, ranges=8)
    assert len(index.counts) > 3
    for page in (1, 2, 40, 99, 100, 500):
        got, facts = index.page(page, 10)
        want, same = sessions_ops.paginate(df, page, 10, "k", "id", descending)
        assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()] and facts == same
    assert sessions_ops.PageIndex(df.limit(0), "k", "id").page(3, 10)[0].count() == 0


def test_session_results_move_no_texts(spark):
    from mapweave.plans import roles

    t = roles.Tables(spark, "/root/testdata/sf0.001")
    roles._WRITTEN.clear()
    found = roles.ROLES["session_results"](t)
    assert not any(place[2] == "search_results" for place in roles._WRITTEN)  # not read from a wide table that is written first
    queries = t.search_queries.drop("search_engine")
    same = t.search_results.join(queries, "query_id").select(found.columns)
    assert found.exceptAll(same).count() == same.exceptAll(found).count() == 0
    assert found.count() == same.count() > 0
