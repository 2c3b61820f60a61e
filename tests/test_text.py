import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from mapweave.functions import text as tx
from mapweave.operators import entities, keywords, tfidf
from mapweave.session import materialize


def test_tfidf_of_a_small_corpus(spark):
    docs = spark.createDataFrame(
        [(0, ["hello", "world", "hello"]), (1, ["hello", "world"]), (2, ["foo", "bar"]), (3, ["hello", "foo"])],
        "doc_id bigint, terms array<string>",
    )
    got = {r["term"]: r["tfidf"] for r in tfidf.tfidf(docs, "doc_id", F.col("terms")).filter("doc_id = 0").collect()}
    assert got["hello"] == pytest.approx(2 / 3 * (math.log(5 / 4) + 1))
    assert got["world"] == pytest.approx(1 / 3 * (math.log(5 / 3) + 1))
    weighted = tfidf.tfidf(docs, "doc_id", F.col("terms"), idf_weight=9.0).filter("doc_id = 0 AND term = 'hello'").first()
    assert weighted["tfidf"] == pytest.approx(2 / 3 * (math.log(5 / 4) + 1) ** 2)
    alone = tfidf.tfidf(docs, "doc_id", F.col("terms"), corpus="none").filter("doc_id = 0 AND term = 'hello'").first()
    assert alone["tfidf"] == pytest.approx(2 / 3)


def test_copies_of_a_text_do_not_count_against_it(spark):
    rows = [(0, "sun moon"), (1, "sun moon"), (2, "sun moon"), (3, "star moon")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = tfidf.tfidf(docs, "doc_id", F.split("text", " "), corpus="unique", text_col="text")
    score = {(r["doc_id"], r["term"]): (r["df"], r["tfidf"]) for r in got.collect()}
    # N = 4 - 2 = 2, df(sun) = 3 - 2 = 1, df(moon) = 4 - 2 = 2
    assert score[0, "sun"] == (1, pytest.approx(0.5 * (math.log(3 / 2) + 1)))
    assert score[0, "moon"] == (2, pytest.approx(0.5))
    assert score[3, "moon"][0] == 4


def test_ngrams_of_short_documents(spark):
    df = spark.createDataFrame([(["a"],), (["a", "b", "c"],), ([],)], "t array<string>")
    assert [r[0] for r in df.select(tx.ngrams("t", 2)).collect()] == [[], ["a b", "b c"], []]
    assert [r[0] for r in df.select(tx.ngrams("t", 1)).collect()] == [[], [], []]


def test_token_offsets_point_into_the_text(spark):
    text = "  Über die Straße, naïve — 42 tests."
    df = spark.createDataFrame([(7, text, "de"), (8, "", "de"), (9, " .. ", "de")], "doc_id bigint, text string, lang string")
    rows = keywords.tokens(df, language_col="lang").orderBy("doc_id", "pos_idx").collect()
    assert {r["doc_id"] for r in rows} == {7}
    assert [r["token"] for r in rows] == ["Über", "die", "Straße", "naïve", "42", "tests"]
    assert all(text[r["char_pos"]:].startswith(r["token"]) for r in rows)


def test_noun_keywords_word_positions_and_score(spark):
    df = spark.createDataFrame([(1, "Nation nation NATION nation moment run run run")], "doc_id bigint, text string")
    tag = lambda w: F.when(w.rlike("tion$|ment$"), "NOUN").otherwise("VERB")
    got = keywords.pos_keywords(keywords.tokens(df, upos=tag)).collect()
    assert len(got) == 1  # 'moment' occurs once, below the minimum frequency
    row = got[0]
    assert (row["lemma"], row["word"], row["frequency"], row["pos_tag"]) == ("nation", "nation", 4, "NOUN")
    assert row["positions"] == [0, 7, 14, 21]
    assert row["tfidf_score"] == pytest.approx(4 / 5 * (math.log(2 / 2) + 1))


def rake_by_hand(text, stops, max_length=3):
    import re

    phrases, run = [], []
    for piece in re.findall(r"\w+|[^\w\s]+", text.lower()) + ["."]:
        if piece in stops or not re.match(r"\w", piece):
            if run and len(run) <= max_length and run not in phrases:
                phrases.append(run)
            run = []
        else:
            run.append(piece)
    words = [(w, len(p)) for p in phrases for w in p]
    ratio = {w: sum(n for v, n in words if v == w) / sum(1 for v, _ in words if v == w) for w, _ in words}
    return {" ".join(p): round(sum(ratio[w] for w in p), 6) for p in phrases}


def test_rake_equals_a_plain_loop(spark):
    from mapweave.functions.words import ENGLISH_STOP_WORDS

    text = ("Climate change is a global problem. The climate of the planet, and climate change policy! "
            "Deep ocean warming trends continue; global problem again.")
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    got = {r["phrase"]: r["score"] for r in keywords.rake_keywords(df).collect()}
    expected = rake_by_hand(text, set(ENGLISH_STOP_WORDS))
    assert got == {k: v for k, v in expected.items() if v >= 1}


def test_method_dispatch_errors(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id bigint, text string")
    with pytest.raises(ValueError):
        keywords.extract_keywords(df, "magic")
    with pytest.raises(ValueError):
        keywords.extract_keywords(df, "noun")


def test_annotator_plugs_in(spark):
    df = spark.createDataFrame([(1, "en", "sea level")], "doc_id bigint, language string, text string")

    def tagger(batches):
        for batch in batches:
            rows = [
                (d, i, 0, w, w, "NOUN", False, False)
                for d, t in zip(batch.doc_id, batch.text) for i, w in enumerate(t.split())
            ]
            import pandas as pd

            yield pd.DataFrame(rows, columns="doc_id pos_idx char_pos token lemma upos is_stop is_punct".split())

    assert keywords.annotate(df, tagger).count() == 2


def test_entities_first_spelling_and_threshold(spark):
    m = spark.createDataFrame(
        [(1, "WHO ", "ORG", 5, 0.9), (1, "who", "ORG", 2, None), (1, "Paris", "GPE", 9, 0.2), (1, "x", "ORG", 1, 1.0)],
        "content_id bigint, text string, label string, start_pos bigint, confidence double",
    )
    unique = entities.unique_entities(m).collect()
    assert {(r["text"], r["label"]) for r in unique} == {("who", "ORG"), ("Paris", "GPE")}
    best = entities.aggregate_mentions(m, 0.85).orderBy("position").collect()
    assert [(r["text"], r["frequency"], r["confidence"]) for r in best] == [("who", 2, 1.0), ("x", 1, 1.0)]


def test_language_votes(spark):
    df = spark.createDataFrame(
        [("the cat is on the mat and it was good for the dog to be there",),
         ("der Hund und die Katze sind nicht auf dem Dach des Hauses in Bonn",), ("short",)], "t string")
    assert [r[0] for r in df.select(tx.detect_language("t")).collect()] == ["en", "de", None]


def test_offsets_of_long_texts(spark):
    from mapweave.functions.places import matches, running_sums

    text = "  é1 bb. ccc\n" * 300
    got = spark.createDataFrame([(text,), ("",), (".",)], "t string").select(matches(F.col("t"), tx.WORD).alias("m")).collect()
    assert all(text[m["start"]: m["start"] + len(m["token"])] == m["token"] for m in got[0]["m"]) and len(got[0]["m"]) == 900
    assert got[1]["m"] == [] and got[2]["m"] == []
    sums = spark.range(1).select(running_sums(F.sequence(F.lit(1), F.lit(200))).alias("s")).first()["s"]
    assert sums == [i * (i + 1) // 2 for i in range(200)]


def test_scratch_removes_what_was_written_inside(spark):
    import os

    from mapweave.session import materialize, scratch

    with scratch(spark):
        inside = materialize(spark.range(3))
        assert inside.count() == 3 and os.path.isdir(inside._mapweave_path)
    assert not os.path.isdir(inside._mapweave_path)


def test_annotator_as_a_table_function(spark):
    from mapweave.operators.annotate import register_annotator

    register_annotator(spark, lambda word, language: f"{language}:{len(word)}", "tag_texts")
    rows = spark.createDataFrame([(1, "The cat_s, été", "en"), (2, None, "da"), (3, "og 12", "da")], "doc_id bigint, body string, lang string")
    got = spark.sql("SELECT * FROM tag_texts(TABLE({rows}), 'doc_id', 'body', 'lang')", rows=rows).collect()
    assert sorted((r["doc_id"], r["pos_idx"], r["char_pos"], r["token"], r["upos"], r["is_stop"]) for r in got) == [
        (1, 0, 0, "The", "en:3", True), (1, 1, 4, "cat", "en:3", False), (1, 2, 8, "s", "en:1", True), (1, 3, 11, "été", "en:3", False),
        (3, 0, 0, "og", "da:2", True), (3, 1, 3, "12", "da:2", False)]
    with pytest.raises(Exception, match="no column 'text'"):
        spark.sql("SELECT * FROM tag_texts(TABLE({rows}), 'doc_id', 'text')", rows=rows).collect()


def test_ngrams_move_texts_not_grams(spark, tmp_path):
    """One file is one task: texts are dealt by document before words and n-grams are made, and the counts need no other shuffle."""
    import re

    import __spark_entry__ as entry_point

    texts = [(i, f"alpha beta gamma alpha beta {i}", "en", "web", 30) for i in range(40)]
    spark.createDataFrame(texts, "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    found = entry_point.queries()["g2_ngrams"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"Exchange hashpartitioning\((\w+)#\d+L?, \d+\)", plan) == ["doc_id"] and plan.count("Exchange") == 1
    assert {(r["gram"], r["n"]) for r in found.where("doc_id = 7").collect()} >= {("alpha beta", 2), ("gamma alpha beta", 1)}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_words_are_made_once_and_after_the_deal(spark):
    docs = spark.createDataFrame([(1, "sun moon sun"), (2, ""), (3, None)], "doc_id bigint, text string")
    counts = tfidf.term_counts(docs, "doc_id", tx.content_words("text"))
    assert _plan(counts).count("split(") == 1
    assert sorted(map(tuple, counts.collect())) == [(1, 3, "moon", 1), (1, 3, "sun", 2)]


@pytest.mark.parametrize("common", [1, 40, 10**6])
@pytest.mark.parametrize("weight", [0.0, 1.0, 1.5])
def test_best_terms_are_those_of_the_full_ranking(spark, common, weight):
    rows = [(i, " ".join(f"w{i * j * j % (7 + i % 40)}" for j in range(i % 23)) + " rare" * (i % 5)) for i in range(60)]
    docs = spark.createDataFrame([*rows, (60, None), (61, "Ünique ünique"), (62, "!")], "doc_id bigint, text string")
    words = tfidf.with_bigrams(tx.content_words("text"))
    got = tfidf.best_terms(docs, "doc_id", words, 4, weight, common=common)
    full = tfidf.top_terms(tfidf.tfidf(docs, "doc_id", words, weight), "doc_id", 4)
    key = lambda r: (r["doc_id"], r["position"])
    assert sorted(got.collect(), key=key) == sorted(full.select(got.columns).collect(), key=key)
    assert got.columns == full.columns


def test_words_are_counted_in_batches(spark, monkeypatch):
    monkeypatch.setattr(tfidf, "PART_BYTES", 8)
    rows = [(1, "en", "The sun, a SUN and Sonne"), (2, "de", "Der Mond und the moon Mond"), (3, None, "le the 1² x_yy"), (4, "xx", None),
            (5, "fr", " "), (6, "fr", "le Soleil ÉTÉ été, ٣٤ 𝔘𝔫 Ⅷa"), (7, "en", "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, lang string, text string")
    for language in (None, "lang"):
        terms = tx.content_words("text", language)
        counted = docs.select("doc_id", tfidf.word_counts("text", language).alias("c"), terms.alias("ts"))
        for r in counted.collect():
            assert r["c"]["n_terms"] == len(r["ts"] or [])
            assert sorted(map(tuple, r["c"]["counts"])) == sorted(Counter(r["ts"] or []).items())
        plain = tfidf.best_terms(docs, "doc_id", terms, 3)
        found = tfidf.best_terms(docs, "doc_id", terms, 3, counted=tfidf.word_counts("text", language))
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.select(found.columns).collect()))
    empty = docs.limit(0).select(tfidf.word_counts("text").alias("c"))
    assert empty.count() == 0


def test_as_many_frequencies_are_sent_as_may_be(spark):
    spread = spark.createDataFrame([("a", 9), ("b", 5), ("c", 5), ("d", 3), ("e", 2), ("f", 2)], "term string, df bigint")
    found = {common: tfidf._least(spread, 6, common) for common in (2, 4, 5, 7)}
    assert found == {2: 6, 4: 5, 5: 3, 7: 2}


def test_candidates_are_chosen_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(tfidf, "materialize", lambda df: written.append(df) or materialize(df))
    docs = spark.createDataFrame([(1, "sun moon sun"), (2, "moon star")], "doc_id bigint, text string")
    best = tfidf.best_terms(docs, "doc_id", tx.content_words("text"), 3)
    assert sum("chosen(" in _plan(df) for df in written) == 1 and "chosen(" not in _plan(best)


def test_no_documents_have_no_best_terms(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert tfidf.best_terms(docs, "doc_id", tx.content_words("text"), 3).count() == 0


def test_texts_are_cut_once_in_batches(spark):
    rows = [(1, "a²b _x_ ٣٤ 𝔘𝔫 Ⅷ"), (2, " "), (3, None), (4, "...")]
    found = keywords.tokens(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert _plan(found).count("_places(") == 1 and "regexp_extract_all" not in _plan(found)
    assert [(r["doc_id"], r["char_pos"], r["token"]) for r in found.orderBy("pos_idx").collect()] == [
        (1, 0, "a²b"), (1, 5, "x"), (1, 8, "٣٤"), (1, 11, "𝔘𝔫"), (1, 14, "Ⅷ")]


def test_terms_meet_their_frequency_without_joined_or_sorted_rows(spark):
    docs = spark.createDataFrame([(1, "sun moon sun"), (2, "moon star"), (3, None)], "doc_id bigint, text string")
    for cut in (None, tfidf.content_cut("text", bigrams=True)):
        plan = _plan(tfidf.tfidf(docs, "doc_id", tfidf.with_bigrams(tx.content_words("text")), cut=cut))
        assert plan.count("Exchange") == 2 and "Join" not in plan and "Sort" not in plan and "Aggregate" not in plan


@pytest.mark.parametrize("bigrams", [False, True])
def test_frequencies_do_not_depend_on_blocks_and_parts(spark, monkeypatch, bigrams):
    monkeypatch.setattr(tfidf, "BLOCK_BYTES", 400)
    monkeypatch.setattr(tfidf, "ROWS", 3)
    texts = [" ".join(f"w{i * j * j % (7 + i % 40)}" for j in range(i % 23)) + " the rare" * (i % 5) for i in range(60)]
    texts += [None, "", "!", "Ünique ünique the ünique", "a sun", "moon " * 300, "moon moon", "٣٤ 𝔘𝔫 Ⅷa"]
    docs = spark.createDataFrame([(f"d{i}", text) for i, text in enumerate(texts)], "doc_id string, text string")
    words = tx.content_words("text")
    words = tfidf.with_bigrams(words) if bigrams else words
    listed = {r["doc_id"]: Counter(r["ts"] or []) for r in docs.select("doc_id", words.alias("ts")).collect()}
    df = Counter(term for counts in listed.values() for term in counts)
    expected = sorted(
        (d, term, n, counts.total(), df[term], pytest.approx(n / counts.total() * (math.log((len(texts) + 1) / (df[term] + 1)) + 1)))
        for d, counts in listed.items() for term, n in counts.items()
    )
    for cut in (None, tfidf.content_cut("text", bigrams)):
        found = tfidf.tfidf(docs, "doc_id", words, cut=cut)
        assert found.columns == ["doc_id", "term", "n", "n_terms", "df", "tfidf"]
        assert sorted(map(tuple, found.collect())) == expected
        assert tfidf.tfidf(docs.limit(0), "doc_id", words, cut=cut).count() == 0


def test_null_terms_count_in_the_length_only(spark):
    docs = spark.createDataFrame([(1, ["sun", None, "sun"]), (2, None), (3, []), (4, [None])], "doc_id int, terms array<string>")
    found = tfidf.tfidf(docs, "doc_id", F.col("terms"))
    assert [tuple(r)[:5] for r in found.collect()] == [(1, "sun", 2, 3, 1)]


def test_rows_of_one_id_are_one_document(spark):
    rows = [(1, "sun moon sun"), (1, "sun moon sun"), (1, "sun"), (None, "moon"), (2, "moon star")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    expected = [(None, "moon", 1, 1, 3), (1, "moon", 2, 3, 3), (1, "sun", 1, 1, 1), (1, "sun", 4, 3, 1), (2, "moon", 1, 2, 3), (2, "star", 1, 2, 1)]
    for cut in (None, tfidf.content_cut("text")):
        found = tfidf.tfidf(docs, "doc_id", tx.content_words("text"), cut=cut)
        assert sorted((tuple(r)[:5] for r in found.collect()), key=str) == sorted(expected, key=str)
