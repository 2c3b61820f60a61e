"""Proposing new search terms from results, contents and suggestions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mapweave.functions import words
from mapweave.functions.skew import top_n
from mapweave.functions.text import meaningful_terms
from mapweave.functions.urls import url_terms
from mapweave.session import materialize

# Weight of a source in the position score.
SOURCE_WEIGHTS = {
    "title": 3.0,
    "description": 2.0,
    "url": 1.5,
    "content_noun": 2.5,
    "content_entity": 3.0,
    "suggestion": 2.0,
    "meta_keyword": 1.5,
}


def _frequency(source: str) -> Column:
    return F.coalesce(F.col(f"f_{source}"), F.lit(0))


def _with_all_sources(df: DataFrame) -> DataFrame:
    have = set(df.columns)
    extra = {f"f_{s}": F.lit(0).cast("bigint") for s in SOURCE_WEIGHTS if f"f_{s}" not in have}
    if "tfidf" not in have:
        extra["tfidf"] = F.lit(None).cast("double")
    if "copies" not in have:
        extra["copies"] = F.lit(1).cast("bigint")
    return df.withColumns(extra) if extra else df


def result_terms(results: DataFrame, key: str = "session_id") -> DataFrame:
    """(key, term, f_title, f_description, f_url) from titles, snippets and URL paths.

    Equal results are counted before they are split, so a result found by many queries is split once.
    """
    grouped = results.groupBy(key, "title", "description", "url").agg(F.count(F.lit(1)).alias("n"))
    texts = (("title", meaningful_terms("title")), ("description", meaningful_terms("description")), ("url", url_terms("url")))
    every = grouped.select(
        key, "n", F.inline(F.array(*[F.struct(F.lit(s).alias("source"), ts.alias("terms")) for s, ts in texts]))
    ).select(key, "n", "source", F.explode("terms").alias("term"))
    sums = [
        F.sum(F.when(F.col("source") == s, F.col("n")).otherwise(0)).alias(f"f_{s}") for s in ("title", "description", "url")
    ]
    return every.groupBy(key, "term").agg(*sums)


def content_candidates(nouns: DataFrame, mentions: DataFrame, key: str = "session_id", n: int = 50) -> DataFrame:
    """Candidates from the ``n`` best noun rows and the ``n`` commonest entity texts of every key.

    A lemma listed twice keeps its lowest-scored row. Terms under three characters are dropped.
    """
    best = top_n(nouns, [key], [F.desc("tfidf_score"), F.col("lemma"), F.col("content_id")], n)
    from_nouns = (
        best.select(key, F.lower("lemma").alias("term"), "frequency", "tfidf_score", "content_id")
        .filter(F.length("term") >= 3)
        .groupBy(key, "term")
        .agg(
            F.min_by("frequency", F.struct("tfidf_score", -F.col("content_id"))).alias("f_content_noun"),
            F.min("tfidf_score").alias("tfidf"),
        )
    )
    counted = mentions.filter(F.col("text") != "").groupBy(key, F.lower("text").alias("term")).agg(
        F.count(F.lit(1)).alias("f_content_entity"), F.array_sort(F.collect_set("label")).alias("labels")
    )
    from_entities = top_n(counted, [key], [F.desc("f_content_entity"), F.col("term")], n).filter(F.length("term") >= 3)
    return from_nouns.join(from_entities, [key, "term"], "full_outer").na.fill(0, ["f_content_noun", "f_content_entity"])


def noun_corpus(nouns: DataFrame, mentions: DataFrame, key: str = "session_id", n: int = 50) -> DataFrame:
    """(key, text, n): the words of the best nouns and all entity texts."""
    best = top_n(nouns, [key], [F.desc("tfidf_score"), F.col("lemma"), F.col("content_id")], n)
    every = best.select(key, F.col("word").alias("text")).unionByName(mentions.select(key, "text"))
    return every.groupBy(key, "text").agg(F.count(F.lit(1)).alias("n"))


def suggestion_terms(suggestions: DataFrame, seeds: DataFrame, key: str = "lang") -> DataFrame:
    """One row per occurrence of a meaningful term that the seed text does not contain.

    ``suggestions`` has (key, suggestion_id, text), ``seeds`` (key, seed).
    """
    return (
        suggestions.join(seeds, key)
        .select(key, "suggestion_id", "seed", F.posexplode(meaningful_terms("text")).alias("position", "term"))
        .filter(~F.contains(F.lower("seed"), F.col("term")))
        .drop("seed")
    )


def _vector_tokens(text: Column) -> Column:
    """Tokens of the vectoriser: two word characters or more, no stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), 0)
    return F.filter(found, lambda w: ~w.isin(*words.ENGLISH_STOP_WORDS))


def similarity(
    candidates: DataFrame, corpus: DataFrame, seeds: DataFrame, key: str, max_features: int = 1000
) -> DataFrame:
    """(key, term, similarity): cosine of TF-IDF vectors of candidate and seed.

    The documents are the seed, every candidate (``copies`` times) and the corpus texts (``n`` times), each
    counted once per distinct text. idf is smoothed, rows have length 1, and the vocabulary of a key is its
    ``max_features`` commonest tokens, which bounds every table after it.
    """
    texts = (
        candidates.select(key, F.col("term").alias("text"), F.col("copies").alias("n"))
        .unionByName(corpus.select(key, "text", "n"))
        .unionByName(seeds.select(key, F.col("seed").alias("text"), F.lit(1).cast("bigint").alias("n")))
    )
    totals = texts.groupBy(key).agg(F.sum("n").alias("n_docs"))
    occurrences = texts.select(key, "text", "n", F.explode(_vector_tokens(F.col("text"))).alias("token"))
    # One row per (text, token) would need the text as a key; distinct tokens are split off in the row instead.
    spread = texts.select(key, "n", F.explode(F.array_distinct(_vector_tokens(F.col("text")))).alias("token"))
    df = spread.groupBy(key, "token").agg(F.sum("n").alias("df"))
    cf = occurrences.groupBy(key, "token").agg(F.sum("n").alias("cf"))
    vocabulary = top_n(df.join(cf, [key, "token"]), [key], [F.desc("cf"), F.col("token")], max_features)
    idf = vocabulary.join(totals, key).select(
        key, "token", (F.log((F.col("n_docs") + 1) / (F.col("df") + 1)) + 1).alias("idf")
    )

    def vectors(docs: DataFrame, name: str) -> DataFrame:
        counts = (
            docs.select(key, name, F.explode(_vector_tokens(F.col(name))).alias("token"))
            .groupBy(key, name, "token")
            .agg(F.count(F.lit(1)).alias("tf"))
        )
        return counts.join(idf, [key, "token"]).select(key, name, "token", (F.col("tf") * F.col("idf")).alias("w"))

    seed_vectors = vectors(seeds.select(key, "seed"), "seed")
    seed_norm = seed_vectors.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("seed_norm"))
    seed_side = seed_vectors.select(key, "token", F.col("w").alias("seed_w"))
    return (
        vectors(candidates.select(key, "term").distinct(), "term")
        .join(seed_side, [key, "token"], "left")
        .groupBy(key, "term")
        .agg(
            F.sum(F.col("w") * F.coalesce("seed_w", F.lit(0.0))).alias("dot"),
            F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"),
        )
        .join(seed_norm, key, "left")
        .select(key, "term", F.coalesce(F.try_divide("dot", F.col("norm") * F.col("seed_norm")), F.lit(0.0)).alias("similarity"))
    )


def score_candidates(
    candidates: DataFrame,
    corpus: DataFrame,
    seeds: DataFrame,
    key: str = "session_id",
    similarity_threshold: float = 0.1,
) -> DataFrame:
    """Candidates with their score components and score; those under the similarity threshold are dropped."""
    full = _with_all_sources(candidates)
    similar = similarity(full, corpus, seeds, key)
    total = sum((_frequency(s) for s in SOURCE_WEIGHTS), F.lit(0))
    sources = sum((F.when(_frequency(s) > 0, 1).otherwise(0) for s in SOURCE_WEIGHTS), F.lit(0))
    weighted = sum((_frequency(s) * w for s, w in SOURCE_WEIGHTS.items()), F.lit(0.0))
    scored = full.join(similar, [key, "term"], "left").withColumns(
        {
            "total_frequency": total.cast("bigint"),
            "frequency_score": F.least(total / 10.0, F.lit(1.0)),
            "diversity_score": sources / float(len(SOURCE_WEIGHTS)),
            "position_score": F.coalesce(F.try_divide(weighted, total), F.lit(0.0)) / max(SOURCE_WEIGHTS.values()),
            "similarity": F.coalesce("similarity", F.lit(0.0)),
            "tfidf_bonus": F.least(F.coalesce(F.col("tfidf"), F.lit(0.0)) / 10.0, F.lit(0.5)),
        }
    )
    score = (
        0.25 * F.col("frequency_score") + 0.20 * F.col("diversity_score") + 0.25 * F.col("position_score")
        + 0.20 * F.col("similarity") + 0.10 * F.col("tfidf_bonus")
    )
    return scored.withColumn("score", score).filter(F.col("similarity") >= similarity_threshold)


def best_candidates(scored: DataFrame, key: str = "session_id", n: int = 100) -> DataFrame:
    return top_n(scored, [key], [F.desc(F.round("score", 9)), F.col("term")], n, "position")


def scored_results(
    results: DataFrame, seeds: DataFrame, key: str = "session_id", min_frequency: int = 2,
    similarity_threshold: float = 0.1,
) -> DataFrame:
    """All scored candidates of the results. The term table is small and read five times, so it is written once."""
    terms = materialize(result_terms(results, key))
    candidates = terms.filter(F.col("f_title") + F.col("f_description") + F.col("f_url") >= min_frequency)
    corpus = terms.select(key, F.col("term").alias("text"), (F.col("f_title") + F.col("f_description")).alias("n")).filter(
        F.col("n") > 0
    )
    return score_candidates(candidates, corpus, seeds, key, similarity_threshold)


def expand_from_results(
    results: DataFrame, seeds: DataFrame, key: str = "session_id", min_frequency: int = 2,
    max_candidates: int = 100, similarity_threshold: float = 0.1,
) -> DataFrame:
    scored = scored_results(results, seeds, key, min_frequency, similarity_threshold)
    return best_candidates(scored, key, max_candidates)


def expand_from_content(
    nouns: DataFrame, mentions: DataFrame, seeds: DataFrame, key: str = "session_id", n: int = 50,
    max_candidates: int = 100, similarity_threshold: float = 0.1,
) -> DataFrame:
    candidates = content_candidates(nouns, mentions, key, n)
    scored = score_candidates(candidates, noun_corpus(nouns, mentions, key, n), seeds, key, similarity_threshold)
    return best_candidates(scored, key, max_candidates)


def expand_from_suggestions(
    suggestions: DataFrame, seeds: DataFrame, key: str = "lang", similarity_threshold: float = 0.1
) -> DataFrame:
    """Every occurrence of a new term in a suggestion with the score of the term."""
    occurrences = suggestion_terms(suggestions, seeds, key)
    candidates = occurrences.groupBy(key, "term").agg(F.count(F.lit(1)).alias("copies")).withColumn(
        "f_suggestion", F.lit(1).cast("bigint")
    )
    corpus = suggestions.groupBy(key, "text").agg(F.count(F.lit(1)).alias("n"))
    scored = score_candidates(candidates, corpus, seeds, key, similarity_threshold)
    return occurrences.join(scored.select(key, "term", "similarity", "score"), [key, "term"])


def filter_candidates(
    candidates: DataFrame, seeds: DataFrame, key: str = "session_id", min_score: float = 0.1,
    exclude: Sequence[str] = (),
) -> DataFrame:
    """Candidates of quality: score, length 3 to 50, not a number, not excluded, not a term of the seed."""
    term = F.lower("term")
    kept = candidates.filter(
        (F.col("score") >= min_score) & F.length("term").between(3, 50) & ~F.col("term").rlike(r"^\p{Nd}+$")
    )
    if exclude:
        kept = kept.filter(~term.isin(*[x.lower() for x in exclude]))
    known = seeds.select(key, F.explode(meaningful_terms("seed")).alias("seed_term")).distinct()
    return (
        kept.withColumn("seed_term", term).join(known, [key, "seed_term"], "left_anti").drop("seed_term")
    )


def expansion_job(
    from_results: DataFrame | None, from_content: DataFrame | None, seeds: DataFrame, key: str = "session_id",
    min_score: float = 0.1, max_candidates: int = 100, generation: int = 1,
) -> DataFrame:
    """Candidates of both sources that pass the filter, the best of each key, as rows to store."""
    parts = []
    for source, df in (("search_results", from_results), ("content", from_content)):
        if df is not None:
            parts.append(df.select(key, "term", "score", F.lit(source).alias("source")))
    every = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    kept = filter_candidates(every, seeds, key, min_score)
    best = top_n(
        kept, [key], [F.desc(F.round("score", 9)), F.col("term"), F.col("source")], max_candidates, "position"
    )
    return best.withColumns(
        {"generation": F.lit(generation).cast("bigint"), "approved": F.lit(None).cast("boolean")}
    )


def decide(candidates: DataFrame, decisions: DataFrame, keys: Sequence[str] = ("session_id", "term")) -> DataFrame:
    """Candidates with ``approved`` set where ``decisions`` (keys, approved) has a row."""
    new = decisions.select(*keys, F.col("approved").alias("__new"))
    return (
        candidates.join(new, list(keys), "left")
        .withColumn("approved", F.coalesce("__new", "approved"))
        .drop("__new")
    )


def next_generation(candidates: DataFrame, key: str = "session_id") -> DataFrame:
    """Approved candidates as the queries of the following generation."""
    approved = candidates.filter(F.col("approved"))
    return approved.select(
        key, F.col("term").alias("query_text"), (F.col("generation") + 1).alias("generation")
    ).distinct()
