"""Column expressions on text: tokens, n-grams, terms, statistics."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from mapweave.functions import words

SEPARATORS = r"[^\p{L}\p{N}]+"
WORD = r"[\p{L}\p{N}]+"


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def word_array(text) -> Column:
    """Runs of letters and digits of the whole text, in order, as written."""
    return F.filter(F.split(_col(text), SEPARATORS), lambda w: w != "")


def is_stop(word: Column, language: Column | None = None, stop_words: Mapping[str, Sequence[str]] | None = None) -> Column:
    """Lower-case word is in the stop list of its language; other languages use the English list."""
    lists = stop_words or words.STOP_WORDS
    default = word.isin(*lists["en"])
    if language is None:
        return default
    test = None
    for code in lists:
        if code != "en":
            branch = word.isin(*lists[code])
            test = F.when(language == code, branch) if test is None else test.when(language == code, branch)
    return default if test is None else test.otherwise(default)


def content_words(text, language=None, min_length: int = 2, stop_words=None) -> Column:
    """Lower-case words of ``min_length`` characters or more that are not stop words."""
    lang = _col(language) if language is not None else None
    return F.filter(
        word_array(F.lower(_col(text))),
        lambda w: (F.length(w) >= min_length) & ~is_stop(w, lang, stop_words),
    )


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` applied to ``value``, which is computed once per row however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def ngrams(tokens, n: int) -> Column:
    """Space-joined n-grams; an empty array for n < 2 or a document shorter than n."""
    empty = F.array().cast("array<string>")
    if n < 2:
        return empty

    def grams(ts: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(ts) - n + 1)
        found = F.transform(starts, lambda i: F.array_join(F.slice(ts, i, n), " "))
        return F.when(F.size(ts) >= n, found).otherwise(empty)

    return let(_col(tokens), grams)


def meaningful_terms(text) -> Column:
    """Terms of a title or snippet: a-z, 0-9 and '-', three characters or more, no stop words."""
    clean = F.regexp_replace(F.lower(_col(text)), r"[^a-z0-9\s\-]", " ")
    return F.filter(
        F.split(clean, r"\s+"), lambda w: (F.length(w) >= 3) & ~w.isin(*words.TERM_STOP_WORDS)
    )


def word_count(text) -> Column:
    return F.regexp_count(F.coalesce(_col(text), F.lit("")), F.lit(r"\S+")).cast("bigint")


def line_count(text) -> Column:
    """Lines as a text editor counts them: a trailing line break opens no new line."""
    body = F.regexp_replace(F.coalesce(_col(text), F.lit("")), r"\r\n|\r", "\n")
    lines = F.size(F.split(F.regexp_replace(body, r"\n$", ""), "\n"))
    return F.when(body == "", 0).otherwise(lines).cast("bigint")


def detect_language(text, markers: Mapping[str, Sequence[str]] | None = None) -> Column:
    """Language whose marker words hit most often in the text; null under 50 characters or without a hit.

    Ties go to the alphabetically first code. A stop-word vote replaces a statistical model.
    """
    lists = markers or words.LANGUAGE_MARKERS
    tokens = F.split(F.lower(_col(text)), SEPARATORS)

    def vote(ws: Column, code: str) -> Column:
        hits = F.size(F.filter(ws, lambda w: w.isin(*lists[code])))
        return F.struct((-hits).alias("hits"), F.lit(code).alias("code"))

    best = let(tokens, lambda ws: F.array_min(F.array(*[vote(ws, code) for code in sorted(lists)])))
    return F.when((F.length(F.trim(_col(text))) >= 50) & (best["hits"] < 0), best["code"])
