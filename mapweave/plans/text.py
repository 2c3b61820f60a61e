"""Text analytics queries: tokens, term weights, keywords, entities and their aggregates."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapweave.functions import text as tx
from mapweave.functions.skew import top_n
from mapweave.operators import aggregates, annotate, entities, keywords, tfidf
from mapweave.operators.networks import build
from mapweave.plans.registry import register
from mapweave.plans.roles import STOP_SQL, content_words_sql, with_roles

# A rule annotator for documents in invented languages: tag from the ending of the word.
_NOUN_ENDINGS = ("tion", "ment", "heit", "keit", "ung", "er")
_ADJ_ENDINGS = ("lich", "eux", "ble")


def suffix_tag(word):
    def ends(endings):
        return word.rlike("(" + "|".join(endings) + ")$")

    return F.when(ends(_NOUN_ENDINGS), "NOUN").when(ends(_ADJ_ENDINGS), "ADJ").otherwise("VERB")


_TAG_SQL = f"""CASE WHEN regexp_matches(lemma, '({"|".join(_NOUN_ENDINGS)})$') THEN 'NOUN'
                    WHEN regexp_matches(lemma, '({"|".join(_ADJ_ENDINGS)})$') THEN 'ADJ' ELSE 'VERB' END"""

_TOKENS_SQL = rf"""SELECT doc_id, pos_idx, token, lemma, {_TAG_SQL} AS upos, lemma IN ({STOP_SQL['en']}) AS is_stop,
    CAST(sum(length(gap) + length(token)) OVER (PARTITION BY doc_id ORDER BY pos_idx) - length(token) AS BIGINT) AS char_pos
  FROM (SELECT doc_id, i - 1 AS pos_idx, gaps[i] AS gap, tokens[i] AS token, lower(tokens[i]) AS lemma
        FROM (SELECT doc_id, tokens, gaps, unnest(generate_series(1, len(tokens))) AS i
              FROM (SELECT doc_id, regexp_extract_all(text, '[\p{{L}}\p{{N}}]+') AS tokens,
                           string_split_regex(text, '[\p{{L}}\p{{N}}]+') AS gaps FROM documents)))"""


def _tokens(t):
    return keywords.tokens(t.documents, language_col="lang", upos=suffix_tag)


def _corpus_size(t):
    return t.documents.agg(F.count(F.lit(1)).alias("N"))


@register(
    "g1_tokens",
    with_roles(
        tokens=_TOKENS_SQL,
        body="""SELECT doc_id, pos_idx, char_pos, token, lemma, upos, is_stop, length(token) >= 2 AS long_enough
                FROM tokens""",
    ),
)
def g1(t):
    return _tokens(t).select(
        "doc_id", "pos_idx", "char_pos", "token", "lemma", "upos", "is_stop",
        (F.length("token") >= 2).alias("long_enough"),
    )


def _ending_tag(word: str, language: str | None) -> str:
    return "NOUN" if word.endswith(_NOUN_ENDINGS) else "ADJ" if word.endswith(_ADJ_ENDINGS) else "VERB"


@register(
    "g1b_annotate_function",
    with_roles(tokens=_TOKENS_SQL, body="SELECT doc_id, pos_idx, char_pos, token, lemma, upos, is_stop FROM tokens"),
)
def g1b(t):
    """The same tokens by a tagger that SQL calls as a table function."""
    annotate.register_annotator(t.spark, _ending_tag)
    call = "SELECT * FROM annotate(TABLE({texts}), 'doc_id', 'text', 'lang')"
    return t.spark.sql(call, texts=t.documents.select("doc_id", "text", "lang").repartition("doc_id")).drop("is_punct")


def _grams_sql(n: int) -> str:
    parts = ", ".join(f"list_slice(terms, {k}, greatest(len(terms) - {n - k}, 0))" for k in range(1, n + 1))
    joined = " || ' ' || ".join(f"x[{k}]" for k in range(1, n + 1))
    return f"list_transform(list_zip({parts}), lambda x: {joined})"


_BIGRAM_SQL, _TRIGRAM_SQL = _grams_sql(2), _grams_sql(3)


@register(
    "g2_ngrams",
    with_roles(
        "doc_terms",
        body=f"""SELECT doc_id, size, gram, count(*) AS n FROM (
                   SELECT doc_id, CAST(2 AS BIGINT) AS size, unnest({_BIGRAM_SQL}) AS gram FROM doc_terms
                   UNION ALL SELECT doc_id, 3, unnest({_TRIGRAM_SQL}) FROM doc_terms) GROUP BY ALL""",
    ),
)
def g2(t):
    both = F.array(
        F.struct(F.lit(2).cast("bigint").alias("size"), tx.ngrams("terms", 2).alias("grams")),
        F.struct(F.lit(3).cast("bigint").alias("size"), tx.ngrams("terms", 3).alias("grams")),
    )
    return (
        t.doc_terms.select("doc_id", F.inline(both))
        .select("doc_id", "size", F.explode("grams").alias("gram"))
        .groupBy("doc_id", "size", "gram")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@register(
    "g3_term_frequency",
    with_roles("doc_tfidf", body="SELECT doc_id, term, n, round(n / n_terms, 6) AS tf FROM doc_tfidf"),
)
def g3(t):
    counts = tfidf.term_counts(t.documents, "doc_id", tx.content_words("text"))
    return counts.select("doc_id", "term", "n", F.round(F.col("n") / F.col("n_terms"), 6).alias("tf"))


@register(
    "g4_idf",
    with_roles(
        "doc_tfidf",
        body="""SELECT term, df, round(ln(((SELECT count(*) FROM documents) + 1.0) / (df + 1.0)) + 1.0, 6) AS idf
                FROM (SELECT DISTINCT term, df FROM doc_tfidf)""",
    ),
)
def g4(t):
    per_document = t.doc_terms.select("doc_id", F.explode(F.array_distinct("terms")).alias("term"))
    spread = per_document.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    total = _corpus_size(t).scalar()
    return spread.select(
        "term", "df", F.round(tfidf.inverse_document_frequency(total, F.col("df")), 6).alias("idf")
    )


@register(
    "g5_weighted_tfidf",
    with_roles(
        "doc_tfidf",
        body="""SELECT doc_id, term, round((n / n_terms) * pow(ln(((SELECT count(*) FROM documents) + 1.0) / (df + 1.0))
                 + 1.0, 1.5), 6) AS score FROM doc_tfidf""",
    ),
)
def g5(t):
    scored = tfidf.tfidf(t.documents, "doc_id", tx.content_words("text"), idf_weight=1.5, cut=tfidf.content_cut("text"))
    return scored.select("doc_id", "term", F.round("tfidf", 6).alias("score"))


_BIGRAM_TFIDF_SQL = f"""SELECT c.doc_id, c.term, c.n, c.n_terms, d.df,
        (c.n / c.n_terms) * (ln(((SELECT count(*) FROM documents) + 1.0) / (d.df + 1.0)) + 1.0) AS tfidf
      FROM (SELECT doc_id, term, n_terms, count(*) AS n FROM bi GROUP BY ALL) c
      JOIN (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, term FROM bi) GROUP BY term) d ON c.term = d.term"""
_BI_SQL = f"""SELECT doc_id, len(every) AS n_terms, unnest(every) AS term
              FROM (SELECT doc_id, list_concat(terms, {_BIGRAM_SQL}) AS every FROM doc_terms)"""


@register(
    "g6_corpus_tfidf",
    with_roles(
        "doc_terms", bi=_BI_SQL, scored=_BIGRAM_TFIDF_SQL,
        body="SELECT doc_id, term, n, n_terms, df, round(tfidf, 6) AS score FROM scored",
    ),
)
def g6(t):
    terms = tfidf.with_bigrams(tx.content_words("text"))
    scored = tfidf.tfidf(t.documents, "doc_id", terms, cut=tfidf.content_cut("text", bigrams=True))
    # scores are positive: half up by doubles, as the SQL engine rounds; F.round takes a decimal number for each of the many rows
    score = F.floor(F.col("tfidf") * 1e6 + 0.5) / 1e6
    return scored.select("doc_id", "term", "n", "n_terms", "df", score.alias("score"))


@register(
    "g7_top_terms",
    with_roles(
        "doc_tfidf",
        body="""SELECT doc_id, term, round(tfidf, 6) AS score, position FROM (
                  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tfidf DESC, term) AS position
                  FROM doc_tfidf) WHERE position <= 10""",
    ),
)
def g7(t):
    return tfidf.top_terms(t.doc_tfidf, "doc_id", 10).select(
        "doc_id", "term", F.round("tfidf", 6).alias("score"), "position"
    )


def _pos_sql(tags: str, limit: int) -> str:
    return with_roles(
        tokens=_TOKENS_SQL,
        chosen=f"SELECT * FROM tokens WHERE upos IN ({tags}) AND NOT is_stop",
        spell="""SELECT doc_id, lemma, token, count(*) AS n, min(char_pos) AS fp FROM chosen GROUP BY ALL""",
        words="""SELECT doc_id, lemma, token AS word FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, lemma
                   ORDER BY n DESC, fp) AS rn FROM spell) WHERE rn = 1""",
        lem="""SELECT doc_id, lemma, count(*) AS frequency, arg_min(upos, char_pos) AS pos_tag,
                 array_to_string(list_slice(list_sort(list(char_pos)), 1, 100), ',') AS positions
               FROM chosen GROUP BY ALL""",
        dfs="SELECT lemma, count(*) AS df FROM lem GROUP BY lemma",
        lens="SELECT doc_id, sum(frequency) AS n_terms FROM lem GROUP BY doc_id",
        scored="""SELECT doc_id, lemma, word, pos_tag, positions, frequency,
                    (frequency / n_terms) * (ln(((SELECT count(*) FROM documents) + 1.0) / (df + 1.0)) + 1.0) AS s
                  FROM lem JOIN dfs USING (lemma) JOIN lens USING (doc_id) JOIN words USING (doc_id, lemma)
                  WHERE length(lemma) >= 2 AND frequency >= 2""",
        body=f"""SELECT doc_id, lemma, word, pos_tag, positions, frequency, round(s, 6) AS score, position
                 FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, lemma) AS position FROM scored)
                 WHERE position <= {limit}""",
    )


def _pos_columns(found):
    return found.select(
        "doc_id", "lemma", "word", "pos_tag", F.array_join("positions", ",").alias("positions"), "frequency",
        F.round("tfidf_score", 6).alias("score"), "position",
    )


@register("g8_noun_keywords", _pos_sql("'NOUN'", 30))
def g8(t):
    return _pos_columns(keywords.pos_keywords(_tokens(t), ("NOUN",), max_keywords=30, corpus_size=_corpus_size(t)))


@register("g9_pos_keywords", _pos_sql("'NOUN', 'ADJ'", 40))
def g9(t):
    return _pos_columns(
        keywords.pos_keywords(_tokens(t), ("NOUN", "ADJ"), max_keywords=40, corpus_size=_corpus_size(t))
    )


@register(
    "g10_tfidf_keywords",
    with_roles(
        "doc_terms", bi=_BI_SQL, scored=_BIGRAM_TFIDF_SQL,
        body="""SELECT doc_id, term AS lemma, CASE WHEN contains(term, ' ') THEN 1 ELSE n END AS frequency,
                  CAST(CASE WHEN contains(term, ' ') THEN 2 ELSE 1 END AS BIGINT) AS phrase_length,
                  round(tfidf, 6) AS score, position
                FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tfidf DESC, term) AS position FROM scored)
                WHERE position <= 25""",
    ),
)
def g10(t):
    found = keywords.tfidf_keywords(t.documents, bigrams=True, max_keywords=25)
    return found.select(
        "doc_id", "lemma", "frequency", "phrase_length", F.round("tfidf_score", 6).alias("score"), "position"
    )


_RAKE_SQL = rf"""SELECT doc_id, unnest(list_distinct(list_filter(list_transform(string_split(array_to_string(
      list_transform(string_split_regex(regexp_replace(lower(text), '([^\p{{L}}\p{{N}}\s]+)', ' | ', 'g'), '\s+'),
        lambda w: CASE WHEN w IN ({STOP_SQL['en']}) THEN '|' ELSE w END), ' '), '|'), lambda r: trim(r)),
      lambda r: r <> '' AND len(string_split(r, ' ')) <= 3))) AS phrase FROM documents"""


def _rake_ctes():
    return {
        "phrases": _RAKE_SQL,
        "pw": """SELECT doc_id, phrase, len(string_split(phrase, ' ')) AS ln, unnest(string_split(phrase, ' ')) AS w
                 FROM phrases""",
        "ws": "SELECT doc_id, w, sum(ln) / count(*) AS ratio FROM pw GROUP BY ALL",
        "rake": """SELECT doc_id, phrase, CAST(ln AS BIGINT) AS word_count, round(sum(ratio), 6) AS score
                   FROM pw JOIN ws USING (doc_id, w) GROUP BY ALL""",
    }


@register(
    "g11_rake",
    with_roles(
        **_rake_ctes(),
        body="""SELECT doc_id, phrase, word_count, score, position FROM (SELECT *, row_number() OVER (PARTITION BY doc_id
                  ORDER BY score DESC, phrase DESC) AS position FROM rake WHERE score >= 1) WHERE position <= 50""",
    ),
)
def g11(t):
    return keywords.rake_keywords(t.documents)


def _tagged_sql(tags: str, kind: str) -> dict:
    """Keywords of parts of speech, ranked, as common table expressions with names of their own."""
    return {
        f"{kind}_lem": f"SELECT doc_id, lemma, count(*) AS frequency FROM tokens WHERE upos IN ({tags}) AND NOT is_stop GROUP BY ALL",
        f"{kind}_all": f"""SELECT doc_id, lemma AS keyword, frequency / n_terms * (ln(((SELECT count(DISTINCT doc_id) FROM tokens) + 1.0)
                 / (df + 1.0)) + 1.0) AS score FROM {kind}_lem JOIN (SELECT lemma, count(*) AS df FROM {kind}_lem GROUP BY lemma) USING (lemma)
               JOIN (SELECT doc_id, sum(frequency) AS n_terms FROM {kind}_lem GROUP BY doc_id) USING (doc_id)
               WHERE length(lemma) >= 2 AND frequency >= 2""",
    }


def _ranked_sql(kind: str) -> str:
    return f"""SELECT doc_id, keyword, round(score, 6) AS score, '{kind}' AS extraction_method,
        row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, keyword) AS position FROM {kind}_all"""


@register(
    "g12_keyword_methods",
    with_roles(
        "doc_tfidf", tokens=_TOKENS_SQL, **_rake_ctes(), **_tagged_sql("'NOUN'", "noun"), **_tagged_sql("'NOUN', 'VERB', 'ADJ'", "all_pos"),
        body=f"""SELECT * FROM ({_ranked_sql("noun")} UNION ALL {_ranked_sql("all_pos")} UNION ALL
                  SELECT doc_id, term AS keyword, round(tfidf, 6) AS score, 'tfidf' AS extraction_method,
                    row_number() OVER (PARTITION BY doc_id ORDER BY tfidf DESC, term) AS position FROM doc_tfidf
                  UNION ALL
                  SELECT doc_id, phrase, score, 'rake',
                    row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, phrase DESC) FROM rake WHERE score >= 1)
                WHERE position <= 5""",
    ),
)
def g12(t):
    tagged = _tokens(t)
    found = [keywords.extract_keywords(t.documents, m, tagged, max_keywords=5) for m in keywords.METHODS]
    return reduce(DataFrame.unionByName, found).withColumn("score", F.round("score", 6))


@register(
    "g13_corpus_variants",
    with_roles(
        "doc_tfidf",
        copies="SELECT doc_id, count(*) OVER (PARTITION BY text) AS m FROM documents",
        body="""SELECT doc_id, term, df - (m - 1) AS own_df,
                  round((n / n_terms) * (ln(((SELECT count(*) FROM documents) - (m - 1) + 1.0) / (df - (m - 1) + 1.0)) + 1.0),
                        6) AS score_unique,
                  round(n / n_terms, 6) AS score_alone
                FROM doc_tfidf JOIN copies USING (doc_id)""",
    ),
)
def g13(t):
    scored = tfidf.tfidf(
        t.documents, "doc_id", tx.content_words("text"), corpus="unique", text_col="text", cut=tfidf.content_cut("text")
    )
    return scored.select(
        "doc_id", "term", F.col("df").alias("own_df"), F.round("tfidf", 6).alias("score_unique"),
        F.round(F.col("n") / F.col("n_terms"), 6).alias("score_alone"),
    )


_LABELS = ("CLICK", "PURCHASE", "SIGNUP", "VIEW")
_LABELS_SQL = ", ".join(f"'{x}'" for x in _LABELS)


@register(
    "g14_unique_entities",
    with_roles(
        "mentions",
        body=f"""SELECT content_id, label, arg_min(trim(text), start_pos) AS text, min(start_pos) AS start_pos
                 FROM mentions WHERE label IN ({_LABELS_SQL}) AND length(trim(text)) >= 2
                 GROUP BY content_id, lower(trim(text)), label""",
    ),
)
def g14(t):
    return entities.unique_entities(t.mentions, _LABELS).drop("key")


@register(
    "g15_entity_counts",
    with_roles(
        "mentions",
        body="SELECT content_id, label, trim(text) AS text, count(*) AS n_mentions FROM mentions GROUP BY ALL",
    ),
)
def g15(t):
    return entities.entity_counts(t.mentions)


@register(
    "g16_entity_groups",
    with_roles(
        "mentions",
        body="""SELECT label, text, count(*) AS n_mentions, count(DISTINCT content_id) AS n_contents
                FROM mentions WHERE label IN ('CLICK', 'VIEW') GROUP BY label, text""",
    ),
)
def g16(t):
    return entities.label_groups(t.mentions, ("CLICK", "VIEW"))


_MENTION_AGG_SQL = """SELECT content_id, lower(trim(text)) AS key, count(*) AS frequency,
      max(coalesce(confidence, 1.0)) AS confidence, arg_min(trim(text), start_pos) AS text,
      arg_min(label, start_pos) AS label, min(start_pos) AS start_pos
    FROM mentions WHERE coalesce(confidence, 1.0) >= {t} AND trim(text) <> '' GROUP BY 1, 2"""


@register(
    "g17_mention_aggregation",
    with_roles(
        "mentions", agg=_MENTION_AGG_SQL.format(t=0.1),
        body="""SELECT content_id, text, label, frequency, round(confidence, 6) AS confidence, start_pos, position
                FROM (SELECT *, row_number() OVER (PARTITION BY content_id ORDER BY confidence DESC, key) AS position
                      FROM agg) WHERE position <= 20""",
    ),
)
def g17(t):
    found = entities.aggregate_mentions(t.mentions, 0.1, max_entities=20)
    return found.withColumn("confidence", F.round("confidence", 6)).drop("key")


_JOB_KEYWORDS_SQL = """SELECT job_id, lemma, min(word) AS word, CAST(sum(frequency) AS BIGINT) AS total_frequency,
      avg(tfidf_score) AS avg_tfidf, count(DISTINCT content_id) AS n_contents
    FROM extracted_keywords JOIN website_content USING (content_id) GROUP BY job_id, lemma"""


@register(
    "g18_job_keywords",
    with_roles(
        "extracted_keywords", "website_content", agg=_JOB_KEYWORDS_SQL,
        body="""SELECT job_id, lemma, word, total_frequency, round(avg_tfidf, 6) AS avg_tfidf, n_contents FROM (
                  SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY total_frequency DESC, lemma) AS rn FROM agg)
                WHERE rn <= 50""",
    ),
)
def g18(t):
    found = aggregates.job_keywords(t.extracted_keywords, t.website_content, 50)
    return found.withColumn("avg_tfidf", F.round("avg_tfidf", 6))


_JOB_ENTITIES_SQL = """SELECT job_id, m.text, label, count(*) AS n_rows, count(DISTINCT content_id) AS n_contents
    FROM mentions m JOIN website_content USING (content_id) GROUP BY job_id, m.text, label"""


@register(
    "g19_job_entities",
    with_roles(
        "mentions", "website_content", agg=_JOB_ENTITIES_SQL,
        body="""SELECT job_id, text, label, n_rows, n_contents FROM (
                  SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY n_rows DESC, text, label) AS rn FROM agg)
                WHERE rn <= 50""",
    ),
)
def g19(t):
    return aggregates.job_entities(t.mentions, t.website_content, 50)


_LABEL_COUNTS_SQL = """SELECT job_id, label, count(*) AS n_entities
    FROM mentions JOIN website_content USING (content_id) GROUP BY job_id, label"""
_STATUS_SQL = """SELECT job_id, count(*) AS n_contents,
      CAST(sum(CASE WHEN a.status = 'completed' THEN 1 ELSE 0 END) AS BIGINT) AS n_analyzed,
      CAST(sum(CASE WHEN a.status = 'failed' THEN 1 ELSE 0 END) AS BIGINT) AS n_failed
    FROM website_content c LEFT JOIN content_analysis a ON c.content_id = a.content_id GROUP BY job_id"""


@register(
    "g20_entity_label_counts",
    with_roles(
        "mentions", "website_content", "content_analysis", labels_n=_LABEL_COUNTS_SQL, stat=_STATUS_SQL,
        body="SELECT job_id, label, n_entities, n_contents, n_analyzed, n_failed FROM labels_n JOIN stat USING (job_id)",
    ),
)
def g20(t):
    counts = aggregates.label_counts(t.mentions, t.website_content)
    return counts.join(aggregates.analysis_statistics(t.website_content, t.content_analysis), "job_id")


@register(
    "g21_session_keywords",
    with_roles(
        "extracted_keywords", "website_content", "scraping_jobs",
        agg="""SELECT session_id, lemma, CAST(sum(frequency) AS BIGINT) AS total_frequency, avg(tfidf_score) AS avg_tfidf,
                 count(*) AS n_rows
               FROM extracted_keywords JOIN website_content USING (content_id) JOIN scraping_jobs USING (job_id)
               GROUP BY session_id, lemma""",
        body="""SELECT session_id, lemma, total_frequency, round(avg_tfidf, 6) AS avg_tfidf, n_rows FROM (
                  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY total_frequency DESC, lemma) AS rn FROM agg)
                WHERE rn <= 30""",
    ),
)
def g21(t):
    found = aggregates.session_keywords(t.extracted_keywords, t.website_content, t.scraping_jobs, 30)
    return found.withColumn("avg_tfidf", F.round("avg_tfidf", 6))


@register(
    "g22_domain_tfidf",
    with_roles(
        nouns=rf"""SELECT source AS domain, w FROM (SELECT source, unnest(regexp_extract_all(lower(text),
                     '[\p{{L}}\p{{N}}]+')) AS w FROM documents)
                   WHERE length(w) > 2 AND regexp_full_match(w, '\p{{L}}+') AND w NOT IN ({STOP_SQL['en']})
                     AND regexp_matches(w, '({"|".join(_NOUN_ENDINGS)})$')""",
        counts="SELECT domain, w AS term, count(*) AS n FROM nouns GROUP BY ALL",
        vocab="""SELECT term, count(*) AS df, sum(n) AS cf FROM counts GROUP BY term
                 ORDER BY cf DESC, term LIMIT 1000""",
        raw="""SELECT domain, term, n * (ln(((SELECT count(DISTINCT source) FROM documents) + 1.0) / (df + 1.0)) + 1.0) AS w
               FROM counts JOIN vocab USING (term)""",
        scored="SELECT domain, term, w / sqrt(sum(w * w) OVER (PARTITION BY domain)) AS weight FROM raw",
        body="""SELECT domain, term, round(weight, 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY domain
                  ORDER BY round(weight, 9) DESC, term) AS rn, count(*) OVER (PARTITION BY domain) AS k FROM scored)
                WHERE rn <= greatest(1, floor(k * 0.1))""",
    ),
)
def g22(t):
    nouns = _tokens(t).filter((F.col("upos") == "NOUN") & ~F.col("is_stop"))
    owners = t.documents.select("doc_id", F.col("source").alias("domain"))
    return build.domain_noun_edges(nouns.join(owners, "doc_id"), top=0.1).withColumn("weight", F.round("weight", 6))


@register(
    "g23_content_listing",
    with_roles(
        "extracted_keywords", "mentions",
        body="""SELECT content_id, kind, item, position FROM (
                  SELECT content_id, 'keyword' AS kind, lemma AS item,
                    row_number() OVER (PARTITION BY content_id ORDER BY tfidf_score DESC, lemma) AS position
                  FROM extracted_keywords
                  UNION ALL
                  SELECT content_id, 'entity', text,
                    row_number() OVER (PARTITION BY content_id ORDER BY start_pos, label) FROM mentions
                  WHERE label = 'CLICK') WHERE position <= 10""",
    ),
)
def g23(t):
    best = top_n(t.extracted_keywords, ["content_id"], [F.desc("tfidf_score"), F.col("lemma")], 10, "position").select(
        "content_id", F.lit("keyword").alias("kind"), F.col("lemma").alias("item"), "position"
    )
    clicks = entities.entities_of_labels(t.mentions, ["CLICK"])
    first = top_n(clicks, ["content_id"], [F.col("start_pos"), F.col("label")], 10, "position").select(
        "content_id", F.lit("entity").alias("kind"), F.col("text").alias("item"), "position"
    )
    return best.unionByName(first)


@register(
    "g24_replace_results",
    with_roles(
        "extracted_keywords", **_rake_ctes(),
        fresh="""SELECT doc_id AS content_id, phrase AS lemma, score, 'rake' AS extraction_method FROM (
                   SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, phrase DESC) AS rn
                   FROM rake WHERE score >= 1) JOIN documents USING (doc_id) WHERE rn <= 5 AND lang = 'en'""",
        body="""SELECT content_id, lemma, round(tfidf_score, 6) AS score, extraction_method FROM extracted_keywords
                WHERE content_id NOT IN (SELECT content_id FROM fresh) UNION ALL SELECT * FROM fresh""",
    ),
)
def g24(t):
    existing = t.extracted_keywords.select(
        "content_id", "lemma", F.round("tfidf_score", 6).alias("score"), "extraction_method"
    )
    redone = keywords.rake_keywords(t.documents.filter(F.col("lang") == "en"), max_keywords=5)
    fresh = redone.select(
        F.col("doc_id").alias("content_id"), F.col("phrase").alias("lemma"), "score",
        F.lit("rake").alias("extraction_method"),
    )
    return aggregates.replace_results(existing, fresh)


@register(
    "g25_job_report",
    with_roles(
        "extracted_keywords", "mentions", "website_content", "content_analysis",
        kw=_JOB_KEYWORDS_SQL, en=_JOB_ENTITIES_SQL, labels_n=_LABEL_COUNTS_SQL, stat=_STATUS_SQL,
        body="""SELECT job_id, 'keyword' AS section, lemma AS item, total_frequency AS value FROM (SELECT *,
                  row_number() OVER (PARTITION BY job_id ORDER BY total_frequency DESC, lemma) AS rn FROM kw) WHERE rn <= 10
                UNION ALL
                SELECT job_id, 'entity', text || '|' || label, n_rows FROM (SELECT *, row_number() OVER (PARTITION BY job_id
                  ORDER BY n_rows DESC, text, label) AS rn FROM en) WHERE rn <= 10
                UNION ALL SELECT job_id, 'label', label, n_entities FROM labels_n
                UNION ALL SELECT job_id, 'status', 'contents', n_contents FROM stat
                UNION ALL SELECT job_id, 'status', 'analyzed', n_analyzed FROM stat
                UNION ALL SELECT job_id, 'status', 'failed', n_failed FROM stat""",
    ),
)
def g25(t):
    return aggregates.job_report(t.extracted_keywords, t.mentions, t.website_content, t.content_analysis, 10)
