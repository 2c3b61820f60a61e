"""Query expansion queries."""

from pyspark.sql import functions as F

from mapweave.functions import text as tx
from mapweave.functions import words
from mapweave.operators import expansion as ops
from mapweave.plans import sqlkit as q
from mapweave.plans.registry import register
from mapweave.plans.roles import STOP_SQL, with_roles
from mapweave.session import materialize

_TERM_STOPS = q.quoted(words.TERM_STOP_WORDS)


def terms_sql(x: str) -> str:
    return (f"list_filter(string_split_regex(regexp_replace(lower({x}), '[^a-z0-9\\s\\-]', ' ', 'g'), '\\s+'), "
            f"lambda w: length(w) >= 3 AND w NOT IN ({_TERM_STOPS}))")


def url_terms_sql(x: str) -> str:
    return (f"list_transform(list_filter(string_split_regex(regexp_replace({q.path(x)}, '^/+|/+$', '', 'g'), '[/_-]'), "
            "lambda w: length(w) >= 3), lambda w: lower(w))")


def tokens_sql(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: w NOT IN ({STOP_SQL['en']}))"


@register(
    "f1_meaningful_terms",
    f"""SELECT conv_id, turn, term, count(*) AS n FROM (SELECT conv_id, turn, unnest({terms_sql('text')}) AS term
        FROM conversations) GROUP BY ALL""",
)
def f1(t):
    return (
        t.conversations.select("conv_id", "turn", F.explode(tx.meaningful_terms("text")).alias("term"))
        .groupBy("conv_id", "turn", "term")
        .agg(F.count(F.lit(1)).alias("n"))
    )


SEEDS_SQL = """SELECT session_id, min(title) || ' ' || max(split_part(description, ' ', -2)) || ' offer' AS seed
               FROM session_results GROUP BY session_id"""


def seeds(t):
    words_ = F.split("description", " ")
    found = t.session_results.groupBy("session_id").agg(
        F.concat_ws(" ", F.min("title"), F.max(F.element_at(words_, -2)), F.lit("offer")).alias("seed")
    )
    return materialize(found)


def _score_sql(key: str) -> dict:
    """Common table expressions from cands(key, term, f_*, tfidf, copies), corpus(key, text, n), seeds(key, seed)."""
    sources = list(ops.SOURCE_WEIGHTS.items())
    total = " + ".join(f"f_{s}" for s, _ in sources)
    n_sources = " + ".join(f"(CASE WHEN f_{s} > 0 THEN 1 ELSE 0 END)" for s, _ in sources)
    weighted = " + ".join(f"f_{s} * {w}" for s, w in sources)
    return {
        "docs": f"""SELECT {key}, term AS text, copies AS n FROM cands UNION ALL SELECT {key}, text, n FROM corpus
                    UNION ALL SELECT {key}, seed, 1 FROM seeds""",
        "ndocs": f"SELECT {key}, sum(n) AS nd FROM docs GROUP BY {key}",
        "occ": f"SELECT {key}, n, unnest({tokens_sql('text')}) AS token FROM docs",
        "spread": f"SELECT {key}, n, unnest(list_distinct({tokens_sql('text')})) AS token FROM docs",
        "vocab": f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY cf DESC, token) AS rn FROM
                     (SELECT {key}, token, sum(n) AS cf FROM occ GROUP BY ALL)
                     JOIN (SELECT {key}, token, sum(n) AS df FROM spread GROUP BY ALL) USING ({key}, token)) WHERE rn <= 1000""",
        "idf": f"SELECT {key}, token, ln((nd + 1.0) / (df + 1.0)) + 1.0 AS idf FROM vocab JOIN ndocs USING ({key})",
        "sv": f"""SELECT {key}, token, tf * idf AS w FROM (SELECT {key}, token, count(*) AS tf FROM
                  (SELECT {key}, unnest({tokens_sql('seed')}) AS token FROM seeds) GROUP BY ALL) JOIN idf USING ({key}, token)""",
        "cv": f"""SELECT {key}, term, token, tf * idf AS w FROM (SELECT {key}, term, token, count(*) AS tf FROM
                  (SELECT {key}, term, unnest({tokens_sql('term')}) AS token FROM cands) GROUP BY ALL)
                  JOIN idf USING ({key}, token)""",
        "sims": f"""SELECT cv.{key}, cv.term, sum(cv.w * coalesce(sv.w, 0.0)) / (sqrt(sum(cv.w * cv.w)) *
                      nullif(any_value(sn.norm), 0)) AS sim
                    FROM cv LEFT JOIN sv ON cv.{key} = sv.{key} AND cv.token = sv.token
                    LEFT JOIN (SELECT {key}, sqrt(sum(w * w)) AS norm FROM sv GROUP BY {key}) sn ON sn.{key} = cv.{key}
                    GROUP BY ALL""",
        "parts": f"""SELECT c.*, coalesce(sim, 0.0) AS similarity, least(({total}) / 10.0, 1.0)::DOUBLE AS frequency_score,
                       ({n_sources}) / 7.0::DOUBLE AS diversity_score,
                       (({weighted})::DOUBLE / ({total})) / 3.0 AS position_score,
                       least(coalesce(tfidf, 0.0) / 10.0, 0.5)::DOUBLE AS tfidf_bonus
                     FROM cands c LEFT JOIN sims s ON c.{key} = s.{key} AND c.term = s.term""",
        "scored": """SELECT *, 0.25::DOUBLE * frequency_score + 0.20::DOUBLE * diversity_score + 0.25::DOUBLE * position_score
                       + 0.20::DOUBLE * similarity + 0.10::DOUBLE * tfidf_bonus AS score FROM parts""",
    }


def _cands_sql(source: str, key: str, have: dict) -> str:
    cols = ", ".join(f"{have.get(s, '0')} AS f_{s}" for s in ops.SOURCE_WEIGHTS)
    return f"SELECT {key}, term, {cols}, {have.get('tfidf', 'NULL::DOUBLE')} AS tfidf, {have.get('copies', '1')} AS copies FROM {source}"


RESULT_SQL = {
    "rterms": f"""SELECT session_id, term, sum(CASE WHEN src = 'title' THEN 1 ELSE 0 END) AS ft,
                    sum(CASE WHEN src = 'description' THEN 1 ELSE 0 END) AS fd, sum(CASE WHEN src = 'url' THEN 1 ELSE 0 END) AS fu
                  FROM (SELECT session_id, 'title' AS src, unnest({terms_sql('title')}) AS term FROM session_results
                    UNION ALL SELECT session_id, 'description', unnest({terms_sql('description')}) FROM session_results
                    UNION ALL SELECT session_id, 'url', unnest({url_terms_sql('url')}) FROM session_results) GROUP BY ALL""",
    "rkept": "SELECT * FROM rterms WHERE ft + fd + fu >= 2",
    "cands": _cands_sql("rkept", "session_id", {"title": "ft", "description": "fd", "url": "fu"}),
    "corpus": "SELECT session_id, term AS text, ft + fd AS n FROM rterms WHERE ft + fd > 0",
    "seeds": SEEDS_SQL,
    **_score_sql("session_id"),
}
_POSITION = """SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY round(score, 9) DESC, term) AS position
               FROM scored"""


@register(
    "f2_result_candidates",
    with_roles(
        "session_results", **RESULT_SQL,
        body=f"""SELECT session_id, term, CAST(f_title AS BIGINT) AS f_title, CAST(f_description AS BIGINT) AS f_description,
                   CAST(f_url AS BIGINT) AS f_url, round(score, 6) AS score, position FROM ({_POSITION}) WHERE position <= 100""",
    ),
)
def f2(t):
    found = ops.expand_from_results(t.session_results, seeds(t), similarity_threshold=0.0)
    return found.select(
        "session_id", "term", "f_title", "f_description", "f_url", F.round("score", 6).alias("score"), "position"
    )


def session_nouns(t):
    pairs = t.website_content.select("content_id", "job_id").join(t.scraping_jobs.select("job_id", "session_id"), "job_id")
    return materialize(t.extracted_keywords.join(pairs.select("content_id", "session_id"), "content_id"))


def session_mentions(t):
    pairs = t.website_content.select("content_id", "job_id").join(t.scraping_jobs.select("job_id", "session_id"), "job_id")
    return t.mentions.join(pairs.select("content_id", "session_id"), "content_id")


CONTENT_SQL = {
    "sn": """SELECT k.*, session_id FROM extracted_keywords k JOIN website_content USING (content_id)
             JOIN scraping_jobs USING (job_id)""",
    "sm": """SELECT m.content_id, m.text, m.label, session_id FROM mentions m JOIN website_content USING (content_id)
             JOIN scraping_jobs USING (job_id)""",
    "bestn": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY tfidf_score DESC, lemma, content_id)
                AS rn FROM sn) WHERE rn <= 50""",
    "cn": """SELECT session_id, lower(lemma) AS term, arg_max(frequency, rn) AS fn, min(tfidf_score) AS tfidf FROM bestn
             WHERE length(lemma) >= 3 GROUP BY ALL""",
    "ce": """SELECT session_id, term, fe, labels FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY fe DESC, term)
               AS rn FROM (SELECT session_id, lower(text) AS term, count(*) AS fe,
                 array_to_string(list_sort(list(DISTINCT label)), ',') AS labels FROM sm WHERE text <> '' GROUP BY 1, 2))
             WHERE rn <= 50 AND length(term) >= 3""",
    "merged": """SELECT coalesce(a.session_id, b.session_id) AS session_id, coalesce(a.term, b.term) AS term,
                 coalesce(fn, 0) AS fn, coalesce(fe, 0) AS fe, tfidf, labels
               FROM cn a FULL JOIN ce b ON a.session_id = b.session_id AND a.term = b.term""",
}


@register(
    "f3_content_candidates",
    with_roles("extracted_keywords", "mentions", "website_content", "scraping_jobs", **CONTENT_SQL,
               body="""SELECT session_id, term, fn AS f_content_noun, fe AS f_content_entity, round(tfidf, 6) AS tfidf, labels
                       FROM merged"""),
)
def f3(t):
    found = ops.content_candidates(session_nouns(t), session_mentions(t))
    return found.select(
        "session_id", "term", "f_content_noun", "f_content_entity", F.round("tfidf", 6).alias("tfidf"),
        F.array_join("labels", ",").alias("labels"),
    )


def suggestions(t):
    languages = t.documents.groupBy("lang").agg(F.min_by("text", "doc_id").alias("text"))
    seed = languages.select(
        "lang", F.array_join(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != ""), " ").alias("seed")
    )
    rows = t.conversations.filter("role = 'user'").select(
        F.element_at(F.array(F.lit("en"), F.lit("de"), F.lit("fr"), F.lit("es")), (F.col("conv_id") % 4 + 1).cast("int")).alias("lang"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("suggestion_id"), "text",
    )
    return rows, seed


_SUGGEST_SQL = {
    "seeds": r"""SELECT lang, array_to_string(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'),
                   lambda w: w <> ''), ' ') AS seed
                 FROM (SELECT lang, arg_min(text, doc_id) AS text FROM documents GROUP BY lang)""",
    "sug": """SELECT (['en','de','fr','es'])[conv_id % 4 + 1] AS lang, conv_id * 1000 + turn AS suggestion_id, text
              FROM conversations WHERE role = 'user'""",
    "occs": f"""SELECT * FROM (SELECT lang, suggestion_id, seed, unnest({terms_sql('text')}) AS term
                FROM sug JOIN seeds USING (lang)) WHERE NOT contains(lower(seed), term)""",
    "cnt": "SELECT lang, term, count(*) AS copies FROM occs GROUP BY ALL",
    "cands": _cands_sql("cnt", "lang", {"suggestion": "1", "copies": "copies"}),
    "corpus": "SELECT lang, text, count(*) AS n FROM sug GROUP BY ALL",
    **_score_sql("lang"),
}


@register(
    "f4_suggestion_candidates",
    with_roles(
        **_SUGGEST_SQL,
        body="""SELECT o.lang, o.suggestion_id, o.term, count(*) AS n, round(any_value(score), 6) AS score
                FROM occs o JOIN scored s ON o.lang = s.lang AND o.term = s.term GROUP BY o.lang, o.suggestion_id, o.term""",
    ),
)
def f4(t):
    rows, seed = suggestions(t)
    found = ops.expand_from_suggestions(rows, seed, similarity_threshold=0.0)
    return found.groupBy("lang", "suggestion_id", "term").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.max("score"), 6).alias("score")
    )


_COMPONENTS = ("frequency_score", "diversity_score", "position_score", "similarity", "tfidf_bonus", "score")
CONTENT_SCORE_SQL = {
    **CONTENT_SQL,
    "cands": _cands_sql("merged", "session_id", {"content_noun": "fn", "content_entity": "fe", "tfidf": "tfidf"}),
    "corpus": """SELECT session_id, text, count(*) AS n FROM (SELECT session_id, word AS text FROM bestn
                 UNION ALL SELECT session_id, text FROM sm) GROUP BY ALL""",
    "seeds": SEEDS_SQL,
    **_score_sql("session_id"),
}


@register(
    "f5_candidate_scores",
    with_roles(
        "extracted_keywords", "mentions", "website_content", "scraping_jobs", "session_results", **CONTENT_SCORE_SQL,
        body="SELECT session_id, term, " + ", ".join(f"round({c}, 6) AS {c}" for c in _COMPONENTS) + " FROM scored",
    ),
)
def f5(t):
    nouns, names = session_nouns(t), session_mentions(t)
    scored = ops.score_candidates(
        ops.content_candidates(nouns, names), ops.noun_corpus(nouns, names), seeds(t), similarity_threshold=0.0
    )
    return scored.select("session_id", "term", *[F.round(c, 6).alias(c) for c in _COMPONENTS])


@register(
    "f6_similarity",
    with_roles("session_results", **RESULT_SQL,
               body="SELECT session_id, term, round(sim, 6) AS similarity FROM sims"),
)
def f6(t):
    terms = ops.result_terms(t.session_results)
    kept = terms.filter("f_title + f_description + f_url >= 2").withColumn("copies", F.lit(1).cast("bigint"))
    corpus = terms.select("session_id", F.col("term").alias("text"), (F.col("f_title") + F.col("f_description")).alias("n"))
    found = ops.similarity(kept, corpus.filter("n > 0"), seeds(t), "session_id")
    return found.withColumn("similarity", F.round("similarity", 6))


@register(
    "f7_similar_candidates",
    with_roles(
        "session_results", **RESULT_SQL,
        body="""SELECT session_id, term, round(similarity, 6) AS similarity, round(score, 6) AS score, position FROM (
                  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY round(score, 9) DESC, term) AS position
                  FROM scored WHERE similarity >= 0.1) WHERE position <= 100""",
    ),
)
def f7(t):
    found = ops.expand_from_results(t.session_results, seeds(t), similarity_threshold=0.1)
    return found.select(
        "session_id", "term", F.round("similarity", 6).alias("similarity"), F.round("score", 6).alias("score"), "position"
    )


def _filter_sql(source: str, extra: str = "") -> str:
    return f"""SELECT * FROM {source} s WHERE score >= 0.1 AND length(term) BETWEEN 3 AND 50
        AND NOT regexp_full_match(term, '[0-9]+') {extra}
        AND NOT EXISTS (SELECT 1 FROM (SELECT session_id, unnest({terms_sql('seed')}) AS st FROM seeds) k
                        WHERE k.session_id = s.session_id AND k.st = lower(s.term))"""


@register(
    "f8_filtered_candidates",
    with_roles(
        "session_results", **RESULT_SQL, kept=_filter_sql("scored", "AND lower(term) NOT IN ('promo', 'economy')"),
        body="SELECT session_id, term, round(score, 6) AS score FROM kept",
    ),
)
def f8(t):
    seed = seeds(t)
    scored = ops.scored_results(t.session_results, seed, similarity_threshold=0.0)
    kept = ops.filter_candidates(scored, seed, exclude=["Promo", "economy"])
    return kept.select("session_id", "term", F.round("score", 6).alias("score"))


_JOB_SQL = {
    "re": with_roles("session_results", **RESULT_SQL, body=f"""SELECT session_id, term, score FROM ({_POSITION})
                     WHERE position <= 100"""),
    "co": with_roles("extracted_keywords", "mentions", "website_content", "scraping_jobs", "session_results",
                     **CONTENT_SCORE_SQL, body=f"""SELECT session_id, term, score FROM ({_POSITION}) WHERE position <= 100"""),
}
_JOB_BODY = {
    "seeds": SEEDS_SQL,
    "every": """SELECT *, 'search_results' AS source FROM re UNION ALL SELECT *, 'content' FROM co""",
    "kept": _filter_sql("every"),
    "stored": """SELECT session_id, term, score, source, CAST(1 AS BIGINT) AS generation, position FROM (SELECT *, row_number()
        OVER (PARTITION BY session_id ORDER BY round(score, 9) DESC, term, source) AS position FROM kept) WHERE position <= 60""",
}


def _job(t):
    seed = seeds(t)
    return ops.expansion_job(
        ops.expand_from_results(t.session_results, seed, similarity_threshold=0.0),
        ops.expand_from_content(session_nouns(t), session_mentions(t), seed, similarity_threshold=0.0),
        seed, max_candidates=60,
    )


def _job_sql(body: str, **more: str) -> str:
    return with_roles("session_results", **_JOB_SQL, **_JOB_BODY, **more, body=body)


@register(
    "f9_expansion_job",
    _job_sql("SELECT session_id, term, source, generation, position, round(score, 6) AS score FROM stored"),
)
def f9(t):
    return _job(t).select(
        "session_id", "term", "source", "generation", "position", F.round("score", 6).alias("score")
    )


@register(
    "f10_next_generation",
    _job_sql("""SELECT DISTINCT session_id, term AS query_text, generation + 1 AS generation FROM stored
                WHERE length(term) % 2 = 0"""),
)
def f10(t):
    stored = materialize(_job(t))
    decisions = stored.groupBy("session_id", "term").agg((F.length(F.first("term")) % 2 == 0).alias("approved"))
    return ops.next_generation(ops.decide(stored, decisions))
