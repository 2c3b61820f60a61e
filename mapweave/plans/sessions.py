"""Queries over sessions, jobs and listings."""

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapweave.functions import urls
from mapweave.operators import sessions as ops
from mapweave.plans import sqlkit as q
from mapweave.plans.registry import register
from mapweave.plans.roles import with_roles
from mapweave.session import run_folder
from mapweave.sources.documents import read_document, write_document


def stamp(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


_DEDUP_SQL = f"""SELECT * FROM (SELECT *, md5({q.normalized('url')}) AS url_hash,
    row_number() OVER (PARTITION BY session_id, md5({q.normalized('url')}) ORDER BY query_id, rank, result_id) AS rn
    FROM session_results) WHERE rn = 1"""


@register(
    "d1_session_dedup",
    with_roles("session_results", kept=_DEDUP_SQL,
               body="SELECT session_id, url_hash, result_id, query_id, rank, url FROM kept"),
)
def d1(t):
    return ops.deduplicate_results(t.session_results).select(
        "session_id", "url_hash", "result_id", "query_id", "rank", "url"
    )


@register(
    "d2_stored_counts",
    with_roles("session_results", kept=_DEDUP_SQL,
               body="SELECT query_id, count(*) AS result_count FROM kept GROUP BY query_id"),
)
def d2(t):
    slim = t.session_results.select("session_id", "query_id", "rank", "result_id", "url")
    return ops.stored_counts(ops.deduplicate_results(slim))


@register(
    "d3_session_overview",
    with_roles(
        "search_sessions", "search_queries", "session_results",
        body="""SELECT s.session_id, s.name, query_count, result_count, domain_count FROM search_sessions s
                LEFT JOIN (SELECT session_id, count(*) AS query_count FROM search_queries GROUP BY 1) USING (session_id)
                LEFT JOIN (SELECT session_id, count(*) AS result_count, count(DISTINCT domain) AS domain_count
                           FROM session_results GROUP BY 1) USING (session_id)""",
    ),
)
def d3(t):
    found = ops.session_overview(t.search_sessions, t.search_queries, t.search_results)
    return found.select("session_id", "name", "query_count", "result_count", "domain_count")


@register(
    "d4_session_funnel",
    with_roles(
        "search_sessions", "search_queries", "scraping_jobs", "website_content", "content_analysis",
        body="""SELECT s.session_id, s.name, query_count, coalesce(p.n, 0) AS pages_scraped,
                       coalesce(a.n, 0) AS pages_analyzed
                FROM search_sessions s
                LEFT JOIN (SELECT session_id, count(*) AS query_count FROM search_queries GROUP BY 1) USING (session_id)
                LEFT JOIN (SELECT session_id, count(*) AS n FROM website_content c JOIN scraping_jobs USING (job_id)
                           WHERE c.status = 'success' GROUP BY 1) p USING (session_id)
                LEFT JOIN (SELECT session_id, count(DISTINCT content_id) AS n FROM website_content
                           JOIN scraping_jobs USING (job_id) WHERE content_id IN (SELECT content_id FROM content_analysis)
                           GROUP BY 1) a USING (session_id)""",
    ),
)
def d4(t):
    return ops.session_funnel(
        t.search_sessions, t.search_queries, t.scraping_jobs, t.website_content, t.content_analysis
    )


@register(
    "d5_results_with_contents",
    with_roles(
        "search_results", "content_urls", "website_content",
        body="""SELECT r.query_id, r.rank, r.url, r.title, c.content_id, c.language
                FROM search_results r LEFT JOIN (SELECT u.url, c.content_id, c.language FROM content_urls u
                     JOIN website_content c ON c.content_id = u.content_id) c ON r.url = c.url""",
    ),
)
def d5(t):
    contents = t.content_urls.join(t.website_content.select("content_id", "language"), "content_id")
    found = ops.results_with_contents(t.search_results.select("query_id", "rank", "url", "title"), contents)
    return found.select("query_id", "rank", "url", "title", "content_id", "language").orderBy("query_id", "rank")


@register(
    "d6_session_results",
    with_roles("session_results",
               body="SELECT session_id, query_id, result_id, rank, domain FROM session_results WHERE session_id IN (1, 3)"),
)
def d6(t):
    found = ops.results_of_sessions(t.search_results, t.search_queries, [1, 3])
    return found.select("session_id", "query_id", "result_id", "rank", "domain")


@register(
    "d7_job_overview",
    with_roles(
        "scraping_jobs", "website_content", "content_analysis",
        body="""SELECT j.job_id, j.name, j.status, count(*) AS content_count,
                  CAST(sum(CASE WHEN c.status = 'success' THEN 1 ELSE 0 END) AS BIGINT) AS success_count,
                  count(a.content_id) AS analyzed_count
                FROM scraping_jobs j LEFT JOIN website_content c USING (job_id)
                LEFT JOIN content_analysis a ON a.content_id = c.content_id
                GROUP BY 1, 2, 3 HAVING count(a.content_id) > 1""",
    ),
)
def d7(t):
    found = ops.job_overview(t.scraping_jobs, t.website_content, t.content_analysis, min_analyzed=1)
    return found.select("job_id", "name", "status", "content_count", "success_count", "analyzed_count")


@register(
    "d8_not_analyzed",
    with_roles("website_content", "content_analysis",
               body="""SELECT content_id, job_id, language FROM website_content
                       WHERE content_id NOT IN (SELECT content_id FROM content_analysis)"""),
)
def d8(t):
    return ops.contents_without_analysis(t.website_content, t.content_analysis).select(
        "content_id", "job_id", "language"
    )


@register(
    "d9_seed_urls",
    with_roles("scraping_jobs", "session_results",
               body="""SELECT job_id, session_id, url, min(rank) AS best_rank FROM session_results
                       JOIN scraping_jobs USING (session_id) GROUP BY ALL"""),
)
def d9(t):
    return ops.seed_urls(t.scraping_jobs, t.search_queries, t.search_results)


@register(
    "d10_job_statistics",
    with_roles(
        "website_content",
        body="""SELECT job_id, metric, '' AS key, round(CAST(value AS DOUBLE), 6) AS value FROM (
                  SELECT job_id, unnest(['total','success','failed','skipped','total_words','avg_words']) AS metric,
                    unnest([count(*), count(*) FILTER (status = 'success'), count(*) FILTER (status = 'failed'),
                            count(*) FILTER (status = 'skipped'), sum(word_count), avg(word_count)]) AS value
                  FROM website_content GROUP BY job_id)
                UNION ALL SELECT job_id, 'depth', CAST(scrape_depth AS VARCHAR), CAST(count(*) AS DOUBLE)
                  FROM website_content GROUP BY job_id, scrape_depth
                UNION ALL SELECT job_id, 'language', language, CAST(count(*) AS DOUBLE)
                  FROM website_content WHERE language IS NOT NULL GROUP BY job_id, language""",
    ),
)
def d10(t):
    return ops.job_statistics(t.website_content).withColumn("value", F.round("value", 6))


@register(
    "d11_offset_page",
    with_roles(
        "search_results",
        body="""SELECT result_id, domain, rank, total, 3 = pages AS last_page FROM (SELECT result_id, domain, rank,
                  count(*) OVER () AS total, CAST(ceil(count(*) OVER () / 25.0) AS BIGINT) AS pages FROM search_results)
                ORDER BY domain DESC, result_id LIMIT 25 OFFSET 50""",
    ),
)
def d11(t):
    rows, facts = ops.paginate(
        t.search_results.select("result_id", "domain", "rank"), 3, 25, "domain", "result_id", descending=True
    )
    return rows.withColumns({"total": F.lit(facts["total"]).cast("bigint"), "last_page": F.lit(not facts["has_next"])})


@register(
    "d11b_deep_pages",
    with_roles(
        "search_results",
        body="""SELECT page, result_id, domain, rank FROM (SELECT result_id, domain, rank,
                  1 + (row_number() OVER (ORDER BY domain DESC, result_id) - 1) // 25 AS page, count(*) OVER () AS total FROM search_results)
                WHERE page IN (1, 1 + (total - 1) // 50, 1 + (total - 1) // 25)""",
    ),
)
def d11b(t):
    """The first, a middle and the last page of one index."""
    index = ops.PageIndex(t.search_results.select("result_id", "domain", "rank"), "domain", "result_id", descending=True, ranges=64)
    last = 1 + (index.total - 1) // 25
    wanted = sorted({1, 1 + (index.total - 1) // 50, last})
    parts = [index.page(p, 25)[0].select(F.lit(p).cast("bigint").alias("page"), "result_id", "domain", "rank") for p in wanted]
    return reduce(DataFrame.unionByName, parts)


@register(
    "d12_keyset_page",
    with_roles("search_queries",
               body="""SELECT query_id, session_id, query_text FROM search_queries WHERE query_id > 1000
                       ORDER BY query_id LIMIT 51"""),
)
def d12(t):
    return ops.keyset_page(t.search_queries, "query_id", 50, cursor=1000).select(
        "query_id", "session_id", "query_text"
    )


@register(
    "d13_retention",
    with_roles(
        "network_exports", "content_analysis",
        body="""SELECT 'export' AS kind, export_id AS id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created
                FROM network_exports WHERE created_at < TIMESTAMP '2001-01-01' - INTERVAL 365 DAY
                UNION ALL SELECT 'analysis', content_id, strftime(created_at, '%Y-%m-%d %H:%M:%S')
                FROM content_analysis WHERE status = 'failed' AND created_at < TIMESTAMP '2024-02-01' - INTERVAL 10 DAY""",
    ),
)
def d13(t):
    exports = ops.older_than(t.network_exports, "created_at", 365, "2001-01-01").select(
        F.lit("export").alias("kind"), F.col("export_id").alias("id"), stamp("created_at").alias("created")
    )
    failed = ops.older_than(t.content_analysis.filter("status = 'failed'"), "created_at", 10, "2024-02-01").select(
        F.lit("analysis").alias("kind"), F.col("content_id").alias("id"), stamp("created_at").alias("created")
    )
    return exports.unionByName(failed)


@register(
    "d14_temporal_snapshots",
    with_roles("search_sessions", "search_queries",
               body="""SELECT session_id, name FROM search_sessions
                       WHERE json_extract_string(config, '$.temporal_snapshot') = 'true'
                         AND session_id IN (SELECT session_id FROM search_queries WHERE query_text ILIKE '%HIGH 199%')"""),
)
def d14(t):
    return ops.temporal_snapshots(t.search_sessions, t.search_queries, "HIGH 199").select("session_id", "name")


@register(
    "d15_exports_of_session",
    with_roles("network_exports",
               body="""SELECT export_id, user_id, type, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created
                       FROM network_exports WHERE list_contains(session_ids, 2) AND type = 'website_noun'
                       ORDER BY created_at DESC, export_id LIMIT 50 OFFSET 50"""),
)
def d15(t):
    chosen = ops.exports_of(t.network_exports, session_id=2, kind="website_noun")
    rows, _ = ops.paginate(chosen, 2, 50, "created_at", "export_id", descending=True)
    return rows.select("export_id", "user_id", "type", stamp("created_at").alias("created"))


@register(
    "d16_export_totals",
    with_roles(
        "network_exports",
        body="""SELECT 'user' AS scope, CAST(user_id AS VARCHAR) AS key, count(*) AS n_exports,
                  CAST(sum(file_size) AS BIGINT) AS total_bytes FROM network_exports GROUP BY user_id
                UNION ALL SELECT 'type', type, count(*), CAST(sum(file_size) AS BIGINT) FROM network_exports GROUP BY type
                UNION ALL SELECT 'all', '', count(*), CAST(sum(file_size) AS BIGINT) FROM network_exports""",
    ),
)
def d16(t):
    return ops.export_totals(t.network_exports)


@register(
    "d17_upload_summary",
    with_roles(
        "bulk_rows",
        body="""SELECT upload_id, total, completed, failed, pending, row_number AS failed_row, error_message FROM (
                  SELECT upload_id, count(*) AS total, count(*) FILTER (status = 'completed') AS completed,
                    count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'pending') AS pending
                  FROM bulk_rows GROUP BY upload_id)
                LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY upload_id ORDER BY row_number) AS rn
                           FROM bulk_rows WHERE status = 'failed') USING (upload_id) WHERE rn <= 20""",
    ),
)
def d17(t):
    failed = ops.first_failed_rows(t.bulk_rows).select(
        "upload_id", F.col("row_number").alias("failed_row"), "error_message"
    )
    return ops.upload_summary(t.bulk_rows).join(failed, "upload_id", "left")


@register(
    "d18_primary_language",
    with_roles("website_content",
               body="""SELECT job_id, language FROM (SELECT job_id, coalesce(language, 'en') AS language,
                         row_number() OVER (PARTITION BY job_id ORDER BY count(*) DESC, coalesce(language, 'en')) AS rn
                       FROM website_content GROUP BY 1, 2) WHERE rn = 1"""),
)
def d18(t):
    return ops.primary_language(t.website_content)


@register(
    "d19_batch_statistics",
    with_roles(
        "content_analysis",
        body="""SELECT count(*) AS total, count(*) FILTER (status = 'completed') AS successful,
                  count(*) FILTER (status <> 'completed') AS failed, round(sum(processing_duration), 6) AS total_time,
                  round(avg(processing_duration), 6) AS avg_time,
                  CAST(sum(nouns_count) FILTER (status = 'completed') AS BIGINT) AS total_nouns,
                  CAST(sum(entities_count) FILTER (status = 'completed') AS BIGINT) AS total_entities,
                  round(avg(nouns_count) FILTER (status = 'completed'), 6) AS avg_nouns,
                  round(avg(entities_count) FILTER (status = 'completed'), 6) AS avg_entities FROM content_analysis""",
    ).replace("processing_duration)", "CAST(processing_duration AS DOUBLE))"),
)
def d19(t):
    out = ops.batch_statistics(t.content_analysis)
    return out.withColumns(
        {c: F.round(c, 6) for c in ("total_time", "avg_time", "avg_nouns", "avg_entities")}
    )


@register(
    "d20_job_progress",
    with_roles("scraping_jobs",
               body="""SELECT job_id, CASE WHEN total_urls = 0 THEN 0.0 ELSE round(urls_scraped * 100.0 / total_urls, 6) END
                         ::DOUBLE AS progress, status IN ('pending','processing','running') AS is_active,
                         status IN ('completed','failed','cancelled') AS is_finished FROM scraping_jobs"""),
)
def d20(t):
    return ops.job_progress(t.scraping_jobs).select(
        "job_id", F.round("progress", 6).alias("progress"), "is_active", "is_finished"
    )


@register(
    "d21_table_view",
    with_roles("search_results",
               body="""SELECT result_id, title, domain, rank FROM (SELECT result_id, title, domain, rank FROM search_results)
                       WHERE contains(lower(domain), '.dk') AND (contains(CAST(result_id AS VARCHAR), 'red')
                         OR contains(lower(title), 'red') OR contains(lower(domain), 'red')
                         OR contains(CAST(rank AS VARCHAR), 'red'))
                       ORDER BY rank DESC, result_id LIMIT 100"""),
)
def d21(t):
    shown = ops.table_view(
        t.search_results.select("result_id", "title", "domain", "rank"), {"domain": ".DK"}, search="Red"
    )
    return ops.paginate(shown, 1, 100, "rank", "result_id", descending=True)[0]


@register(
    "d22_page_listing",
    with_roles("website_content",
               body=f"""SELECT job_id, content_id, scrape_depth, {q.netloc('page_url')} AS domain, status
                        FROM website_content WHERE job_id = 2 ORDER BY scrape_depth, content_id LIMIT 50"""),
)
def d22(t):
    chosen = t.website_content.filter("job_id = 2").select(
        "job_id", "content_id", "scrape_depth", urls.netloc("page_url").alias("domain"), "status"
    )
    return ops.paginate(chosen, 1, 50, "scrape_depth", "content_id")[0]


_RESULT_JSON = "CAST(to_json(struct_pack(rank := r.rank, url := r.url, title := r.title)) AS VARCHAR)"


@register(
    "d23_nested_documents",
    with_roles(
        "search_sessions", "search_queries", "search_results",
        body=f"""
        SELECT session_id, CAST('-9223372036854775808' AS BIGINT) AS query_id, 0::BIGINT AS event, 0::BIGINT AS rank, 0::BIGINT AS result_id,
          CASE WHEN session_id = (SELECT min(session_id) FROM search_sessions) THEN '[' ELSE ',' END ||
          '{{"session_id":' || session_id || ',"name":"' || name || '","queries":[' AS line FROM search_sessions
        UNION ALL SELECT session_id, query_id, 0, 0, 0, CASE WHEN query_id = min(query_id) OVER (PARTITION BY session_id) THEN '' ELSE ',' END ||
          '{{"query_id":' || query_id || ',"query_text":"' || query_text || '","results":[' FROM search_queries
        UNION ALL SELECT session_id, q.query_id, 1, rank, result_id,
          CASE WHEN row_number() OVER (PARTITION BY r.query_id ORDER BY rank, result_id) = 1 THEN '' ELSE ',' END || {_RESULT_JSON}
          FROM search_results r JOIN search_queries q ON r.query_id = q.query_id
        UNION ALL SELECT session_id, query_id, 2, 0, 0, ']}}' FROM search_queries
        UNION ALL SELECT session_id, 9223372036854775807, 2, 0, 0,
          CASE WHEN session_id = (SELECT max(session_id) FROM search_sessions) THEN ']}}]' ELSE ']}}' END FROM search_sessions""",
    ),
)
def d23(t):
    return ops.result_documents(t.search_sessions.select("session_id", "name"), t.search_queries, t.search_results)


@register(
    "d23c_document_file",
    with_roles(
        "search_sessions", "search_queries", "search_results",
        body="""SELECT s.session_id, s.name, (SELECT count(*) FROM search_queries q WHERE q.session_id = s.session_id) AS n_queries,
                  (SELECT count(*) FROM search_queries q JOIN search_results r ON r.query_id = q.query_id
                   WHERE q.session_id = s.session_id) AS n_results FROM search_sessions s""",
    ),
)
def d23c(t):
    """The documents as one JSON file, read back by ranges of its lines."""
    path = f"{run_folder(t.spark)}/documents-{uuid.uuid4().hex}/sessions.json"
    lines = ops.result_documents(t.search_sessions.select("session_id", "name"), t.search_queries, t.search_results)
    write_document(lines.orderBy(*ops.DOCUMENT_ORDER), path)
    found = ops.read_result_documents(read_document(t.spark, path))
    return found.groupBy("session_id").agg(
        F.max("name").alias("name"), F.count_if(F.col("kind") == "query").alias("n_queries"), F.count_if(F.col("kind") == "result").alias("n_results"))


@register(
    "d23b_content_documents",
    with_roles(
        "extracted_keywords", "website_content", "mentions", "content_analysis",
        body="""SELECT c.content_id, c.language, keywords, entities, analysis FROM website_content c LEFT JOIN (
                  SELECT content_id, CAST(to_json(list(struct_pack(position := rn, lemma := lemma, frequency := frequency)
                         ORDER BY rn)) AS VARCHAR) AS keywords
                  FROM (SELECT *, row_number() OVER (PARTITION BY content_id ORDER BY tfidf_score DESC, lemma) AS rn
                        FROM extracted_keywords) GROUP BY content_id) k ON c.content_id = k.content_id
                LEFT JOIN (SELECT content_id, CAST(to_json(list(struct_pack(text := text, label := label, frequency := frequency)
                         ORDER BY frequency DESC, text, label)) AS VARCHAR) AS entities
                  FROM (SELECT content_id, text, label, count(*) AS frequency FROM mentions GROUP BY ALL) GROUP BY content_id) e
                  ON c.content_id = e.content_id
                LEFT JOIN (SELECT content_id, CAST(to_json(struct_pack(status := status, nouns_count := nouns_count, entities_count := entities_count))
                         AS VARCHAR) AS analysis FROM content_analysis) a ON c.content_id = a.content_id""",
    ),
)
def d23b(t):
    entities = t.mentions.groupBy("content_id", "text", "label").agg(F.count(F.lit(1)).alias("frequency"))
    analysis = t.content_analysis.select("content_id", "status", "nouns_count", "entities_count")
    return ops.content_documents(t.website_content.select("content_id", "language"), t.extracted_keywords, entities, analysis)


@register(
    "d24_user_sessions",
    with_roles("search_sessions", "search_queries",
               body="""SELECT user_id, session_id, name, query_count, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created
                       FROM search_sessions JOIN (SELECT session_id, count(*) AS query_count FROM search_queries
                            GROUP BY 1) USING (session_id) WHERE user_id = 1
                       ORDER BY created_at DESC, session_id LIMIT 2"""),
)
def d24(t):
    listed = ops.user_sessions(t.search_sessions.filter("user_id = 1"), t.search_queries)
    rows, _ = ops.paginate(listed, 1, 2, "created_at", "session_id", descending=True)
    return rows.select("user_id", "session_id", "name", "query_count", stamp("created_at").alias("created"))
