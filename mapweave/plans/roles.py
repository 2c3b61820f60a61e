"""The research tables (sessions, queries, results, contents, ...) as views of the given tables.

Every role is a DataFrame derived lazily from the Parquet tables; ``ROLE_SQL`` holds
the same derivations as SQL for the side-by-side checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mapweave.functions import text as tx
from mapweave.functions import words
from mapweave.session import materialize
from mapweave.operators import keywords, tfidf

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

#: Roles that most queries read, some of them several times: written once for a session and folder of tables.
WRITTEN_ONCE = ("search_results", "session_results", "extracted_keywords")
_WRITTEN: dict[tuple[str, str, str], DataFrame] = {}


class Tables:
    """Lazy access to the given tables and to the roles derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._seen: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._seen:
            if name in BASE_TABLES:
                self._seen[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            elif name in WRITTEN_ONCE:
                place = (self.spark.sparkContext.applicationId, self.sf_dir, name)
                if place not in _WRITTEN:
                    _WRITTEN[place] = materialize(ROLES[name](self), keep=True)
                self._seen[name] = _WRITTEN[place]
            elif name in ROLES:
                self._seen[name] = ROLES[name](self)
            else:
                raise AttributeError(name)
        return self._seen[name]


ROLES: dict = {}
ROLE_SQL: dict[str, tuple[tuple[str, ...], str]] = {}


def role(name: str, deps: tuple[str, ...], sql: str):
    def wrap(fn):
        ROLES[name] = fn
        ROLE_SQL[name] = (deps, sql)
        return fn

    return wrap


def with_roles(*names: str, body: str, **extra: str) -> str:
    """``WITH`` clause of the named roles (and their dependencies) followed by ``body``.

    ``extra`` adds further common table expressions, in order, after the roles.
    """
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for dep in ROLE_SQL[name][0]:
            visit(dep)
        ordered.append(name)

    for name in names:
        visit(name)
    parts = [f"{n} AS ({ROLE_SQL[n][1]})" for n in ordered]
    parts += [f"{n} AS ({s})" for n, s in extra.items()]
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + body


@role(
    "search_sessions",
    (),
    """SELECT CAST(substr(o_orderpriority,1,1) AS BIGINT) AS session_id,
              substr(o_orderpriority,3) AS name,
              CAST(substr(o_orderpriority,1,1) AS BIGINT) % 2 AS user_id,
              CASE WHEN CAST(substr(o_orderpriority,1,1) AS BIGINT) % 2 = 0
                   THEN '{"temporal_snapshot": true}' ELSE '{}' END AS config,
              min(o_orderdate) AS created_at
       FROM orders GROUP BY o_orderpriority""",
)
def search_sessions(t: Tables) -> DataFrame:
    number = F.substring("o_orderpriority", 1, 1).cast("bigint")
    return (
        t.orders.groupBy("o_orderpriority")
        .agg(F.min("o_orderdate").alias("created_at"))
        .select(
            number.alias("session_id"),
            F.expr("substring(o_orderpriority, 3)").alias("name"),
            (number % 2).alias("user_id"),
            F.when(number % 2 == 0, F.lit('{"temporal_snapshot": true}')).otherwise(F.lit("{}")).alias("config"),
            "created_at",
        )
    )


@role(
    "search_queries",
    (),
    """SELECT o_orderkey AS query_id, CAST(substr(o_orderpriority,1,1) AS BIGINT) AS session_id,
              'topic ' || lower(substr(o_orderpriority,3)) || ' ' || CAST(year(o_orderdate) AS VARCHAR) AS query_text,
              CASE o_orderkey % 3 WHEN 0 THEN 'google_custom' WHEN 1 THEN 'serper' ELSE 'serpapi_google' END
                AS search_engine,
              CASE WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'completed' END AS status,
              CAST(year(o_orderdate) AS VARCHAR) || '-01-01' AS date_from,
              CAST(year(o_orderdate) AS VARCHAR) || '-12-31' AS date_to,
              o_orderdate AS executed_at
       FROM orders""",
)
def search_queries(t: Tables) -> DataFrame:
    return t.orders.select(*_query_columns())


def _query_columns() -> list[Column]:
    """A query's columns, made of the columns of ``orders``."""
    year = F.year("o_orderdate").cast("string")
    return [
        F.col("o_orderkey").alias("query_id"),
        F.substring("o_orderpriority", 1, 1).cast("bigint").alias("session_id"),
        F.concat(F.lit("topic "), F.lower(F.expr("substring(o_orderpriority, 3)")), F.lit(" "), year).alias("query_text"),
        F.when(F.col("o_orderkey") % 3 == 0, "google_custom")
        .when(F.col("o_orderkey") % 3 == 1, "serper")
        .otherwise("serpapi_google")
        .alias("search_engine"),
        F.when(F.col("o_orderstatus") == "O", "pending").otherwise("completed").alias("status"),
        F.concat(year, F.lit("-01-01")).alias("date_from"),
        F.concat(year, F.lit("-12-31")).alias("date_to"),
        F.col("o_orderdate").alias("executed_at"),
    ]


_SUFFIX_SQL = """CASE {k} % 5 WHEN 0 THEN '.com' WHEN 1 THEN '.org' WHEN 2 THEN '.edu'
                 WHEN 3 THEN '.gov' ELSE '.dk' END"""


def _suffix(key):
    out = F.when(key % 5 == 0, ".com")
    for rest, text in ((1, ".org"), (2, ".edu"), (3, ".gov")):
        out = out.when(key % 5 == rest, text)
    return out.otherwise(".dk")


def _part_texts(parts: DataFrame) -> DataFrame:
    """(p_partkey, p_name, host, path, snippet): texts that depend on the part alone, made before any join."""
    kind = F.lower("p_type")
    return parts.select(
        "p_partkey",
        "p_name",
        F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))).alias("host"),
        F.concat(F.lit("/"), F.replace(kind, F.lit(" "), F.lit("-")), F.lit("/"), F.col("p_partkey").cast("string")).alias("path"),
        F.concat("p_name", F.lit(" "), kind, F.lit(" offer")).alias("snippet"),
    )


_PART_PATH_SQL = "'/' || replace(lower(p_type),' ','-') || '/' || CAST(p_partkey AS VARCHAR)"


@role(
    "search_results",
    (),
    f"""SELECT query_id * 10000000 + rank AS result_id, query_id, rank, domain,
               'https://' || domain || path AS url, title, description, created_at, scraped
        FROM (SELECT l_orderkey AS query_id,
                CAST(row_number() OVER (PARTITION BY l_orderkey
                     ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS BIGINT) AS rank,
                lower(replace(p_brand,'#','')) || {_SUFFIX_SQL.format(k='l_suppkey')} AS domain,
                {_PART_PATH_SQL} AS path, p_name AS title,
                p_name || ' ' || lower(p_type) || ' offer' AS description,
                l_shipdate AS created_at, l_linestatus = 'F' AS scraped
              FROM lineitem JOIN part ON l_partkey = p_partkey)""",
)
def search_results(t: Tables) -> DataFrame:
    return _with_parts(t, _ranked_lines(t)).select(*_result_columns())


def _ranked_lines(t: Tables) -> DataFrame:
    lines = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate",
        (F.col("l_linestatus") == "F").alias("scraped"),
    )
    # a query has as many results as an order has lines: few
    along = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return lines.withColumn("rank", F.row_number().over(along).cast("bigint")).drop("l_linenumber", "l_extendedprice")


def _with_parts(t: Tables, lines: DataFrame) -> DataFrame:
    return lines.join(_part_texts(t.part), F.col("l_partkey") == F.col("p_partkey"))


def _result_columns() -> list[Column]:
    domain = F.concat("host", _suffix(F.col("l_suppkey")))
    return [
        (F.col("l_orderkey") * 10000000 + F.col("rank")).alias("result_id"),
        F.col("l_orderkey").alias("query_id"),
        F.col("rank"),
        domain.alias("domain"),
        F.concat(F.lit("https://"), domain, "path").alias("url"),
        F.col("p_name").alias("title"),
        F.col("snippet").alias("description"),
        F.col("l_shipdate").alias("created_at"),
        F.col("scraped"),
    ]


@role(
    "session_results",
    ("search_queries", "search_results"),
    """SELECT q.session_id, q.status, q.date_from, q.date_to, q.query_text, q.executed_at, r.*
       FROM search_results r JOIN search_queries q ON r.query_id = q.query_id""",
)
def session_results(t: Tables) -> DataFrame:
    # lines and orders meet where the lines were ranked; texts come last, so no shuffle moves a URL, title or description
    orders = t.orders.select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_orderdate")
    lines = _ranked_lines(t).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    every = _with_parts(t, lines).select(*_result_columns(), *_query_columns()[1:])
    return every.select(
        "query_id", "result_id", "rank", "domain", "url", "title", "description", "created_at", "scraped",
        "session_id", "status", "date_from", "date_to", "query_text", "executed_at",
    )


@role(
    "website_content",
    (),
    """SELECT doc_id AS content_id, doc_id % 4 AS job_id, source AS domain, lang AS language, text,
              CASE WHEN n_chars < 200 THEN 'failed' WHEN doc_id % 17 = 0 THEN 'skipped' ELSE 'success' END AS status,
              1 + doc_id % 3 AS scrape_depth,
              CAST(len(regexp_extract_all(text, '\\S+')) AS BIGINT) AS word_count,
              'https://' || source || '.example.org/doc/' || CAST(doc_id AS VARCHAR) AS page_url
       FROM documents""",
)
def website_content(t: Tables) -> DataFrame:
    return t.documents.select(
        F.col("doc_id").alias("content_id"),
        (F.col("doc_id") % 4).alias("job_id"),
        F.col("source").alias("domain"),
        F.col("lang").alias("language"),
        "text",
        F.when(F.col("n_chars") < 200, "failed")
        .when(F.col("doc_id") % 17 == 0, "skipped")
        .otherwise("success")
        .alias("status"),
        (1 + F.col("doc_id") % 3).alias("scrape_depth"),
        F.regexp_count("text", F.lit(r"\S+")).cast("bigint").alias("word_count"),
        F.concat(F.lit("https://"), "source", F.lit(".example.org/doc/"), F.col("doc_id").cast("string")).alias("page_url"),
    )


@role(
    "content_urls",
    (),
    f"""SELECT doc_id AS content_id, 'https://' || lower(replace(p_brand,'#','')) ||
               {_SUFFIX_SQL.format(k='doc_id')} || {_PART_PATH_SQL} AS url
        FROM documents JOIN part ON doc_id = p_partkey""",
)
def content_urls(t: Tables) -> DataFrame:
    """The result URL a document was fetched from (documents and parts share key ranges)."""
    return (
        t.documents.select("doc_id")
        .join(_part_texts(t.part), F.col("doc_id") == F.col("p_partkey"))
        .select(
            F.col("doc_id").alias("content_id"),
            F.concat(F.lit("https://"), "host", _suffix(F.col("doc_id")), "path").alias("url"),
        )
    )


@role(
    "scraping_jobs",
    (),
    """SELECT job_id, 1 + job_id % 5 AS session_id, 'job ' || CAST(job_id AS VARCHAR) AS name,
              CASE WHEN job_id = 3 THEN 'running' ELSE 'completed' END AS status, total_urls, urls_scraped
       FROM (SELECT doc_id % 4 AS job_id, count(*) AS total_urls,
                    CAST(sum(CASE WHEN n_chars < 200 THEN 0 ELSE 1 END) AS BIGINT) AS urls_scraped
             FROM documents GROUP BY 1)""",
)
def scraping_jobs(t: Tables) -> DataFrame:
    return (
        t.documents.groupBy((F.col("doc_id") % 4).alias("job_id"))
        .agg(F.count(F.lit(1)).alias("total_urls"), F.count_if(F.col("n_chars") >= 200).alias("urls_scraped"))
        .select(
            "job_id",
            (1 + F.col("job_id") % 5).alias("session_id"),
            F.concat(F.lit("job "), F.col("job_id").cast("string")).alias("name"),
            F.when(F.col("job_id") == 3, "running").otherwise("completed").alias("status"),
            "total_urls",
            "urls_scraped",
        )
    )


@role(
    "mentions",
    (),
    """SELECT user_id AS content_id, 'Topic ' || json_extract_string(props, '$.k') AS text,
              upper(event_type) AS label, event_id AS start_pos, least(value / 200, 1.0) AS confidence
       FROM events""",
)
def mentions(t: Tables) -> DataFrame:
    return t.events.select(
        F.col("user_id").alias("content_id"),
        F.concat(F.lit("Topic "), F.get_json_object("props", "$.k")).alias("text"),
        F.upper("event_type").alias("label"),
        F.col("event_id").alias("start_pos"),
        F.least(F.col("value") / 200, F.lit(1.0)).alias("confidence"),
    )


STOP_SQL = {code: ", ".join("'" + w + "'" for w in words.STOP_WORDS[code]) for code in words.STOP_WORDS}


def words_sql(text: str) -> str:
    """Array of lower-case words of ``text``."""
    return rf"list_filter(string_split_regex(lower({text}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"


def content_words_sql(text: str, min_length: int = 2) -> str:
    return f"list_filter({words_sql(text)}, lambda w: length(w) >= {min_length} AND w NOT IN ({STOP_SQL['en']}))"


@role(
    "doc_terms",
    (),
    f"SELECT doc_id, text, lang, source, {content_words_sql('text')} AS terms FROM documents",
)
def doc_terms(t: Tables) -> DataFrame:
    # dealt by document before the words are made: any file layout keeps all tasks busy, groups by document need no other shuffle
    return t.documents.select("doc_id", "text", "lang", "source").repartition("doc_id").withColumn("terms", tx.content_words("text"))


@role(
    "doc_tfidf",
    ("doc_terms",),
    """SELECT c.doc_id, c.term, c.n, c.n_terms, d.df,
              (c.n / c.n_terms) * (CASE WHEN d.df = 0 THEN 0.0 ELSE
                 ln(((SELECT count(*) FROM documents) + 1.0) / (d.df + 1.0)) + 1.0 END) AS tfidf
       FROM (SELECT doc_id, term, n_terms, count(*) AS n
             FROM (SELECT doc_id, len(terms) AS n_terms, unnest(terms) AS term FROM doc_terms)
             GROUP BY ALL) c
       JOIN (SELECT term, count(DISTINCT doc_id) AS df
             FROM (SELECT doc_id, unnest(terms) AS term FROM doc_terms) GROUP BY term) d ON c.term = d.term""",
)
def doc_tfidf(t: Tables) -> DataFrame:
    return tfidf.tfidf(t.documents, "doc_id", tx.content_words("text"), cut=tfidf.content_cut("text"))


@role(
    "extracted_keywords",
    ("doc_tfidf",),
    """SELECT doc_id AS content_id, term AS lemma, term AS word, n AS frequency, tfidf AS tfidf_score,
              lang AS language, 'tfidf' AS extraction_method
       FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tfidf DESC, term) AS rn FROM doc_tfidf)
       JOIN (SELECT doc_id, lang FROM documents) USING (doc_id) WHERE rn <= 20""",
)
def extracted_keywords(t: Tables) -> DataFrame:
    found = keywords.tfidf_keywords(t.documents, max_keywords=20)
    languages = t.documents.select("doc_id", F.col("lang").alias("language"))
    return found.join(languages, "doc_id").select(
        F.col("doc_id").alias("content_id"), "lemma", "word", "frequency", "tfidf_score", "language",
        F.lit("tfidf").alias("extraction_method"),
    )


@role(
    "content_analysis",
    (),
    """SELECT l.doc_id AS content_id, CASE WHEN l.quality = 1 THEN 'completed' ELSE 'failed' END AS status,
              n_chars / 1000.0 AS processing_duration, n_chars % 50 AS nouns_count, n_chars % 7 AS entities_count,
              TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 HOUR * l.doc_id AS created_at
       FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
)
def content_analysis(t: Tables) -> DataFrame:
    return t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id").select(
        F.col("doc_id").alias("content_id"),
        F.when(F.col("quality") == 1, "completed").otherwise("failed").alias("status"),
        (F.col("n_chars") / 1000.0).cast("double").alias("processing_duration"),
        (F.col("n_chars") % 50).alias("nouns_count"),
        (F.col("n_chars") % 7).alias("entities_count"),
        F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, doc_id)").alias("created_at"),
    )


@role(
    "network_exports",
    (),
    """SELECT o_orderkey AS export_id, o_custkey % 20 AS user_id,
              CASE o_orderkey % 3 WHEN 0 THEN 'search_website' WHEN 1 THEN 'website_noun' ELSE 'website_ner' END AS type,
              list_value(CAST(substr(o_orderpriority,1,1) AS BIGINT), CAST(substr(o_orderpriority,1,1) AS BIGINT) % 5 + 1)
                AS session_ids,
              CAST(floor(o_totalprice) AS BIGINT) AS file_size, o_orderdate AS created_at
       FROM orders""",
)
def network_exports(t: Tables) -> DataFrame:
    number = F.substring("o_orderpriority", 1, 1).cast("bigint")
    kind = F.col("o_orderkey") % 3
    return t.orders.select(
        F.col("o_orderkey").alias("export_id"),
        (F.col("o_custkey") % 20).alias("user_id"),
        F.when(kind == 0, "search_website").when(kind == 1, "website_noun").otherwise("website_ner").alias("type"),
        F.array(number, number % 5 + 1).alias("session_ids"),
        F.floor("o_totalprice").cast("bigint").alias("file_size"),
        F.col("o_orderdate").alias("created_at"),
    )


@role(
    "bulk_rows",
    (),
    """SELECT o_custkey % 7 AS upload_id, o_orderkey AS row_number,
              CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'failed' END AS status,
              CASE WHEN o_orderstatus = 'P' THEN 'engine error ' || CAST(o_orderkey % 3 AS VARCHAR) END AS error_message
       FROM orders""",
)
def bulk_rows(t: Tables) -> DataFrame:
    status = F.col("o_orderstatus")
    return t.orders.select(
        (F.col("o_custkey") % 7).alias("upload_id"),
        F.col("o_orderkey").alias("row_number"),
        F.when(status == "F", "completed").when(status == "O", "pending").otherwise("failed").alias("status"),
        F.when(status == "P", F.concat(F.lit("engine error "), (F.col("o_orderkey") % 3).cast("string"))).alias(
            "error_message"
        ),
    )
