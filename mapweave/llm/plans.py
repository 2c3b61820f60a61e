"""Registered queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapweave.llm import fingerprints, langid, media, mixing, ngramjoin, packing, pii, ranked, runs, secretscan, toxicity, urlrules, warc
from mapweave.llm.common import documents, scratch_path
from mapweave.llm.sampling import labelled_sample

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return wrap


@query("op1_media_columns")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "media")
    media.write_archives(documents(spark, sf_dir), path, "doc_id", media.padded(F.col("text")))
    found = media.media_features(media.read_archives(spark, path))
    return found.select(F.col("key").cast("long").alias("doc_id"), *[c for c in found.columns if c != "key"])


@query("op2_source_mixing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken, docs = mixing.mix(documents(spark, sf_dir), "doc_id", "source", mixing.word_count(F.col("text")), mixing.repeating_weights)
    words = taken.groupBy("row_no").agg(F.sum("length").alias("taken"))
    return docs.join(words, "row_no", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )


@query("op4_nnls_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(documents(spark, sf_dir), "doc_id", "text")
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


URL_RULES = [
    urlrules.Rule(urlrules.BLOCK, "net/"), urlrules.Rule(urlrules.ALLOW, "example.net/en/"),
    urlrules.Rule(urlrules.BLOCK, "example.com/de/"), urlrules.Rule(urlrules.ALLOW, "org/fr/"),
]


@query("op9_url_rules", """
    WITH cut AS (
        SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
    ), parts AS (
        SELECT page_id,
            translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
    ), rules(host, path, verdict) AS (
        VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
    ), best AS (
        SELECT p.page_id, max_by(r.host || r.path, length(r.host || r.path)) AS rule,
            max_by(r.verdict, length(r.host || r.path)) AS verdict
        FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
        GROUP BY p.page_id
    )
    SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, 'allow') AS verdict
    FROM parts p LEFT JOIN best b ON p.page_id = b.page_id
""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id", "url", URL_RULES)


@query("op10_language_id")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", F.coalesce(toxicity.held_out(4) == 2, F.lit(False)))
    rows = labelled_sample(docs.where("NOT held_out").select("doc_id", "text", "lang"), "lang", "doc_id", langid.PER_LANGUAGE)
    found = langid.identify(docs, "doc_id", "text", langid.fit([(r["text"], r["lang"]) for r in rows]))
    return found.select("doc_id", F.coalesce(toxicity.held_out(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


@query("op5_toxicity_cnn")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = toxicity.score(docs, "doc_id", "text", toxicity.fit_labelled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return found.select("doc_id", F.coalesce(toxicity.held_out(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op6_minhash_fingerprints")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(documents(spark, sf_dir), "doc_id", "text")


@query("op7_information_pii")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, extra = pii.find(documents(spark, sf_dir), "doc_id", "text")
    found = pii.with_terms(rows, extra)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        F.col("key").alias("doc_id"), *[count(k) for k in pii.KINDS],
        F.sha2(pii.joined(F.col("spans")).cast("binary"), 256).alias("base_sha256"), pii.joined(F.col("all")).alias("spans"))


@query("op8_secret_forest")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return secretscan.report(docs, secretscan.scan(docs, "doc_id", "text", "source"), "doc_id", "text")


@query("op3_ngram_jaccard")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.similar_components(documents(spark, sf_dir), "doc_id", "text")


@query("op11_periodic_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = runs.periodic_runs(docs, "doc_id", runs.with_planted_runs(F.col("doc_id"), F.col("text")))
    return runs.digests(found, "doc_id")


@query("op12_best_position", r"""
    WITH words AS (
        SELECT doc_id, translate(unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM documents
    ), asked AS (
        SELECT item_id, term, count(*) AS times FROM (
            SELECT item_id, translate(unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM benchmark) GROUP BY item_id, term
    ), sizes AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
    corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sizes),
    counts AS (SELECT doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term),
    weights AS (
        SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM counts, corpus GROUP BY term
    ), impacts AS (
        SELECT c.doc_id, c.term, (1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // terms)) AS impact
        FROM counts c JOIN sizes s ON c.doc_id = s.doc_id, corpus
    ), scores AS (
        SELECT a.item_id, i.doc_id, CAST(sum(w * impact * times) AS BIGINT) AS score
        FROM asked a JOIN impacts i ON a.term = i.term JOIN weights w ON a.term = w.term GROUP BY a.item_id, i.doc_id
    ), ranked AS (
        SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scores WHERE score > 0
    )
    SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranked.search(documents(spark, sf_dir), "doc_id", "text", spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "item_id", "text")
    return found.select(F.col("query_key").alias("item_id"), "rank", F.col("key").alias("doc_id"), "score")


#: Longer blocks than this are written as segments.
SEGMENT_BYTES = 32 << 10


@query("op13_warc_segments", """
    WITH hashed AS (
        SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex,
            min(page_id) OVER (PARTITION BY coalesce(html, '')) AS origin FROM pages
    )
    SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
            ((CAST('0x' || substr(hex, CAST(j // 4 * 5 + 1 AS INTEGER), 5) AS INTEGER) >> CAST(15 - 5 * (j % 4) AS INTEGER)) & 31) + 1, 1)), '') AS payload_digest,
        CASE WHEN page_id = origin THEN 'response' ELSE 'revisit' END AS record_type,
        CASE WHEN page_id <> origin THEN origin END AS refers_to FROM hashed
""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(
        "page_id", "url", "html", F.concat_ws("#", "_metadata.file_path", "_metadata.row_index").alias("row_id"))
    warc.write_warc(pages, path, "page_id", "url", F.col("html"), F.col("row_id"), segmentBytes=SEGMENT_BYTES)
    found = warc.rebuild(spark, path)
    return found.select(F.col("key").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                        F.col("refers_to").cast("long").alias("refers_to"))
