"""Building bipartite networks from results, keywords and entities."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mapweave.functions.skew import top_n
from mapweave.functions.urls import bare_domain, netloc, node_identity
from mapweave.operators import tfidf
from mapweave.operators.networks.graph import Graph


def rank_weight(method: str | Callable[[Column], Column] = "inverse_rank") -> Callable[[Column], Column]:
    """Edge weight from a search rank: 1/rank, exp(-rank/10), 1.0, or a user's column function."""
    if callable(method):
        return method
    if method == "exponential_decay":
        return lambda rank: F.exp(-rank / 10.0)
    if method == "fixed":
        return lambda rank: F.lit(1.0)
    return lambda rank: F.lit(1.0) / rank


def query_website_network(
    queries: DataFrame,
    results: DataFrame,
    session_ids: Sequence[int] | None = None,
    weight: str | Callable[[Column], Column] = "inverse_rank",
    by_domain: bool = True,
) -> Graph:
    """Completed queries of the sessions linked to the sites they returned.

    A site returned twice by a query keeps the weight of its worst rank; its attributes are those of the
    first result in (query, rank) order. Both rules are aggregates, so a site returned by every query is
    combined before the shuffle.
    """
    chosen = queries.filter(F.col("status") == "completed")
    if session_ids:
        chosen = chosen.filter(F.col("session_id").isin(*session_ids))
    label = F.col("domain") if by_domain else F.col("url")
    hits = results.join(chosen.select("query_id"), "query_id").withColumn(
        "node_id", node_identity(F.concat(F.lit("website_"), label))
    )
    pairs = hits.groupBy("query_id", "node_id").agg(
        F.max("rank").alias("rank"),
        F.max_by("result_id", F.struct("rank", "result_id")).alias("result_id"),
        F.count(F.lit(1)).alias("n_results"),
    )
    edges = pairs.select(
        F.concat(F.lit("query_"), F.col("query_id").cast("string")).alias("src"),
        F.col("node_id").alias("dst"),
        rank_weight(weight)(F.col("rank")).alias("weight"),
        "rank",
        "result_id",
        "n_results",
    )
    first = F.min_by(F.struct(label.alias("label"), "domain", "title"), F.struct("query_id", "rank", "result_id"))
    sites = hits.groupBy("node_id").agg(first.alias("f")).select(
        "node_id", F.lit("website").alias("node_type"), "f.label", "f.domain", "f.title",
        F.lit(None).cast("bigint").alias("session_id"),
    )
    sources = chosen.select(
        F.concat(F.lit("query_"), F.col("query_id").cast("string")).alias("node_id"),
        F.lit("query").alias("node_type"),
        F.col("query_text").alias("label"),
        F.lit(None).cast("string").alias("domain"),
        F.lit(None).cast("string").alias("title"),
        "session_id",
    )
    return Graph(sources.unionByName(sites), edges)


def completed_contents(
    contents: DataFrame,
    jobs: DataFrame,
    session_ids: Sequence[int] | None = None,
    languages: Sequence[str] | None = None,
) -> DataFrame:
    """Successful contents of the completed jobs of the sessions, in the chosen languages."""
    done = jobs.filter(F.col("status") == "completed")
    if session_ids:
        done = done.filter(F.col("session_id").isin(*session_ids))
    kept = contents.filter(F.col("status") == "success").join(done.select("job_id"), "job_id", "left_semi")
    return kept.filter(F.col("language").isin(*languages)) if languages else kept


def _website_nodes(sites: DataFrame) -> DataFrame:
    named = sites.select(node_identity(F.concat(F.lit("website_"), "site")).alias("node_id"), "site")
    return named.groupBy("node_id").agg(F.min("site").alias("label")).select(
        "node_id", F.lit("website").alias("node_type"), "label", F.lit(None).cast("string").alias("category")
    )


KEYWORD_ATTRIBUTES = ("language", "extraction_method", "pos_tag")


def website_keyword_network(
    contents: DataFrame,
    keywords: DataFrame,
    top: int = 50,
    min_score: float = 0.0,
    method: str | None = None,
    by_domain: bool = True,
) -> Graph:
    """Sites linked to their ``top`` keywords by mean TF-IDF score, which is the edge weight.

    By domain, every domain is a node even without keywords. By URL, only pages with keywords are. Keyword nodes carry the language,
    extraction method, part of speech (the smallest value where rows differ) and phrase length; page nodes their url, domain and title.
    """
    chosen = keywords.filter(F.col("extraction_method") == method) if method else keywords
    site = F.col("domain") if by_domain else F.col("page_url")
    sites = contents.select("content_id", site.alias("site"))
    carried = [c for c in KEYWORD_ATTRIBUTES if c in keywords.columns]
    grouped = (
        chosen.select("content_id", "lemma", "frequency", "tfidf_score", *carried)
        .join(sites, "content_id")
        .groupBy("site", "lemma")
        .agg(
            F.sum("frequency").alias("frequency"),
            F.avg("tfidf_score").alias("weight"),
            F.count(F.lit(1)).alias("content_count"),
            *[F.min(c).alias(c) for c in carried],
        )
    )
    best = top_n(grouped, ["site"], [F.desc("weight"), F.col("lemma")], top)
    edges = (
        best.filter(F.col("weight") >= min_score)
        .groupBy(
            node_identity(F.concat(F.lit("website_"), "site")).alias("src"),
            node_identity(F.concat(F.lit("keyword_"), "lemma")).alias("dst"),
        )
        .agg(
            F.min("weight").alias("weight"),
            F.min_by("frequency", "weight").alias("frequency"),
            F.min("lemma").alias("lemma"),
            F.min_by("content_count", "weight").alias("content_count"),
            *[F.min(c).alias(c) for c in carried],
        )
    )
    none = F.lit(None).cast("string")
    terms = edges.groupBy("dst").agg(F.min("lemma").alias("label"), *[F.min(c).alias(c) for c in carried]).select(
        F.col("dst").alias("node_id"), F.lit("keyword").alias("node_type"), "label", none.alias("category"),
        *[(F.col(c) if c in carried else none).alias(c) for c in KEYWORD_ATTRIBUTES],
        F.size(F.split("label", " ")).cast("bigint").alias("phrase_length"),
    )
    owners = sites.select("site").distinct() if by_domain else best.select("site").distinct()
    owners = _website_nodes(owners)
    if not by_domain:
        title = F.min("title") if "title" in contents.columns else F.min(none)
        pages = contents.select("*", node_identity(F.concat(F.lit("website_"), "page_url")).alias("node_id")).groupBy("node_id").agg(
            F.min("page_url").alias("url"), F.min(netloc("page_url")).alias("domain"), title.alias("title"))
        owners = owners.join(pages, "node_id", "left")
    return Graph(owners.unionByName(terms, allowMissingColumns=True), edges.drop("lemma", *carried))


def website_entity_network(
    contents: DataFrame,
    entities: DataFrame,
    labels: Sequence[str],
    top: int = 50,
    threshold: float = 0.0,
    min_confidence: float = 0.0,
    method: str | None = None,
    by_domain: bool = True,
) -> Graph:
    """Sites linked to their ``top`` entities by confidence * frequency, which is the edge weight.

    ``threshold`` drops entity rows before they are summed; ``min_confidence`` drops edges after the top cut.
    """
    confidence = F.coalesce("confidence", F.lit(1.0))
    chosen = entities.filter(F.col("label").isin(*labels) & (confidence >= threshold))
    if method:
        chosen = chosen.filter(F.col("extraction_method") == method)
    site = F.col("domain") if by_domain else F.col("page_url")
    sites = contents.select("content_id", site.alias("site"))
    grouped = (
        chosen.select("content_id", "text", "label", "frequency", confidence.alias("confidence"))
        .join(sites, "content_id")
        .groupBy("site", "text", "label")
        .agg(F.sum("frequency").alias("frequency"), F.avg("confidence").alias("confidence"))
        .withColumn("weight", F.col("confidence") * F.col("frequency"))
    )
    best = top_n(grouped, ["site"], [F.desc(F.round("weight", 9)), F.col("text"), F.col("label")], top)
    # two entities with one id give one edge: the last in the order above
    order = F.struct(-F.round("weight", 9), "text", "label")
    edges = (
        best.filter(F.col("confidence") >= min_confidence)
        .groupBy(
            node_identity(F.concat(F.lit("website_"), "site")).alias("src"),
            node_identity(F.concat(F.lit("entity_"), "label", F.lit("_"), "text")).alias("dst"),
        )
        .agg(F.max_by(F.struct("weight", "frequency", "confidence", "text", "label"), order).alias("e"))
        .select("src", "dst", "e.*")
    )
    found = edges.groupBy("dst").agg(F.min("text").alias("text"), F.min("label").alias("category")).select(
        F.col("dst").alias("node_id"), F.lit("entity").alias("node_type"), F.col("text").alias("label"), "category"
    )
    owners = sites.select("site").distinct() if by_domain else best.select("site").distinct()
    return Graph(_website_nodes(owners).unionByName(found), edges.drop("text", "label"))


def domain_noun_edges(nouns: DataFrame, top: float = 20, max_features: int = 1000) -> DataFrame:
    """Edges domain-noun weighted by TF-IDF, all nouns of a domain taken as one document.

    ``nouns`` has (domain, lemma). ``top`` >= 1 is a number of nouns per domain, below 1 a share of its
    nouns (at least one). A domain may hold any share of the rows: they are counted before any
    per-domain step, and the vocabulary bounds what is left to ``max_features`` rows per domain.
    """
    usable = nouns.filter((F.length("lemma") > 2) & F.col("lemma").rlike(r"^\p{L}+$")).select(
        bare_domain("domain").alias("domain"), F.col("lemma").alias("term")
    )
    counts = usable.groupBy("domain", "term").agg(F.count(F.lit(1)).alias("n"))
    vocabulary = tfidf.document_frequency(counts).orderBy(F.desc("cf"), "term").limit(max_features)
    total = counts.agg(F.count_distinct("domain").alias("N")).scalar()
    raw = counts.join(F.broadcast(vocabulary), "term").select(
        "domain", "term", (F.col("n") * (F.log((total + 1) / (F.col("df") + 1)) + 1)).alias("w")
    )
    same = W.partitionBy("domain")
    scored = raw.select("domain", "term", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(same))).alias("weight"))
    allowed = F.lit(top) if top >= 1 else F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(same) * top))
    best = W.partitionBy("domain").orderBy(F.desc(F.round("weight", 9)), "term")
    return (
        scored.withColumns({"__rn": F.row_number().over(best), "__k": allowed})
        .filter(F.col("__rn") <= F.col("__k"))
        .select("domain", "term", "weight")
    )
