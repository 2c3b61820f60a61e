"""Network queries."""

import uuid

from pyspark.sql import functions as F

from mapweave.operators.networks import backbone, build, filters, iterative, job, metrics, style
from mapweave.operators.networks.graph import Graph
from mapweave.operators.networks.overlap import QueryOverlap
from mapweave.plans import sqlkit as q
from mapweave.plans.registry import register
from mapweave.plans.roles import with_roles
from mapweave.session import materialize, run_folder

# -- the query-website network as SQL ----------------------------------------------------------

_SITE = q.sanitized("'website_' || domain")
NET = {
    "hits": f"""SELECT r.*, {_SITE} AS node_id FROM search_results r
                JOIN search_queries s ON r.query_id = s.query_id WHERE s.status = 'completed'""",
    "edges": """SELECT 'query_' || CAST(query_id AS VARCHAR) AS src, node_id AS dst, 1.0::DOUBLE / max(rank) AS weight,
                  max(rank) AS rank, arg_max(result_id, rank) AS result_id, count(*) AS n_results
                FROM hits GROUP BY query_id, node_id""",
    "nodes": """SELECT 'query_' || CAST(query_id AS VARCHAR) AS node_id, 'query' AS node_type, query_text AS label
                FROM search_queries WHERE status = 'completed'
                UNION ALL SELECT DISTINCT node_id, 'website', domain FROM hits""",
}
_ROLES = ("search_results", "search_queries")


def net_sql(body: str, **more: str) -> str:
    return with_roles(*_ROLES, **NET, **more, body=body)


def net(t) -> Graph:
    return build.query_website_network(t.search_queries, t.search_results)


def _sig_sql(edges: str = "edges") -> dict:
    return {
        "ends": f"SELECT src AS node, weight FROM {edges} UNION ALL SELECT dst, weight FROM {edges}",
        "strength": "SELECT node, sum(weight) AS s, count(*) AS k FROM ends GROUP BY node",
        "sig": f"""SELECT e.*, CASE WHEN a.k = 1 THEN 0.0 ELSE pow(1 - weight / a.s, a.k - 1) END AS alpha_src,
                     CASE WHEN b.k = 1 THEN 0.0 ELSE pow(1 - weight / b.s, b.k - 1) END AS alpha_dst
                   FROM {edges} e JOIN strength a ON e.src = a.node JOIN strength b ON e.dst = b.node""",
        "kept": "SELECT src, dst, weight, rank FROM sig WHERE alpha_src < 0.3 AND alpha_dst < 0.3",
    }


ALPHA = 0.3


@register("h1_query_website_network", net_sql("SELECT src, dst, round(weight, 6) AS weight, rank, n_results FROM edges"))
def h1(t):
    return net(t).edges.select("src", "dst", F.round("weight", 6).alias("weight"), "rank", "n_results")


@register(
    "h1b_query_website_nodes",
    net_sql("""SELECT node_id, node_type, label, title FROM nodes LEFT JOIN (
                 SELECT node_id, title FROM (SELECT node_id, title, row_number() OVER (PARTITION BY node_id
                   ORDER BY query_id, rank, result_id) AS rn FROM hits) WHERE rn = 1) USING (node_id)"""),
)
def h1b(t):
    return net(t).nodes.select("node_id", "node_type", "label", "title")


@register(
    "h1c_decay_weights",
    net_sql("""SELECT 'query_' || CAST(query_id AS VARCHAR) AS src, node_id AS dst, round(exp(-max(rank) / 10.0), 6) AS weight
               FROM (SELECT query_id, rank, sanitize AS node_id FROM (SELECT r.query_id, r.rank, """
            + q.sanitized("'website_' || r.url")
            + """ AS sanitize FROM hits r)) JOIN search_queries USING (query_id) WHERE session_id IN (1, 2)
               GROUP BY query_id, node_id"""),
)
def h1c(t):
    graph = build.query_website_network(
        t.search_queries, t.search_results, [1, 2], weight="exponential_decay", by_domain=False
    )
    return graph.edges.select("src", "dst", F.round("weight", 6).alias("weight"))


# -- keyword and entity networks -----------------------------------------------------------------

_DONE = """SELECT c.* FROM website_content c JOIN scraping_jobs j ON c.job_id = j.job_id
           WHERE c.status = 'success' AND j.status = 'completed'"""


def _keyword_sql(site: str, top: int) -> dict:
    return {
        "done": _DONE,
        "grouped": f"""SELECT {site} AS site, lemma, CAST(sum(frequency) AS BIGINT) AS frequency,
                         avg(tfidf_score) AS w, count(*) AS content_count
                       FROM extracted_keywords JOIN done USING (content_id) GROUP BY {site}, lemma""",
        "edges": f"""SELECT {q.sanitized("'website_' || site")} AS src, {q.sanitized("'keyword_' || lemma")} AS dst,
                       w AS weight, frequency, content_count, site, lemma
                     FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY w DESC, lemma) AS rn FROM grouped)
                     WHERE rn <= {top}""",
    }


def keyword_net(t, top=20, by_domain=True) -> Graph:
    contents = build.completed_contents(t.website_content, t.scraping_jobs)
    return build.website_keyword_network(contents, t.extracted_keywords, top=top, method="tfidf", by_domain=by_domain)


_KW_ROLES = ("extracted_keywords", "website_content", "scraping_jobs")


@register(
    "h2_website_keyword_network",
    with_roles(*_KW_ROLES, **_keyword_sql("domain", 20),
               body="""SELECT src, dst, round(weight, 6) AS weight, frequency, content_count FROM edges
                       WHERE weight >= 0.05"""),
)
def h2(t):
    contents = build.completed_contents(t.website_content, t.scraping_jobs)
    graph = build.website_keyword_network(contents, t.extracted_keywords, top=20, min_score=0.05, method="tfidf")
    return graph.edges.select("src", "dst", F.round("weight", 6).alias("weight"), "frequency", "content_count")


@register(
    "h2b_url_keyword_network",
    with_roles(
        *_KW_ROLES, **_keyword_sql("page_url", 5),
        body=f"""SELECT src AS a, dst AS b, round(weight, 6) AS weight FROM edges
                 UNION ALL SELECT DISTINCT src, 'node', 0.0 FROM edges""",
    ),
)
def h2b(t):
    graph = keyword_net(t, 5, by_domain=False)
    edges = graph.edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.round("weight", 6).alias("weight"))
    sites = graph.nodes.filter("node_type = 'website'").select(
        F.col("node_id").alias("a"), F.lit("node").alias("b"), F.lit(0.0).alias("weight")
    )
    return edges.unionByName(sites)


@register(
    "h2c_node_attributes",
    with_roles(*_KW_ROLES, **_keyword_sql("page_url", 5),
               body=f"""SELECT dst AS node_id, 'keyword' AS node_type, min(lemma) AS label, 'tfidf' AS extraction_method, min(language) AS language,
                          1::BIGINT AS phrase_length, NULL AS url, NULL AS domain FROM edges JOIN (SELECT page_url, lemma AS l, min(k.language) AS language
                            FROM extracted_keywords k JOIN done USING (content_id) GROUP BY ALL) ON page_url = site AND l = lemma GROUP BY dst
                        UNION ALL SELECT DISTINCT src, 'website', site, NULL, NULL, NULL, site, {q.netloc('site')} FROM edges"""),
)
def h2c(t):
    return keyword_net(t, 5, by_domain=False).nodes.select(
        "node_id", "node_type", "label", "extraction_method", "language", "phrase_length", "url", "domain"
    )


def entities_table(t):
    """Entity rows per content, text and label, with the share of two extraction methods."""
    return (
        t.mentions.groupBy("content_id", "text", "label")
        .agg(F.count(F.lit(1)).alias("frequency"), F.avg("confidence").alias("confidence"))
        .withColumn("extraction_method", F.when(F.col("content_id") % 5 == 0, "transformer").otherwise("spacy"))
    )


_ENT_LABELS = ("CLICK", "PURCHASE", "VIEW")


def entity_net(t) -> Graph:
    contents = build.completed_contents(t.website_content, t.scraping_jobs)
    return build.website_entity_network(
        contents, entities_table(t), _ENT_LABELS, top=15, threshold=0.01, min_confidence=0.05, method="spacy"
    )


_ENTITY_SQL = {
    "done": _DONE,
    "ents": """SELECT content_id, m.text, label, count(*) AS frequency, avg(confidence) AS confidence
               FROM mentions m GROUP BY ALL""",
    "grouped": """SELECT domain AS site, e.text, label, CAST(sum(frequency) AS BIGINT) AS frequency,
                    avg(confidence) AS confidence
                  FROM ents e JOIN done USING (content_id)
                  WHERE content_id % 5 <> 0 AND label IN ('CLICK', 'PURCHASE', 'VIEW') AND confidence >= 0.01
                  GROUP BY domain, e.text, label""",
    "edges": f"""SELECT {q.sanitized("'website_' || site")} AS src,
                   {q.sanitized("'entity_' || label || '_' || text")} AS dst, confidence * frequency AS weight,
                   frequency, confidence, text, label
                 FROM (SELECT *, row_number() OVER (PARTITION BY site
                         ORDER BY round(confidence * frequency, 9) DESC, text, label) AS rn FROM grouped)
                 WHERE rn <= 15 AND confidence >= 0.05""",
}
_ENT_ROLES = ("mentions", "website_content", "scraping_jobs")


@register(
    "h3_website_entity_network",
    with_roles(*_ENT_ROLES, **_ENTITY_SQL,
               body="""SELECT src, dst, round(weight, 6) AS weight, frequency, round(confidence, 6) AS confidence
                       FROM edges"""),
)
def h3(t):
    return entity_net(t).edges.select(
        "src", "dst", F.round("weight", 6).alias("weight"), "frequency", F.round("confidence", 6).alias("confidence")
    )


_DEGREE_SQL = {
    "deg": """SELECT n.node_id, n.node_type, n.label, count(e.weight) AS degree,
                coalesce(avg(e.weight), 0.0) AS avg_weight
              FROM nodes n LEFT JOIN (SELECT src AS node_id, weight FROM edges UNION ALL SELECT dst, weight FROM edges) e
                ON n.node_id = e.node_id GROUP BY ALL"""
}


@register(
    "h4_top_nodes",
    net_sql("""SELECT * FROM (SELECT node_id, label, degree, round(avg_weight, 6) AS avg_weight FROM deg
               WHERE node_type = 'website' ORDER BY degree DESC, node_id LIMIT 20)""", **_DEGREE_SQL),
)
def h4(t):
    return metrics.top_nodes(net(t), "website", 20).select(
        "node_id", "label", "degree", F.round("avg_weight", 6).alias("avg_weight")
    )


@register(
    "h4b_top_keywords",
    with_roles(*_KW_ROLES, **_keyword_sql("domain", 20),
               body="""SELECT dst AS node_id, min(lemma) AS label, count(*) AS degree, round(avg(weight), 6) AS avg_weight
                       FROM edges GROUP BY dst ORDER BY degree DESC, dst LIMIT 20"""),
)
def h4b(t):
    return metrics.top_nodes(keyword_net(t), "keyword", 20).select(
        "node_id", "label", "degree", F.round("avg_weight", 6).alias("avg_weight")
    )


@register(
    "h4c_top_entities",
    with_roles(*_ENT_ROLES, **_ENTITY_SQL,
               body="""SELECT dst AS node_id, min(text) AS label, min(label) AS category, count(*) AS degree,
                         round(avg(weight), 6) AS avg_weight FROM edges GROUP BY dst ORDER BY degree DESC, dst LIMIT 20"""),
)
def h4c(t):
    return metrics.top_nodes(entity_net(t), "entity", 20).select(
        "node_id", "label", "category", "degree", F.round("avg_weight", 6).alias("avg_weight")
    )


@register(
    "h5_entity_label_counts",
    with_roles(*_ENT_ROLES, **_ENTITY_SQL,
               body="SELECT label AS category, count(DISTINCT dst) AS n_nodes FROM edges GROUP BY label"),
)
def h5(t):
    return metrics.category_counts(entity_net(t))


_URL_LINKS = """SELECT DISTINCT r.query_id, r.url AS site FROM search_results r JOIN search_queries s
                ON r.query_id = s.query_id WHERE s.status = 'completed'"""
_PAIRS_SQL = {
    "links": _URL_LINKS,
    "sizes": "SELECT query_id, count(*) AS size FROM links GROUP BY query_id",
    "shared": """SELECT a.query_id AS q1, b.query_id AS q2, count(*) AS shared FROM links a JOIN links b
                 ON a.site = b.site AND a.query_id < b.query_id GROUP BY ALL""",
    "scored": """SELECT q1, q2, shared, shared / (s1.size + s2.size - shared) AS jaccard FROM shared
                 JOIN sizes s1 ON q1 = s1.query_id JOIN sizes s2 ON q2 = s2.query_id""",
}


def _overlap(t) -> QueryOverlap:
    done = t.search_queries.filter("status = 'completed'").select("query_id")
    links = t.search_results.select("query_id", F.col("url").alias("site")).join(done, "query_id", "left_semi")
    return QueryOverlap(done, links)


@register(
    "h6_query_overlap",
    with_roles(*_ROLES, **_PAIRS_SQL,
               body="""SELECT q1, q2, shared, round(jaccard, 6) AS jaccard FROM scored
                       ORDER BY shared DESC, q1, q2 LIMIT 20"""),
)
def h6(t):
    return _overlap(t).top_pairs().withColumn("jaccard", F.round("jaccard", 6))


@register(
    "h6b_overlap_summary",
    with_roles(
        *_ROLES, **_PAIRS_SQL,
        body="""SELECT CAST((n * (n - 1) - z * (z - 1)) / 2 AS BIGINT) AS total_comparisons,
                  round((SELECT sum(jaccard) FROM scored) / ((n * (n - 1) - z * (z - 1)) / 2), 9) AS avg_jaccard
                FROM (SELECT count(*) AS n, count(*) - (SELECT count(*) FROM sizes) AS z FROM search_queries
                      WHERE status = 'completed')""",
    ),
)
def h6b(t):
    return _overlap(t).summary().withColumn("avg_jaccard", F.round("avg_jaccard", 9))


@register(
    "h7_normalized_weights",
    net_sql("""SELECT src, dst, round((weight - lo) / (hi - lo), 6) AS weight FROM edges,
               (SELECT min(weight) AS lo, max(weight) AS hi FROM edges)"""),
)
def h7(t):
    return metrics.normalize_weights(net(t)).edges.select("src", "dst", F.round("weight", 6).alias("weight"))


def _mixed(t) -> Graph:
    """The query-website network plus one wrong edge per session: its smallest to its largest query."""
    graph = net(t)
    wrong = (
        t.search_queries.filter("status = 'completed'")
        .groupBy("session_id")
        .agg(F.min("query_id").alias("a"), F.max("query_id").alias("b"))
        .select(
            F.concat(F.lit("query_"), F.col("a").cast("string")).alias("src"),
            F.concat(F.lit("query_"), F.col("b").cast("string")).alias("dst"),
            F.lit(1.0).alias("weight"),
        )
    )
    return Graph(graph.nodes, graph.edges.select("src", "dst", "weight").unionByName(wrong))


@register(
    "h8_bipartite_violations",
    net_sql("""SELECT 'edge inside a type' AS problem, 'query' AS detail, count(DISTINCT session_id) AS n
               FROM search_queries WHERE status = 'completed'
               UNION ALL SELECT 'unexpected node type', 'query', count(*) FROM nodes WHERE node_type = 'query'"""),
)
def h8(t):
    return metrics.bipartite_violations(_mixed(t), ("website", "keyword"))


@register(
    "h9_bipartite_sets",
    with_roles(
        *_KW_ROLES, **_keyword_sql("domain", 20),
        body=f"""SELECT 'keyword' AS node_type, count(DISTINCT dst) AS n FROM edges
                 UNION ALL SELECT 'website', count(DISTINCT {q.sanitized("'website_' || domain")}) FROM done""",
    ),
)
def h9(t):
    return metrics.bipartite_sets(keyword_net(t)).groupBy("node_type").agg(F.count(F.lit(1)).alias("n"))


# Components by repeated minimum over neighbours; enough rounds for the small diameters here.
def _component_sql(edges: str, nodes: str, rounds: int = 30) -> dict:
    return {
        "ways": f"SELECT src AS a, dst AS b FROM {edges} UNION ALL SELECT dst, src FROM {edges}",
        "lab": f"""SELECT node_id, node_id AS component, 0 AS i FROM {nodes}
                   UNION ALL
                   SELECT node_id, min(component), min(i) + 1 FROM (
                     SELECT node_id, component, i FROM lab WHERE i < {rounds}
                     UNION ALL SELECT w.a, l.component, l.i FROM lab l JOIN ways w ON w.b = l.node_id WHERE l.i < {rounds})
                   GROUP BY node_id""",
        "comp": f"SELECT node_id, component FROM lab WHERE i = {rounds}",
    }


CUT_SQL = {
    **_sig_sql(),
    "kept_nodes": "SELECT DISTINCT node AS node_id FROM (SELECT src AS node FROM kept UNION ALL SELECT dst FROM kept)",
}


def net_saved(t) -> Graph:
    """The network with its edges written once, for queries that read them several times."""
    graph = net(t)
    return Graph(graph.nodes, materialize(graph.edges))


def cut(t) -> Graph:
    return backbone.disparity_filter(net_saved(t), ALPHA)


def cut_saved(t) -> Graph:
    graph = cut(t)
    edges = materialize(graph.edges.select("src", "dst", "weight"))
    nodes = graph.with_edges(edges).nodes.select("node_id", "node_type", "label")
    return Graph(materialize(nodes), edges)


def whole_saved(t) -> Graph:
    """The whole network, its nodes and edges written once with what the measures need."""
    graph = net(t)
    return Graph(materialize(graph.nodes.select("node_id", "node_type", "label")), materialize(graph.edges.select("src", "dst", "weight")))


@register(
    "h10_statistics",
    net_sql("""SELECT metric, round(CAST(value AS DOUBLE), 6) AS value FROM (
      SELECT unnest(['nodes', 'density', 'avg_degree', 'min_degree', 'max_degree']) AS metric,
        unnest([count(*), 2.0 * (SELECT count(*) FROM edges) / (count(*) * (count(*) - 1)), avg(d), min(d), max(d)]) AS value
      FROM (SELECT n.node_id, count(e.node) AS d FROM nodes n
              LEFT JOIN (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) e ON e.node = n.node_id GROUP BY n.node_id)
      UNION ALL
      SELECT unnest(['edges', 'avg_weight', 'min_weight', 'max_weight', 'total_weight']),
        unnest([count(*), avg(weight), min(weight), max(weight), sum(weight)]) FROM edges
      UNION ALL SELECT 'type:' || node_type, count(*) FROM nodes  GROUP BY node_type
      UNION ALL SELECT unnest(['components', 'largest', 'largest_share']),
        unnest([count(*), max(size), max(size) / sum(size)]) FROM (SELECT count(*) AS size FROM comp GROUP BY component))""",
            **_component_sql("edges", "nodes")),
)
def h10(t):
    graph = whole_saved(t)
    sizes = iterative.component_sizes(iterative.connected_components(graph))
    return metrics.statistics(graph, sizes).withColumn("value", F.round("value", 6))


@register(
    "h11_components",
    net_sql("SELECT node_id, component FROM comp", **_component_sql("edges", "nodes")),
)
def h11(t):
    return iterative.connected_components(whole_saved(t))


_PROJ_SQL = {
    "proj": """SELECT a.dst AS a, b.dst AS b, count(*) AS weight FROM edges a JOIN edges b
               ON a.src = b.src AND a.dst < b.dst GROUP BY ALL"""
}


@register("h12_projection", net_sql("SELECT a, b, weight FROM proj", **_PROJ_SQL))
def h12(t):
    return metrics.project(net_saved(t), "website")


@register(
    "h13_degree_centrality",
    net_sql("SELECT node_id, round(degree / ((SELECT count(*) FROM nodes) - 1), 9) AS centrality FROM deg", **_DEGREE_SQL),
)
def h13(t):
    return metrics.degree_centrality(net(t)).withColumn("centrality", F.round("centrality", 9))


def _bfs_sql(edges: str = "edges", nodes: str = "kn", depth: int = 14) -> dict:
    """Shortest path lengths and counts, one common table expression per level."""
    out = {
        "ways": f"SELECT src AS a, dst AS b FROM {edges} UNION ALL SELECT dst, src FROM {edges}",
        "r0": f"SELECT node_id AS s, node_id AS v, 0 AS d, 1.0::DOUBLE AS p FROM {nodes}",
        "f0": "SELECT * FROM r0",
    }
    for k in range(1, depth + 1):
        out[f"f{k} AS MATERIALIZED"] = f"""SELECT f.s, w.b AS v, {k} AS d, sum(f.p) AS p FROM f{k - 1} f
            JOIN ways w ON w.a = f.v WHERE NOT EXISTS (SELECT 1 FROM r{k - 1} r WHERE r.s = f.s AND r.v = w.b) GROUP BY ALL"""
        out[f"r{k} AS MATERIALIZED"] = f"SELECT * FROM r{k - 1} UNION ALL SELECT * FROM f{k}"
    out["paths"] = f"SELECT * FROM r{depth}"
    return out


def _credit_sql(nodes: str = "kn", depth: int = 14) -> dict:
    """Brandes' accumulation over the levels of ``_bfs_sql``, from the farthest to the nearest."""
    out = {f"c{depth + 1} AS MATERIALIZED": "SELECT s, v, 0.0::DOUBLE AS delta FROM paths LIMIT 0"}
    for k in range(depth, 0, -1):
        out[f"c{k} AS MATERIALIZED"] = f"""SELECT n.s, n.v, sum(n.p * (1 + coalesce(c.delta, 0)) / f.p) AS delta
            FROM f{k} f LEFT JOIN c{k + 1} c ON c.s = f.s AND c.v = f.v JOIN ways w ON w.b = f.v
            JOIN f{k - 1} n ON n.s = f.s AND n.v = w.a GROUP BY n.s, n.v"""
    every = " UNION ALL ".join(f"SELECT * FROM c{k}" for k in range(1, depth + 1))
    return {**out, "dependency": f"SELECT v AS node_id, sum(delta) AS c FROM ({every}) WHERE s <> v GROUP BY v"}


_KN = f"""SELECT DISTINCT {q.sanitized("'website_' || domain")} AS node_id FROM done UNION SELECT DISTINCT dst FROM edges"""


def _kw_sql(body: str, top: int, **more: str) -> str:
    ctes = {**_keyword_sql("domain", top), "kn": _KN, **more}
    return with_roles(*_KW_ROLES, **ctes, body=body).replace("AS MATERIALIZED AS (", "AS MATERIALIZED (")


#: The builder's own number of keywords for a site.
KEYWORDS = 50


def saved_keyword_net(t) -> Graph:
    graph = keyword_net(t, KEYWORDS)
    return Graph(materialize(graph.nodes), materialize(graph.edges))


_CLOSENESS = """SELECT v AS node_id, round(CASE WHEN count(*) = 1 THEN 0.0 ELSE
      ((count(*) - 1.0) / sum(d)) * ((count(*) - 1.0) / ((SELECT count(*) FROM {nodes}) - 1)) END, 6) AS centrality FROM paths GROUP BY v"""
_BETWEENNESS = """SELECT n.node_id, round(coalesce(c, 0.0) / (((SELECT count(*) FROM {nodes}) - 1.0) * ((SELECT count(*) FROM {nodes}) - 2.0)), 6)
      AS centrality FROM {nodes} n LEFT JOIN dependency USING (node_id)"""


@register("h14_closeness", _kw_sql(_CLOSENESS.format(nodes="kn"), KEYWORDS, **_bfs_sql()))
def h14(t):
    return iterative.closeness(saved_keyword_net(t)).withColumn("centrality", F.round("centrality", 6))


@register("h15_betweenness", _kw_sql(_BETWEENNESS.format(nodes="kn"), KEYWORDS, **_bfs_sql(), **_credit_sql()))
def h15(t):
    return iterative.betweenness(saved_keyword_net(t)).withColumn("centrality", F.round("centrality", 6))


def _power_sql(edges: str, nodes: str) -> dict:
    return {
        "ways": f"SELECT src AS a, dst AS b FROM {edges} UNION ALL SELECT dst, src FROM {edges}",
        "power": f"""SELECT 0 AS i, node_id, 1.0::DOUBLE / (SELECT count(*) FROM {nodes}) AS x FROM {nodes}
                UNION ALL
                SELECT i + 1, node_id, y / sqrt(sum(y * y) OVER ()) FROM (
                  SELECT min(i) AS i, node_id, sum(x) AS y FROM (
                    SELECT i, node_id, x FROM power WHERE i < 100
                    UNION ALL SELECT i, w.a, p.x FROM power p JOIN ways w ON w.b = p.node_id WHERE i < 100)
                  GROUP BY node_id)""",
        "change": """SELECT a.i, sum(abs(a.x - b.x)) AS c FROM power a JOIN power b ON a.node_id = b.node_id AND b.i = a.i - 1
                     GROUP BY a.i""",
    }


_EIGENVECTOR = """SELECT node_id, round(x, 6) AS centrality FROM power
    WHERE i = (SELECT min(i) FROM change WHERE c < (SELECT count(*) FROM {nodes}) * 1e-6)"""


def _eigenvector(graph: Graph):
    found = iterative.eigenvector(graph)
    if found is None:
        found = graph.nodes.select("node_id", F.lit(None).cast("double").alias("centrality")).limit(0)
    return found.withColumn("centrality", F.round("centrality", 6))


# The whole query-site network does not converge in the rule's 100 rounds: it has no result.
@register("h16_eigenvector", _kw_sql(_EIGENVECTOR.format(nodes="kn"), KEYWORDS, **_power_sql("edges", "kn")))
def h16(t):
    return _eigenvector(saved_keyword_net(t))


@register("h17_disparity_filter", net_sql("SELECT src, dst, round(weight, 6) AS weight, rank FROM kept", **_sig_sql()))
def h17(t):
    return cut(t).edges.select("src", "dst", F.round("weight", 6).alias("weight"), "rank")


@register(
    "h18_edge_significance",
    net_sql("""SELECT src, dst, round(alpha_src, 6) AS alpha_src, round(alpha_dst, 6) AS alpha_dst,
               round(greatest(alpha_src, alpha_dst), 6) AS alpha FROM sig""", **_sig_sql()),
)
def h18(t):
    return backbone.edge_significance(net_saved(t)).select(
        "src", "dst", *[F.round(c, 6).alias(c) for c in ("alpha_src", "alpha_dst", "alpha")]
    )


@register(
    "h19_threshold_filter",
    net_sql("""SELECT 'edge' AS kind, src AS a, dst AS b FROM edges WHERE weight >= 0.5
               UNION ALL SELECT 'node', node_id, node_type FROM nodes WHERE node_id IN
                 (SELECT src FROM edges WHERE weight >= 0.5 UNION SELECT dst FROM edges WHERE weight >= 0.5)"""),
)
def h19(t):
    graph = backbone.threshold_filter(net_saved(t), 0.5)
    edges = graph.edges.select(F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"))
    return edges.unionByName(graph.nodes.select(F.lit("node").alias("kind"), F.col("node_id").alias("a"),
                                                F.col("node_type").alias("b")))


@register(
    "h20_top_k_filter",
    net_sql("SELECT src, dst, round(weight, 6) AS weight FROM edges ORDER BY weight DESC, src, dst LIMIT 500"),
)
def h20(t):
    return backbone.top_k_filter(net(t), 500).edges.select("src", "dst", F.round("weight", 6).alias("weight"))


@register(
    "h21_backbone_statistics",
    net_sql("""SELECT algorithm, original_nodes, original_edges, backbone_nodes, backbone_edges,
                 original_nodes - backbone_nodes AS nodes_removed, original_edges - backbone_edges AS edges_removed,
                 round(backbone_edges / original_edges, 6) AS edge_retention_rate
               FROM (SELECT 'disparity_filter' AS algorithm, (SELECT count(*) FROM nodes) AS original_nodes,
                 (SELECT count(*) FROM edges) AS original_edges, (SELECT count(*) FROM kept_nodes) AS backbone_nodes,
                 (SELECT count(*) FROM kept) AS backbone_edges)""", **CUT_SQL),
)
def h21(t):
    graph = net_saved(t)
    kept = backbone.apply_backbone(graph, "disparity_filter", alpha=ALPHA)
    kept = graph.with_edges(materialize(kept.edges))
    return backbone.retention(graph, kept, "disparity_filter").withColumn("edge_retention_rate", F.round("edge_retention_rate", 6))


@register(
    "h22_node_colors",
    net_sql("SELECT node_id, CASE node_type WHEN 'query' THEN '#000000' ELSE '#2ecc71' END AS color FROM nodes"),
)
def h22(t):
    return style.node_colors(net(t), {"query": "#000000"})


@register(
    "h23_node_sizes",
    net_sql("""SELECT node_id, round(10 + (degree - lo) / (hi - lo) * 90, 6) AS size FROM deg,
               (SELECT min(degree) AS lo, max(degree) AS hi FROM deg)""", **_DEGREE_SQL),
)
def h23(t):
    return style.node_sizes(net(t)).withColumn("size", F.round("size", 6))


@register(
    "h24_type_filter",
    with_roles(
        *_KW_ROLES, **_keyword_sql("domain", 20),
        body=f"""SELECT DISTINCT {q.sanitized("'website_' || domain")} AS node_id, 0::BIGINT AS n_edges FROM done""",
    ),
)
def h24(t):
    shown = filters.by_type(keyword_net(t), ["website"])
    return shown.nodes.select("node_id", shown.edges.agg(F.count(F.lit(1)).alias("n")).scalar().alias("n_edges"))


@register(
    "h25_label_filter",
    net_sql("SELECT node_id FROM nodes WHERE contains(lower(label), 'medium 1997')"),
)
def h25(t):
    return filters.by_label(net(t), "Medium 1997").nodes.select("node_id")


@register(
    "h26_giant_component",
    net_sql("""SELECT node_id FROM comp WHERE component = (SELECT component FROM comp GROUP BY component
               ORDER BY count(*) DESC, component LIMIT 1)""", **_component_sql("edges", "nodes")),
)
def h26(t):
    return filters.giant_component(whole_saved(t)).nodes.select("node_id")


@register(
    "h27_min_degree",
    net_sql("""SELECT src, dst FROM edges WHERE src IN (SELECT node_id FROM deg WHERE degree >= 6)
               AND dst IN (SELECT node_id FROM deg WHERE degree >= 6)""", **_DEGREE_SQL),
)
def h27(t):
    return filters.by_min_degree(net(t), 6).edges.select("src", "dst")


@register(
    "h28_quick_statistics",
    net_sql("""SELECT n AS nodes, m AS edges, round(2.0 * m / (n * (n - 1)), 9) AS density,
               round(2.0 * m / n, 6) AS average_degree
               FROM (SELECT (SELECT count(*) FROM nodes) AS n, (SELECT count(*) FROM edges) AS m)"""),
)
def h28(t):
    return metrics.quick_statistics(net(t)).select(
        "nodes", "edges", F.round("density", 9).alias("density"), F.round("average_degree", 6).alias("average_degree")
    )


def site_graph(t) -> Graph:
    """Sites linked when they share a query."""
    edges = materialize(metrics.project(net_saved(t), "website").select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight"))
    sites = t.search_results.select("domain").distinct()
    nodes = materialize(sites.select(
        build.node_identity(F.concat(F.lit("website_"), "domain")).alias("node_id"),
        F.lit("website").alias("node_type"), F.col("domain").alias("label")))
    return Graph(nodes, edges)


_SITE_SQL = {
    **_PROJ_SQL,
    "pe": "SELECT a AS src, b AS dst, weight FROM proj",
    "sites": f"SELECT DISTINCT {_SITE} AS node_id FROM search_results",
}


@register("h14b_site_closeness", net_sql(_CLOSENESS.format(nodes="sites"), **_SITE_SQL, **_bfs_sql("pe", "sites", 6)).replace(
    "AS MATERIALIZED AS (", "AS MATERIALIZED ("))
def h14b(t):
    return iterative.closeness(site_graph(t)).withColumn("centrality", F.round("centrality", 6))


@register("h15b_site_betweenness", net_sql(
    _BETWEENNESS.format(nodes="sites"), **_SITE_SQL, **_bfs_sql("pe", "sites", 6), **_credit_sql("sites", 6)).replace(
    "AS MATERIALIZED AS (", "AS MATERIALIZED ("))
def h15b(t):
    return iterative.betweenness(site_graph(t)).withColumn("centrality", F.round("centrality", 6))


@register("h16b_site_eigenvector", net_sql(_EIGENVECTOR.format(nodes="sites"), **_SITE_SQL, **_power_sql("pe", "sites")))
def h16b(t):
    return _eigenvector(site_graph(t))


@register(
    "h29_clustering",
    net_sql("""SELECT n.node_id, coalesce(tri, 0) AS triangles,
                 round(CASE WHEN coalesce(d, 0) < 2 THEN 0.0 ELSE 2.0 * coalesce(tri, 0) / (d * (d - 1)) END, 6) AS clustering
               FROM (SELECT node_id, node_id AS v FROM sites) n LEFT JOIN (SELECT v, count(*) AS d FROM pw GROUP BY v) USING (v)
               LEFT JOIN (SELECT x.v, count(*) AS tri FROM pw x JOIN pw y ON x.v = y.v AND x.w < y.w
                 JOIN pw z ON z.v = x.w AND z.w = y.w GROUP BY x.v) USING (v)""",
            **_SITE_SQL, pw="SELECT src AS v, dst AS w FROM pe UNION ALL SELECT dst, src FROM pe"),
)
def h29(t):
    return metrics.clustering(site_graph(t)).withColumn("clustering", F.round("clustering", 6))


def _follow_graph(t):
    """Directed: a site to every site that follows it as the next result of a query."""
    current = t.search_results.select("query_id", "rank", F.col("domain").alias("src"))
    following = t.search_results.select("query_id", (F.col("rank") - 1).alias("rank"), F.col("domain").alias("dst"))
    edges = materialize(current.join(following, ["query_id", "rank"]).where("src <> dst").select("src", "dst").distinct())
    return edges.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct(), edges


_FOLLOW_SQL = {
    "steps": """SELECT DISTINCT a.domain AS src, b.domain AS dst FROM search_results a JOIN search_results b
                ON a.query_id = b.query_id AND b.rank = a.rank + 1 WHERE a.domain <> b.domain""",
    "reach": "SELECT src, dst FROM steps UNION SELECT r.src, b.dst FROM reach r JOIN steps b ON r.dst = b.src",
    "everyone": "SELECT src AS node_id FROM steps UNION SELECT dst FROM steps",
}
_STRONG = """SELECT e.node_id, greatest(e.node_id, coalesce(max(f.dst), e.node_id)) AS component FROM everyone e
    LEFT JOIN (SELECT x.src, x.dst FROM reach x JOIN reach y ON x.src = y.dst AND x.dst = y.src) f ON f.src = e.node_id GROUP BY e.node_id"""


@register("h29b_strong_components", with_roles("search_results", **_FOLLOW_SQL, body=_STRONG))
def h29b(t):
    return iterative.strong_components(*_follow_graph(t))


@register(
    "h30_attach_centrality",
    net_sql("""SELECT node_id, node_type, round(degree / ((SELECT count(*) FROM nodes) - 1), 9) AS degree_centrality
               FROM deg""", **_DEGREE_SQL),
)
def h30(t):
    graph = net(t)
    tagged = metrics.attach(graph, iterative.centrality(graph, "degree"), "degree_centrality")
    return tagged.nodes.select("node_id", "node_type", F.round("degree_centrality", 9).alias("degree_centrality"))


@register(
    "h31_network_job",
    net_sql("""SELECT 'issue map' AS name, 'search_website' AS type, '1,2,3,4,5' AS session_ids, 'gexf' AS format,
                 TRUE AS backboning_applied, 'disparity_filter' AS backboning_algorithm,
                 (SELECT count(*) FROM kept_nodes) AS node_count, (SELECT count(*) FROM kept) AS edge_count,
                 (SELECT count(*) FROM edges) AS original_edge_count,
                 round((SELECT count(*) FROM kept) / (SELECT count(*) FROM edges), 6) AS edge_retention_rate""", **CUT_SQL),
)
def h31(t):
    path = f"{run_folder(t.spark)}/exports-{uuid.uuid4().hex}"
    row = job.run_network_job(
        net(t), "issue map", "search_website", (1, 2, 3, 4, 5), path, algorithm="disparity_filter", alpha=ALPHA
    )
    return row.withColumn("edge_retention_rate", F.round("edge_retention_rate", 6))


@register(
    "h32_two_colorable",
    net_sql("""SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges,
                 (SELECT count(*) FROM edges WHERE NOT starts_with(src, 'query_') OR NOT starts_with(dst, 'website_')) = 0
                   AS two_colorable"""),
)
def h32(t):
    graph = whole_saved(t)
    return metrics.quick_statistics(graph).select(
        "nodes", "edges", F.lit(iterative.is_two_colorable(graph)).alias("two_colorable")
    )
