"""Source and sink queries."""

import uuid

from pyspark.sql import functions as F

from mapweave.operators.networks import metrics, style
from mapweave.operators.networks.graph import Graph
from mapweave.plans import sqlkit as q
from mapweave.plans.networks import CUT_SQL, cut, cut_saved, net_sql
from mapweave.plans.registry import register
from mapweave.plans.roles import with_roles
from mapweave.session import materialize, run_folder
from mapweave.sources import bulk, bulk_write, exports, gexf, payloads

@register(
    "a1_table_scan",
    with_roles("session_results", body="""SELECT query_id, rank, domain, url FROM session_results
               WHERE session_id IN (1, 2) AND status = 'completed' AND rank <= 3"""),
)
def a1(t):
    return t.session_results.filter("session_id IN (1, 2) AND status = 'completed' AND rank <= 3").select(
        "query_id", "rank", "domain", "url"
    )


_BULK_SQL = """SELECT o_custkey AS file_id, o_orderkey AS line, CASE WHEN o_orderkey % 23 = 0 THEN '  ' ELSE
      ' topic ' || lower(substr(o_orderpriority, 3)) || ' ' END AS query,
    CASE WHEN o_orderkey % 3 = 0 THEN 'activist ' END AS framing, CASE WHEN o_orderkey % 4 = 0 THEN 'da' END AS language,
    CASE o_orderkey % 5 WHEN 0 THEN 'many' WHEN 1 THEN CAST(o_orderkey % 130 AS VARCHAR) WHEN 2 THEN '20' END AS max_results,
    CASE o_orderkey % 6 WHEN 0 THEN '.dk|com' WHEN 1 THEN '.dk|.com' END AS tld_filter,
    CASE o_orderkey % 7 WHEN 0 THEN 'Serper' WHEN 1 THEN 'altavista' END AS search_engine FROM orders"""


def bulk_lines(t):
    k = F.col("o_orderkey")
    return t.orders.select(
        F.col("o_custkey").alias("file_id"), k.alias("line"),
        F.when(k % 23 == 0, "  ").otherwise(F.concat(F.lit(" topic "), F.lower(F.expr("substring(o_orderpriority, 3)")), F.lit(" "))).alias("query"),
        F.when(k % 3 == 0, "activist ").alias("framing"),
        F.when(k % 4 == 0, "da").alias("language"),
        F.when(k % 5 == 0, "many").when(k % 5 == 1, (k % 130).cast("string")).when(k % 5 == 2, "20").alias("max_results"),
        F.lit(None).cast("string").alias("date_from"), F.lit(None).cast("string").alias("date_to"),
        F.when(k % 6 == 0, ".dk|com").when(k % 6 == 1, ".dk|.com").alias("tld_filter"),
        F.when(k % 7 == 0, "Serper").when(k % 7 == 1, "altavista").alias("search_engine"),
    )


@register(
    "a2_bulk_validation",
    f"""SELECT file_id, line, concat_ws('; ', CASE WHEN trim(query) = '' THEN 'Query is required' END,
          CASE WHEN max_results = 'many' THEN 'max_results must be a number'
               WHEN CAST(nullif(max_results, 'many') AS INT) NOT BETWEEN 1 AND 100 THEN 'max_results must be between 1 and 100' END,
          CASE WHEN search_engine = 'altavista' THEN 'search_engine must be one of: google_custom, serper, serpapi_google' END,
          CASE WHEN tld_filter = '.dk|com' THEN 'TLD ''com'' must start with a dot (e.g., ''.dk'')' END) AS errors
        FROM ({_BULK_SQL})""",
)
def a2(t):
    return bulk.validate(bulk_lines(t)).select("file_id", "line", F.array_join("errors", "; ").alias("errors"))


@register(
    "a2b_bulk_status",
    f"""SELECT file_id, count(*) AS row_count, count(*) FILTER (bad) AS invalid_rows,
          CASE WHEN count(*) FILTER (bad) > 0 THEN 'invalid' ELSE 'valid' END AS validation_status
        FROM (SELECT file_id, trim(query) = '' OR coalesce(max_results = 'many', FALSE)
                OR coalesce(CAST(nullif(max_results, 'many') AS INT) NOT BETWEEN 1 AND 100, FALSE)
                OR coalesce(search_engine = 'altavista', FALSE) OR coalesce(tld_filter = '.dk|com', FALSE) AS bad
              FROM ({_BULK_SQL})) GROUP BY file_id""",
)
def a2b(t):
    return bulk.validation_status(bulk.validate(bulk_lines(t)), "file_id")


@register(
    "a3_bulk_rows",
    f"""SELECT file_id, line, trim(query) AS query, trim(coalesce(framing, 'neutral')) AS framing, coalesce(language, 'en') AS language,
          coalesce(TRY_CAST(max_results AS BIGINT), 10) AS max_results, lower(coalesce(search_engine, 'google_custom')) AS search_engine,
          replace(tld_filter, '|', ',') AS tlds FROM ({_BULK_SQL})
        QUALIFY bool_and(trim(query) <> '' AND coalesce(max_results <> 'many', TRUE)
          AND coalesce(TRY_CAST(max_results AS INT) BETWEEN 1 AND 100, TRUE)
          AND coalesce(search_engine <> 'altavista', TRUE) AND coalesce(tld_filter <> '.dk|com', TRUE)) OVER (PARTITION BY file_id)""",
)
def a3(t):
    checked = bulk.validate(bulk_lines(t))
    # rows of a file with one bad row are not stored
    valid = bulk.validation_status(checked, "file_id").filter("validation_status = 'valid'").select("file_id")
    return bulk.normalize(checked.join(valid, "file_id", "left_semi")).select(
        "file_id", "line", "query", "framing", "language", "max_results", "search_engine",
        F.array_join("tld_filter", ",").alias("tlds"),
    )


# The same lines in files: a folder for each remainder of the file's number, a line break and quotes in some queries.
_FILES_SQL = f"""SELECT file_id % 97 AS folder, row_number() OVER (PARTITION BY file_id % 97 ORDER BY line) - 1 AS row_number,
      CASE WHEN line % 10 = 0 THEN query || chr(10) || '"x", ' || query ELSE query END AS query, framing, language, max_results, tld_filter, search_engine,
      trim(query) = '' OR coalesce(max_results = 'many', FALSE) OR coalesce(CAST(nullif(max_results, 'many') AS INT) NOT BETWEEN 1 AND 100, FALSE)
        OR coalesce(search_engine = 'altavista', FALSE) OR coalesce(tld_filter = '.dk|com', FALSE) AS bad
    FROM ({_BULK_SQL}) WHERE file_id % 97 >= 5 OR NOT (line % 23 = 0 OR line % 5 IN (0, 1) OR line % 6 = 0 OR line % 7 = 1)"""


def bulk_files(t) -> str:
    """The lines written as CSV files, those of a file in order; returns their folder."""
    lines, k = bulk_lines(t), F.col("line")
    fine = ~((k % 23 == 0) | (k % 5).isin(0, 1) | (k % 6 == 0) | (k % 7 == 1))
    rows = lines.withColumn("folder", F.col("file_id") % 97).filter((F.col("folder") >= 5) | fine).withColumn(
        "query", F.when(k % 10 == 0, F.concat("query", F.lit('\n"x", '), "query")).otherwise(F.col("query")))
    path = f"{run_folder(t.spark)}/bulk-{uuid.uuid4().hex}"
    dealt = rows.repartition("folder").sortWithinPartitions("folder", "line").select("folder", *bulk.COLUMNS)
    dealt.write.partitionBy("folder").option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False).csv(path)
    return path


def _folder():
    return F.regexp_extract("file", "folder=([0-9]+)", 1).cast("bigint").alias("folder")


@register(
    "a2c_bulk_file_errors",
    f"""SELECT folder, 'row_' || (row_number + 2) AS row_key, md5(query) AS query_hash, bad FROM ({_FILES_SQL})""",
)
def a2c(t):
    checked = bulk.validate(bulk.read_bulk_csv(t.spark, bulk_files(t), range_bytes=20_000))
    return checked.select(_folder(), "row_key", F.md5("query").alias("query_hash"), (F.size("errors") > 0).alias("bad"))


@register(
    "a3b_stored_bulk_rows",
    f"""SELECT folder, row_number, trim(query) AS query, trim(coalesce(framing, 'neutral')) AS framing, coalesce(language, 'en') AS language,
          coalesce(TRY_CAST(max_results AS BIGINT), 10) AS max_results, lower(coalesce(search_engine, 'google_custom')) AS search_engine,
          replace(tld_filter, '|', ',') AS tlds FROM ({_FILES_SQL}) QUALIFY NOT bool_or(bad) OVER (PARTITION BY folder)""",
)
def a3b(t):
    stored, _ = bulk.stored_rows(t.spark, bulk_files(t), range_bytes=20_000)
    return stored.select(_folder(), "row_number", "query", "framing", "language", "max_results", "search_engine",
                         F.array_join("tld_filter", ",").alias("tlds"))


def _pages_of_results(t, size: int, item):
    """Payloads of ``size`` items: a query's results in rank order, page by page."""
    page = F.floor((F.col("rank") - 1) / size).cast("bigint")
    entry = F.struct("rank", item.alias("item"))
    return (
        t.search_results.groupBy("query_id", page.alias("page"))
        .agg(F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["item"]).alias("items"))
    )


_LINK_SQL = "CASE WHEN result_id % 11 = 0 THEN '' ELSE url END"
_TITLE_SQL = "CASE WHEN result_id % 13 = 0 THEN NULL ELSE title END"


def _item():
    rid = F.col("result_id")
    return F.struct(
        F.when(rid % 11 == 0, "").otherwise(F.col("url")).alias("link"),
        F.when(rid % 13 != 0, F.col("title")).alias("title"),
        F.col("description").alias("snippet"),
    )


@register(
    "a4_contiguous_payload",
    with_roles(
        "search_results",
        body=f"""SELECT query_id, rank, url, title, description, {q.netloc('url')} AS domain FROM (
                   SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank, url, title, description
                   FROM search_results WHERE result_id % 11 <> 0 AND result_id % 13 <> 0) WHERE rank <= 5""",
    ),
)
def a4(t):
    pages = _pages_of_results(t, 3, _item()).select(
        "query_id", "page", F.to_json(F.struct(F.col("items").alias("organic"))).alias("payload")
    )
    return payloads.parse_contiguous(pages, ["query_id"], "page", "payload", 5)


@register(
    "a4b_paged_payload",
    with_roles(
        "search_results",
        body=f"""SELECT query_id, rank, {_LINK_SQL} AS url, coalesce({_TITLE_SQL}, '') AS title, description,
                   {q.netloc(_LINK_SQL)} AS domain FROM search_results""",
    ),
)
def a4b(t):
    pages = _pages_of_results(t, 3, _item()).select(
        "query_id", "page", F.to_json(F.struct("items")).alias("payload")
    )
    return payloads.parse_paged(pages, ["query_id"], "page", "payload")


@register(
    "a5_positional_payload",
    with_roles(
        "search_results",
        body=f"""SELECT query_id, page, (rank - 1) % 10 + 1 AS rank, url, title, CASE WHEN result_id % 5 = 0 THEN title ELSE description END
                   AS description, {q.netloc('url')} AS domain
                 FROM (SELECT *, CAST(floor((rank - 1) / 10) AS BIGINT) AS page FROM search_results) WHERE result_id % 11 <> 0""",
    ),
)
def a5(t):
    rid = F.col("result_id")
    item = F.struct(
        F.when(rid % 2 == 0, F.when(rid % 11 == 0, "").otherwise(F.col("url"))).alias("link"),
        F.when(rid % 11 == 0, "").otherwise(F.col("url")).alias("url"),
        "title",
        F.when(rid % 5 != 0, F.col("description")).alias("snippet"),
        F.col("title").alias("description"),
    )
    pages = _pages_of_results(t, 10, item).select(
        "query_id", "page", F.to_json(F.struct(F.col("items").alias("organic_results"))).alias("payload")
    )
    return payloads.parse_positional(pages, ["query_id", "page"], "payload")


@register(
    "a6_csv_edges",
    net_sql("""SELECT a.label AS "Source", b.label AS "Target", round(weight, 6) AS "Weight" FROM kept
               JOIN nodes a ON a.node_id = src JOIN nodes b ON b.node_id = dst""", **CUT_SQL),
)
def a6(t):
    return exports.edge_rows(cut(t)).withColumn("Weight", F.round("Weight", 6))


def _fixed(graph: Graph) -> Graph:
    """All attributes of edges, and those of nodes that a query network has; weights with six digits."""
    return exports.fixed_digits(Graph(
        graph.nodes.select("node_id", "node_type", "label", "domain"),
        graph.edges.select("src", "dst", "weight", "rank", "n_results"),
    ))


_SLIM_SQL = {
    **CUT_SQL,
    "ke": """SELECT e.src, e.dst, e.rank, e.n_results, printf('%.6f', e.weight) AS weight
             FROM edges e JOIN kept k ON e.src = k.src AND e.dst = k.dst""",
    "kn": """SELECT node_id, node_type, label, CASE WHEN node_type = 'website' THEN label END AS domain FROM nodes
             WHERE node_id IN (SELECT node_id FROM kept_nodes)""",
}


@register(
    "a7_edge_list",
    net_sql("""SELECT src || chr(9) || dst || chr(9) || '{"weight":' || weight || ',"rank":' || rank || ',"n_results":' || n_results || '}' AS line
               FROM ke""", **_SLIM_SQL),
)
def a7(t):
    return exports.edge_list_lines(_fixed(cut(t)))


@register(
    "a8_node_link_json",
    net_sql("""SELECT unnest(['{"directed": false, "multigraph": false, "graph": {}, "nodes": [', '], "links": [', ']}']) AS line
               UNION ALL SELECT CASE WHEN node_id = (SELECT min(node_id) FROM kn) THEN '' ELSE ',' END || '{"id":"' || node_id ||
                 '","node_type":"' || node_type || '","label":"' || label || '"' ||
                 CASE WHEN domain IS NULL THEN '' ELSE ',"domain":"' || domain || '"' END || '}' FROM kn
               UNION ALL SELECT CASE WHEN src || chr(9) || dst = (SELECT min(src || chr(9) || dst) FROM ke) THEN '' ELSE ',' END ||
                 '{"source":"' || src || '","target":"' || dst || '","weight":' || weight || ',"rank":' || rank ||
                 ',"n_results":' || n_results || '}' FROM ke""", **_SLIM_SQL),
)
def a8(t):
    return exports.json_lines(_fixed(cut(t))).select("line")


def _xml_header(lines):
    return " UNION ALL ".join(f"SELECT '{x}' AS line" for x in lines)


@register(
    "a9_gexf",
    net_sql(
        _xml_header([
            '<?xml version="1.0" encoding="UTF-8"?>',
            '<gexf xmlns="http://www.gexf.net/1.2draft" xmlns:viz="http://www.gexf.net/1.2draft/viz" version="1.2">',
            '<graph defaultedgetype="undirected" mode="static">',
            '<attributes class="node" mode="static"><attribute id="0" title="node_type" type="string" />'
            '<attribute id="1" title="domain" type="string" /></attributes>',
            '<attributes class="edge" mode="static"><attribute id="0" title="rank" type="long" />'
            '<attribute id="1" title="n_results" type="long" /></attributes>',
            "<nodes>", "</nodes>", "<edges>", "</edges>", "</graph>", "</gexf>",
        ])
        + """ UNION ALL SELECT '<node id="' || node_id || '" label="' || label || '"><attvalues><attvalue for="0" value="' ||
                 node_type || '" />' || CASE WHEN domain IS NULL THEN '' ELSE '<attvalue for="1" value="' || domain || '" />' END
                 || '</attvalues></node>' FROM kn
              UNION ALL SELECT '<edge source="' || src || '" target="' || dst || '" weight="' || weight || '"><attvalues><attvalue for="0" value="' || rank
                 || '" /><attvalue for="1" value="' || n_results || '" /></attvalues></edge>' FROM ke""", **_SLIM_SQL),
)
def a9(t):
    return exports.gexf_lines(_fixed(cut(t))).select("line")


@register("a9b_gexf_visual")
def a9b(t):
    return exports.gexf_lines(cut_saved(t), visual=True, colors=style.TYPE_COLORS).select("line")


@register(
    "a10_graphml",
    net_sql(
        _xml_header([
            '<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">',
            '<key id="n0" for="node" attr.name="node_type" attr.type="string" />',
            '<key id="n1" for="node" attr.name="label" attr.type="string" />',
            '<key id="n2" for="node" attr.name="domain" attr.type="string" />',
            '<key id="e0" for="edge" attr.name="weight" attr.type="double" />',
            '<key id="e1" for="edge" attr.name="rank" attr.type="long" />',
            '<key id="e2" for="edge" attr.name="n_results" attr.type="long" />',
            '<graph edgedefault="undirected">', "</graph>", "</graphml>",
        ])
        + """ UNION ALL SELECT '<node id="' || node_id || '"><data key="n0">' || node_type || '</data><data key="n1">' || label ||
                 '</data>' || CASE WHEN domain IS NULL THEN '' ELSE '<data key="n2">' || domain || '</data>' END || '</node>' FROM kn
              UNION ALL SELECT '<edge source="' || src || '" target="' || dst || '"><data key="e0">' || weight ||
                 '</data><data key="e1">' || rank || '</data><data key="e2">' || n_results || '</data></edge>' FROM ke""", **_SLIM_SQL),
)
def a10(t):
    return exports.graphml_lines(_fixed(cut(t))).select("line")


@register(
    "a11_export_formats",
    net_sql("""SELECT unnest(['csv', 'edgelist', 'gexf', 'graphml', 'json']) AS format,
                 unnest([(SELECT count(*) FROM kept), (SELECT count(*) FROM kept),
                   (SELECT count(*) FROM kept) + (SELECT count(*) FROM kept_nodes) + 11,
                   (SELECT count(*) FROM kept) + (SELECT count(*) FROM kept_nodes) + 11,
                   (SELECT count(*) FROM kept) + (SELECT count(*) FROM kept_nodes) + 3]) AS n_lines""", **_SLIM_SQL),
)
def a11(t):
    """Writes the graph in every format to the run's folder and counts the lines that came out."""
    saved = cut(t)
    graph = Graph(materialize(saved.nodes), materialize(saved.edges))
    folder = f"{run_folder(t.spark)}/exports-{uuid.uuid4().hex}"
    counts = None
    for fmt in sorted(exports.FORMATS):
        exports.export_graph(_fixed(graph), f"{folder}/{fmt}", fmt)
        rows = t.spark.read.option("header", True).csv(f"{folder}/{fmt}") if fmt == "csv" else t.spark.read.text(f"{folder}/{fmt}")
        one = rows.agg(F.count(F.lit(1)).alias("n_lines")).select(F.lit(fmt).alias("format"), "n_lines")
        counts = one if counts is None else counts.unionByName(one)
    return counts


def _written_gexf(t) -> str:
    path = f"{run_folder(t.spark)}/exports-{uuid.uuid4().hex}/graph.gexf"
    exports.export_graph(_fixed(cut(t)), path, "gexf")
    return path


@register(
    "a12_read_gexf",
    net_sql("""SELECT 'node' AS kind, node_id AS a, label AS b, 0.0 AS weight, NULL AS rank FROM kn
               UNION ALL SELECT 'edge', k.src, k.dst, round(k.weight, 6), CAST(k.rank AS VARCHAR) FROM kept k""", **_SLIM_SQL),
)
def a12(t):
    back = gexf.read_gexf(t.spark, _written_gexf(t))
    nodes = back.nodes.select(F.lit("node").alias("kind"), F.col("node_id").alias("a"), F.col("label").alias("b"),
                              F.lit(0.0).alias("weight"), F.lit(None).cast("string").alias("rank"))
    edges = back.edges.select(F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"),
                              F.round("weight", 6).alias("weight"), F.col("attributes")["rank"].alias("rank"))
    return nodes.unionByName(edges)


@register(
    "a12b_convert_and_measure",
    net_sql("""SELECT metric, round(value, 6) AS value FROM (
                 SELECT unnest(['nodes', 'edges', 'density', 'average_degree', 'total_rank', 'total_weight', 'domains', 'graphml_lines']) AS metric,
                   unnest([n, m, 2.0 * m / (n * (n - 1)), 2.0 * m / n, r, w, d, n + m + 11]) AS value
                 FROM (SELECT (SELECT count(*) FROM kn) AS n, count(*) AS m, CAST(sum(rank) AS DOUBLE) AS r, sum(CAST(weight AS DOUBLE)) AS w,
                         (SELECT count(domain) FROM kn) AS d FROM ke))""", **_SLIM_SQL),
)
def a12b(t):
    """Reads a graph file, writes it in another format and measures what was read."""
    path = _written_gexf(t)
    graph = gexf.convert(t.spark, path, f"{path}.graphml", "graphml")
    row = metrics.quick_statistics(graph).select(
        "*", graph.edges.agg(F.sum("rank")).scalar().alias("total_rank"), graph.edges.agg(F.sum("weight")).scalar().alias("total_weight"),
        graph.nodes.agg(F.count("domain")).scalar().alias("domains"),
        t.spark.read.text(f"{path}.graphml").agg(F.count(F.lit(1))).scalar().alias("graphml_lines"))
    names = ["nodes", "edges", "density", "average_degree", "total_rank", "total_weight", "domains", "graphml_lines"]
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.round(F.col(n).cast("double"), 6).alias("value")) for n in names])
    return row.select(F.explode(pairs).alias("p")).select("p.metric", "p.value")


_TABLE_SQL = "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer WHERE c_mktsegment <> 'BUILDING'"
_NEW_SQL = """SELECT c_custkey AS id, upper(c_name) AS name, lower(c_mktsegment) AS segment, 1 AS version FROM customer
              WHERE c_acctbal > 4000 UNION ALL SELECT c_custkey, c_name || '!', c_mktsegment, 2 FROM customer WHERE c_acctbal > 7000"""


def _bulk_tables(t):
    base = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), "c_acctbal")
    table = base.filter("segment <> 'BUILDING'").select("id", "name", "segment")
    first = base.filter("c_acctbal > 4000").select("id", F.upper("name").alias("name"), F.lower("segment").alias("segment"), F.lit(1).alias("version"))
    second = base.filter("c_acctbal > 7000").select("id", F.concat("name", F.lit("!")).alias("name"), "segment", F.lit(2).alias("version"))
    return table, first.unionByName(second)


@register(
    "a13_bulk_write",
    f"""WITH tab AS ({_TABLE_SQL}), new AS ({_NEW_SQL}),
          latest AS (SELECT id, name, segment FROM new QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC) = 1)
        SELECT 'insert' AS op, id, name, segment FROM (SELECT * FROM tab UNION ALL SELECT * FROM latest)
        UNION ALL SELECT 'update', t.id, coalesce(l.name, t.name), coalesce(l.segment, t.segment) FROM tab t LEFT JOIN latest l USING (id)
        UNION ALL SELECT 'upsert', id, name, segment FROM tab WHERE id NOT IN (SELECT id FROM latest)
        UNION ALL SELECT 'upsert', id, name, segment FROM latest
        UNION ALL SELECT 'delete', id, name, segment FROM tab WHERE id NOT IN (SELECT id FROM new)""",
)
def a13(t):
    table, new = _bulk_tables(t)
    latest = new.groupBy("id").agg(F.max_by(F.struct("id", "name", "segment"), "version").alias("r")).select("r.*")
    done = {
        "insert": bulk_write.insert(table, latest),
        "update": bulk_write.update(table, latest),
        "upsert": bulk_write.upsert(table, new.select("id", "name", "segment", "version"), ["id"], ["version"]),
        "delete": bulk_write.delete(table, new),
    }
    out = None
    for op, df in done.items():
        rows = df.select(F.lit(op).alias("op"), "id", "name", "segment")
        out = rows if out is None else out.unionByName(rows)
    return out
