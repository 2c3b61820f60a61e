"""Graph files: CSV, edge list, JSON, GEXF, GraphML.

Lines carry a section and a sort key, Spark range-sorts them, and ``documents.write_document`` makes one file of the sorted
partitions: no task or driver holds the whole graph, and any reader of the format opens the file.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapweave.operators.networks import style
from mapweave.operators.networks.graph import Graph
from mapweave.sources.documents import write_document

FORMATS = ("gexf", "graphml", "edgelist", "csv", "json")
_NUMERIC = ("int", "bigint", "smallint", "tinyint")


def escape_xml(value) -> Column:
    out = F.col(value) if isinstance(value, str) else value
    for raw, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    return out


def edge_rows(graph: Graph) -> DataFrame:
    """(Source, Target, Weight) with labels in place of ids, weight 1.0 where missing."""
    label = graph.nodes.select("node_id", F.coalesce("label", "node_id").alias("label"))
    weight = F.coalesce("weight", F.lit(1.0)) if "weight" in graph.edges.columns else F.lit(1.0)
    return (
        graph.edges.select("src", "dst", weight.alias("Weight"))
        .join(label.withColumnsRenamed({"node_id": "src", "label": "Source"}), "src")
        .join(label.withColumnsRenamed({"node_id": "dst", "label": "Target"}), "dst")
        .select("Source", "Target", "Weight")
    )


def fixed_digits(graph: Graph, digits: int = 6) -> Graph:
    """The graph with its fractional attributes as decimals of so many digits: their text is the same everywhere."""
    def fixed(df: DataFrame) -> DataFrame:
        return df.select(*[F.col(c).cast(f"decimal(38,{digits})").alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])

    return Graph(fixed(graph.nodes), fixed(graph.edges), graph.directed)


def _attributes(columns: list[str]) -> Column:
    return F.to_json(F.struct(*columns)) if columns else F.lit("{}")


def edge_list_lines(graph: Graph, data: bool = True, delimiter: str = "\t") -> DataFrame:
    """One line per edge: both ids and, with ``data``, the attributes as JSON."""
    parts = [F.col("src"), F.col("dst")]
    if data:
        parts.append(_attributes([c for c in graph.edges.columns if c not in ("src", "dst")]))
    return graph.edges.select(F.concat_ws(delimiter, *parts).alias("line"))


def _document(header: list[str], between: list[str], footer: list[str], nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines with (section, key): header 0, nodes 1, middle 2, edges 3, footer 4."""
    spark = nodes.sparkSession
    rows = [(s, f"{i:04d}", line) for s, block in ((0, header), (2, between), (4, footer)) for i, line in enumerate(block)]
    fixed = spark.createDataFrame(rows, "section int, key string, line string")
    body = nodes.withColumn("section", F.lit(1)).unionByName(edges.withColumn("section", F.lit(3)))
    return fixed.unionByName(body)


def json_lines(graph: Graph) -> DataFrame:
    """Lines of a node-link document: an object with ``nodes`` and ``links``, one to a line."""
    rest = [c for c in graph.nodes.columns if c != "node_id"]
    more = [c for c in graph.edges.columns if c not in ("src", "dst")]
    nodes = graph.nodes.select(
        F.col("node_id").alias("key"), F.to_json(F.struct(F.col("node_id").alias("id"), *rest)).alias("line"))
    links = graph.edges.select(
        F.concat_ws("\t", "src", "dst").alias("key"),
        F.to_json(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), *more)).alias("line"))

    def listed(rows: DataFrame) -> DataFrame:
        """A comma before every line but the first."""
        first = rows.agg(F.min("key").alias("k")).scalar()
        return rows.select("key", F.concat(F.when(F.col("key") == first, F.lit("")).otherwise(F.lit(",")), "line").alias("line"))

    directed = "true" if graph.directed else "false"
    header = [f'{{"directed": {directed}, "multigraph": false, "graph": {{}}, "nodes": [']
    return _document(header, ['], "links": ['], ["]}"], listed(nodes), listed(links))


def _columns(df: DataFrame, skip: tuple[str, ...]) -> list[tuple[int, str, str]]:
    types = dict(df.dtypes)
    names = [c for c in df.columns if c not in skip]
    kind = {"double": "double", "float": "double", "boolean": "boolean"}
    fraction = lambda t: "double" if t.startswith("decimal") else kind.get(t, "string")
    return [(i, n, "long" if types[n] in _NUMERIC else fraction(types[n])) for i, n in enumerate(names)]


def _values(columns, tag: str, key: str, offset: int = 0) -> Column:
    """Attribute elements of a row; concat_ws skips the missing ones."""
    items = []
    for number, name, _ in columns:
        text = escape_xml(F.col(name).cast("string"))
        if tag == "attvalue":
            items.append(F.concat(F.lit(f'<attvalue for="{number}" value="'), text, F.lit('" />')))
        else:
            items.append(F.concat(F.lit(f'<data key="{key}{number + offset}">'), text, F.lit("</data>")))
    return F.concat_ws("", *items) if items else F.lit("")


def _visual(graph: Graph, colors: Mapping[str, str] | None, size_attr: str, smallest: float, largest: float) -> Graph:
    paint = style.node_colors(graph, colors)
    sizes = style.node_sizes(graph, size_attr, smallest, largest)
    return Graph(
        graph.nodes.join(paint.withColumnRenamed("color", "viz_color"), "node_id").join(
            sizes.withColumnRenamed("size", "viz_size"), "node_id"
        ),
        graph.edges,
        graph.directed,
    )


def _hex_part(position: int) -> Column:
    return F.conv(F.substring("viz_color", position, 2), 16, 10)


def gexf_lines(
    graph: Graph,
    visual: bool = False,
    colors: Mapping[str, str] | None = None,
    size_attr: str = "degree",
    smallest: float = 10.0,
    largest: float = 100.0,
) -> DataFrame:
    """GEXF 1.2 document lines. Missing attributes are left out and a label defaults to the id."""
    node_attrs = _columns(graph.nodes, ("node_id", "label"))
    edge_attrs = _columns(graph.edges, ("src", "dst", "weight"))
    viz = F.lit("")
    if visual:
        graph = _visual(graph, colors, size_attr, smallest, largest)
        viz = F.concat(
            F.lit('<viz:color r="'), _hex_part(2), F.lit('" g="'), _hex_part(4), F.lit('" b="'), _hex_part(6),
            F.lit('" /><viz:size value="'), F.col("viz_size").cast("string"), F.lit('" />'),
        )
    nodes = graph.nodes.select(
        F.col("node_id").alias("key"),
        F.concat(
            F.lit('<node id="'), escape_xml("node_id"), F.lit('" label="'),
            escape_xml(F.coalesce("label", "node_id")), F.lit('"><attvalues>'),
            _values(node_attrs, "attvalue", ""), F.lit("</attvalues>"), viz, F.lit("</node>"),
        ).alias("line"),
    )
    weight = F.concat(F.lit(' weight="'), F.col("weight").cast("string"), F.lit('"')) if "weight" in graph.edges.columns else F.lit("")
    edges = graph.edges.select(
        F.concat_ws("\t", "src", "dst").alias("key"),
        F.concat(
            F.lit('<edge source="'), escape_xml("src"), F.lit('" target="'), escape_xml("dst"), F.lit('"'),
            F.coalesce(weight, F.lit("")), F.lit("><attvalues>"), _values(edge_attrs, "attvalue", ""),
            F.lit("</attvalues></edge>"),
        ).alias("line"),
    )
    kind = "directed" if graph.directed else "undirected"
    header = [
        '<?xml version="1.0" encoding="UTF-8"?>',
        '<gexf xmlns="http://www.gexf.net/1.2draft" xmlns:viz="http://www.gexf.net/1.2draft/viz" version="1.2">',
        f'<graph defaultedgetype="{kind}" mode="static">',
        '<attributes class="node" mode="static">'
        + "".join(f'<attribute id="{i}" title="{n}" type="{t}" />' for i, n, t in node_attrs) + "</attributes>",
        '<attributes class="edge" mode="static">'
        + "".join(f'<attribute id="{i}" title="{n}" type="{t}" />' for i, n, t in edge_attrs) + "</attributes>",
        "<nodes>",
    ]
    return _document(header, ["</nodes>", "<edges>"], ["</edges>", "</graph>", "</gexf>"], nodes, edges)


def graphml_lines(graph: Graph) -> DataFrame:
    """GraphML document lines."""
    node_attrs = _columns(graph.nodes, ("node_id",))
    edge_attrs = _columns(graph.edges, ("src", "dst"))
    nodes = graph.nodes.select(
        F.col("node_id").alias("key"),
        F.concat(
            F.lit('<node id="'), escape_xml("node_id"), F.lit('">'), _values(node_attrs, "data", "n"), F.lit("</node>")
        ).alias("line"),
    )
    edges = graph.edges.select(
        F.concat_ws("\t", "src", "dst").alias("key"),
        F.concat(
            F.lit('<edge source="'), escape_xml("src"), F.lit('" target="'), escape_xml("dst"), F.lit('">'),
            _values(edge_attrs, "data", "e"), F.lit("</edge>"),
        ).alias("line"),
    )
    keys = [f'<key id="n{i}" for="node" attr.name="{n}" attr.type="{t}" />' for i, n, t in node_attrs]
    keys += [f'<key id="e{i}" for="edge" attr.name="{n}" attr.type="{t}" />' for i, n, t in edge_attrs]
    kind = "directed" if graph.directed else "undirected"
    header = [
        '<?xml version="1.0" encoding="UTF-8"?>',
        '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">',
        *keys,
        f'<graph edgedefault="{kind}">',
    ]
    return _document(header, [], ["</graph>", "</graphml>"], nodes, edges)


def export_graph(graph: Graph, path: str, fmt: str = "gexf", **options) -> None:
    """Write a graph in one of :data:`FORMATS`, as one file (csv: a folder of files with headers)."""
    if fmt == "csv":
        edge_rows(graph).write.mode("overwrite").option("header", True).csv(path)
    elif fmt == "edgelist":
        write_document(edge_list_lines(graph, **options).orderBy("line"), path)
    elif fmt in ("json", "gexf", "graphml"):
        lines = {"json": json_lines, "gexf": gexf_lines, "graphml": graphml_lines}[fmt](graph, **options)
        write_document(lines.orderBy("section", "key"), path)
    else:
        raise ValueError(f"unsupported export format {fmt!r}; use one of {', '.join(FORMATS)}")
