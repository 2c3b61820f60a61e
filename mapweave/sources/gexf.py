"""Reading graph files back, by ranges of their lines where they allow it.

Spark's XML source reads a file in one task. A file that has each element of a kind in a line of its own, as exports have, is
read as text in as many tasks as it has ranges, and each line is parsed alone; other files go through the XML source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapweave.operators.networks.graph import Graph
from mapweave.sources.exports import export_graph

_VALUE = "struct<attvalue: array<struct<_for: string, _value: string>>>"


_TYPES = {"integer": "int", "long": "bigint", "double": "double", "float": "double", "boolean": "boolean"}


def _by_line(spark: SparkSession, path: str, tags: tuple[str, ...]) -> set[str]:
    """The tags whose elements all stand in a line of their own. One scan of the lines, by ranges."""
    value = F.col("value")

    def astray(tag: str):
        opened = F.regexp_count(value, F.lit(rf"<{tag}(?![\w:.-])"))
        whole = value.rlike(rf"^\s*<{tag}(\s[^<>]*)?(/>|>.*</{tag}\s*>)\s*$")
        # comments and character data may hold anything
        return F.count_if(((opened > 0) & ~((opened == 1) & whole)) | value.contains("<!--") | value.contains("<![CDATA["))

    found = spark.read.text(path).agg(*[astray(tag).alias(tag) for tag in tags]).collect()[0]
    return {tag for tag in tags if not found[tag]}


def _elements(spark: SparkSession, path: str, tag: str, schema: str, by_line: set[str]) -> DataFrame:
    if tag not in by_line:
        return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    lines = spark.read.text(path).where(F.col("value").rlike(rf"^\s*<{tag}(?![\w:.-])"))
    return lines.select(F.from_xml(F.trim("value"), schema).alias("row")).select("row.*")


def declared_attributes(spark: SparkSession, path: str) -> dict[str, dict[str, tuple[str, str]]]:
    """Titles and types of the attributes of nodes and edges, by their numbers: one row each, few by the format."""
    schema = "_class string, attribute array<struct<_id: string, _title: string, _type: string>>"
    rows = (
        _elements(spark, path, "attributes", schema, _by_line(spark, path, ("attributes",)))
        .select("_class", F.explode("attribute").alias("a")).select("_class", "a.*").distinct().collect()
    )
    return {kind: {r["_id"]: (r["_title"], _TYPES.get(r["_type"], "string")) for r in rows if r["_class"] == kind} for kind in ("node", "edge")}


def typed_graph(spark: SparkSession, path: str) -> Graph:
    """A graph file as a graph whose attributes are columns of their declared types: it can be measured, filtered and exported."""
    declared, back = declared_attributes(spark, path), read_gexf(spark, path)

    def spread(df, kind: str, fixed: tuple[str, ...]):
        return df.select(*fixed, *[F.col("attributes")[title].cast(t).alias(title) for title, t in declared[kind].values() if title not in fixed])

    # the kind of graph stands in the first lines, in a tag of its own
    head = spark.read.text(path).where(F.col("value").startswith("<graph ")).limit(1).collect()
    directed = bool(head) and 'defaultedgetype="directed"' in head[0]["value"]
    return Graph(spread(back.nodes, "node", ("node_id", "label")), spread(back.edges, "edge", ("src", "dst", "weight")), directed)


def convert(spark: SparkSession, path: str, target: str, fmt: str) -> Graph:
    """A GEXF file written again in another format; the graph that was read."""
    graph = typed_graph(spark, path)
    export_graph(graph, target, fmt)
    return graph


def read_gexf(spark: SparkSession, path: str) -> Graph:
    """Nodes and edges of a GEXF file or folder. Attributes come as a map by their title.

    An attribute without a declaration keeps its number as name.
    """
    declared = declared_attributes(spark, path)
    titles = {kind: {number: title for number, (title, _) in known.items()} for kind, known in declared.items()}

    def attributes(column: str, kind: str):
        known = titles[kind]
        title = lambda number: F.coalesce(
            F.create_map(*[F.lit(x) for pair in known.items() for x in pair])[number], number) if known else number
        items = F.coalesce(F.col(f"{column}.attvalue"), F.array().cast("array<struct<_for:string,_value:string>>"))
        return F.map_from_entries(F.transform(items, lambda v: F.struct(title(v["_for"]).alias("key"), v["_value"].alias("value"))))

    by_line = _by_line(spark, path, ("node", "edge"))
    nodes = (
        _elements(spark, path, "node", f"_id string, _label string, attvalues {_VALUE}", by_line)
        .select(F.col("_id").alias("node_id"), F.col("_label").alias("label"), attributes("attvalues", "node").alias("attributes"))
    )
    edges = (
        _elements(spark, path, "edge", f"_source string, _target string, _weight double, attvalues {_VALUE}", by_line)
        .select(
            F.col("_source").alias("src"), F.col("_target").alias("dst"),
            F.coalesce("_weight", F.lit(1.0)).alias("weight"), attributes("attvalues", "edge").alias("attributes"),
        )
    )
    return Graph(nodes, edges)
