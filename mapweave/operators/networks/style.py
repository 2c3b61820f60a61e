"""Node colours and sizes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapweave.operators.networks.graph import Graph, degrees

# Colours per node type, and the colour of other types.
TYPE_COLORS = {
    "query": "#3498db",
    "search": "#3498db",
    "website": "#2ecc71",
    "url": "#2ecc71",
    "noun": "#e67e22",
    "concept": "#9b59b6",
    "entity": "#e74c3c",
}
DEFAULT_COLOR = "#95a5a6"


def node_colors(graph: Graph, overrides: Mapping[str, str] | None = None) -> DataFrame:
    colors = {**TYPE_COLORS, **(overrides or {})}
    table = F.create_map(*[F.lit(x) for pair in colors.items() for x in pair])
    return graph.nodes.select(
        "node_id", F.coalesce(table[F.coalesce("node_type", F.lit(""))], F.lit(DEFAULT_COLOR)).alias("color")
    )


def node_sizes(graph: Graph, attribute: str = "degree", smallest: float = 10.0, largest: float = 100.0) -> DataFrame:
    """Degree or an attribute scaled to [smallest, largest]; ``largest`` for all when they are equal.

    A node without the attribute is sized by its degree.
    """
    values = degrees(graph).withColumnRenamed("degree", "value")
    if attribute != "degree" and attribute in graph.nodes.columns:
        own = graph.nodes.select("node_id", F.col(attribute).cast("double").alias("own"))
        values = values.join(own, "node_id").select("node_id", F.coalesce("own", "value").alias("value"))
    span = values.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    lo, hi = span.select("lo").scalar(), span.select("hi").scalar()
    size = F.when(hi == lo, F.lit(float(largest))).otherwise(
        smallest + F.try_divide(F.col("value") - lo, hi - lo) * (largest - smallest)
    )
    return values.select("node_id", size.alias("size"))
