"""Interactive graph filters: type, label, giant component, minimum degree."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import functions as F

from mapweave.operators.networks.graph import Graph, degrees
from mapweave.operators.networks.iterative import connected_components


def induced(graph: Graph, nodes) -> Graph:
    """The part of the graph on ``nodes``: edges stay when both ends do."""
    ids = nodes.select("node_id")
    edges = graph.edges.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(
        ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi"
    )
    return Graph(nodes, edges.select(*graph.edges.columns), graph.directed)


def by_type(graph: Graph, types: Sequence[str]) -> Graph:
    return induced(graph, graph.nodes.filter(F.col("node_type").isin(*types)))


def by_label(graph: Graph, text: str) -> Graph:
    """Nodes whose label contains ``text``, any case."""
    return induced(graph, graph.nodes.filter(F.contains(F.lower("label"), F.lit(text.lower()))))


def giant_component(graph: Graph) -> Graph:
    """The largest component; on ties the one with the smallest member id."""
    labels = connected_components(graph)
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    best = sizes.orderBy(F.desc("size"), "component").limit(1)
    members = labels.join(F.broadcast(best.select("component")), "component", "left_semi")
    return induced(graph, graph.nodes.join(members.select("node_id"), "node_id", "left_semi"))


def by_min_degree(graph: Graph, minimum: int) -> Graph:
    """Nodes of at least ``minimum`` edges, in one pass (not a k-core)."""
    enough = degrees(graph).filter(F.col("degree") >= minimum)
    return induced(graph, graph.nodes.join(enough.select("node_id"), "node_id", "left_semi"))
