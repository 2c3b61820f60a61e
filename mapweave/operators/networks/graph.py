"""A graph as two DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Graph:
    """``nodes`` has node_id, node_type, label and attributes; ``edges`` has src, dst, weight and attributes.

    An undirected edge is stored once.
    """

    nodes: DataFrame
    edges: DataFrame
    directed: bool = False

    def with_edges(self, edges: DataFrame, keep_isolated: bool = False) -> Graph:
        """The same graph with other edges; nodes that lose their last edge go unless kept."""
        if keep_isolated:
            return replace(self, edges=edges)
        used = endpoints(edges).distinct()
        return Graph(self.nodes.join(used, "node_id", "left_semi"), edges, self.directed)


def endpoints(edges: DataFrame, *columns: str) -> DataFrame:
    """Both ends of every edge as rows (node_id, columns), from one pass over the edges."""
    return edges.select(F.explode(F.array("src", "dst")).alias("node_id"), *columns)


def both_ways(edges: DataFrame, *columns: str) -> DataFrame:
    """Every undirected edge in both directions as (node_id, neighbor, columns)."""
    pair = F.array(
        F.struct(F.col("src").alias("node_id"), F.col("dst").alias("neighbor")),
        F.struct(F.col("dst").alias("node_id"), F.col("src").alias("neighbor")),
    )
    return edges.select(F.explode(pair).alias("p"), *columns).select("p.node_id", "p.neighbor", *columns)


def degrees(graph: Graph) -> DataFrame:
    """(node_id, degree) of every node, 0 for isolated ones."""
    counted = endpoints(graph.edges).groupBy("node_id").agg(F.count(F.lit(1)).alias("degree"))
    return graph.nodes.select("node_id").join(counted, "node_id", "left").na.fill(0, ["degree"])
