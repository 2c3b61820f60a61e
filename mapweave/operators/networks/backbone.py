"""Cutting a weighted graph to its statistically significant or strongest edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapweave.operators.networks.graph import Graph, endpoints


def _alpha(strength: Column, degree: Column) -> Column:
    """Chance of a share this large if the node spread its strength evenly at random; 0 for one edge."""
    share = F.col("weight") / strength
    return F.when(strength == 0, None).when(degree == 1, 0.0).otherwise(
        F.pow(1 - share, (degree - 1).cast("double"))
    )


def edge_significance(graph: Graph, min_edge_weight: float | None = None) -> DataFrame:
    """Edges with ``alpha_src``, ``alpha_dst`` and ``alpha`` (their maximum; directed: the source's).

    Strength and degree are grouped sums joined back to the edges. An alpha is null at a node of strength 0.
    """
    edges = graph.edges if min_edge_weight is None else graph.edges.filter(F.col("weight") >= min_edge_weight)
    ends = edges.select(F.col("src").alias("node_id"), "weight") if graph.directed else endpoints(edges, "weight")
    nodes = ends.groupBy("node_id").agg(F.sum("weight").alias("s"), F.count(F.lit(1)).alias("k"))
    source = nodes.select(F.col("node_id").alias("src"), F.col("s").alias("s_src"), F.col("k").alias("k_src"))
    scored = edges.join(source, "src").withColumn("alpha_src", _alpha(F.col("s_src"), F.col("k_src")))
    if graph.directed:
        scored = scored.withColumns({"alpha_dst": F.lit(None).cast("double"), "alpha": F.col("alpha_src")})
    else:
        target = nodes.select(F.col("node_id").alias("dst"), F.col("s").alias("s_dst"), F.col("k").alias("k_dst"))
        scored = scored.join(target, "dst").withColumn("alpha_dst", _alpha(F.col("s_dst"), F.col("k_dst")))
        both = F.when(
            F.col("alpha_src").isNotNull() & F.col("alpha_dst").isNotNull(), F.greatest("alpha_src", "alpha_dst")
        )
        scored = scored.withColumn("alpha", both).drop("s_dst", "k_dst")
    return scored.drop("s_src", "k_src")


def disparity_filter(graph: Graph, alpha: float = 0.05, min_edge_weight: float | None = None) -> Graph:
    """Edges significant at both ends (directed: at the source); isolated nodes are removed."""
    kept = edge_significance(graph, min_edge_weight).filter(F.col("alpha") < alpha)
    return graph.with_edges(kept.select(*graph.edges.columns))


def threshold_filter(graph: Graph, threshold: float) -> Graph:
    """Edges of at least ``threshold``; isolated nodes are removed."""
    return graph.with_edges(graph.edges.filter(F.col("weight") >= threshold))


def top_k_filter(graph: Graph, k: int) -> Graph:
    """The ``k`` heaviest edges (ties by ends); isolated nodes are removed."""
    return graph.with_edges(graph.edges.orderBy(F.desc("weight"), "src", "dst").limit(k))


def apply_backbone(
    graph: Graph,
    algorithm: str,
    alpha: float = 0.05,
    min_edge_weight: float | None = None,
    threshold: float | None = None,
    k: int | None = None,
) -> Graph:
    if algorithm == "disparity_filter":
        return disparity_filter(graph, alpha, min_edge_weight)
    if algorithm == "threshold":
        if threshold is None:
            raise ValueError("threshold is required for the threshold filter")
        return threshold_filter(graph, threshold)
    if algorithm == "top_k":
        if k is None:
            raise ValueError("k is required for the top-k filter")
        return top_k_filter(graph, k)
    raise ValueError(f"unknown backbone algorithm {algorithm!r}; use disparity_filter, threshold or top_k")


def retention(original: Graph, cut: Graph, algorithm: str) -> DataFrame:
    """One row: nodes and edges before and after the cut, and the share of edges kept."""
    spark = original.edges.sparkSession

    def size(df: DataFrame) -> Column:
        return df.agg(F.count(F.lit(1)).alias("n")).scalar()

    row = spark.range(1).select(
        F.lit(algorithm).alias("algorithm"),
        size(original.nodes).alias("original_nodes"),
        size(original.edges).alias("original_edges"),
        size(cut.nodes).alias("backbone_nodes"),
        size(cut.edges).alias("backbone_edges"),
    )
    return row.withColumns(
        {
            "nodes_removed": F.col("original_nodes") - F.col("backbone_nodes"),
            "edges_removed": F.col("original_edges") - F.col("backbone_edges"),
            "edge_retention_rate": F.coalesce(F.try_divide("backbone_edges", "original_edges"), F.lit(0.0)),
        }
    )
