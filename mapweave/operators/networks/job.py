"""The whole network job: build, cut, export, register."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapweave.operators.networks import backbone
from mapweave.operators.networks.graph import Graph
from mapweave.session import materialize
from mapweave.sources import exports


def run_network_job(
    graph: Graph,
    name: str,
    kind: str,
    session_ids: Sequence[int],
    path: str,
    fmt: str = "gexf",
    algorithm: str | None = None,
    **parameters,
) -> DataFrame:
    """Writes the (cut) graph to ``path`` and returns its registry row.

    Nodes and edges are materialised once: the cut, the export and the counts all read them.
    """
    built = Graph(materialize(graph.nodes), materialize(graph.edges), graph.directed)
    if built.nodes.isEmpty():
        raise ValueError(f"network {name!r} has no nodes")
    final = built
    if algorithm:
        cut = backbone.apply_backbone(built, algorithm, **parameters)
        final = Graph(materialize(cut.nodes), materialize(cut.edges), built.directed)
    exports.export_graph(final, path, fmt)
    n_edges = built.edges.count()
    facts = backbone.retention(built, final, algorithm or "none")
    return facts.select(
        F.lit(name).alias("name"),
        F.lit(kind).alias("type"),
        F.lit(",".join(str(s) for s in session_ids)).alias("session_ids"),
        F.lit(fmt).alias("format"),
        F.lit(algorithm is not None).alias("backboning_applied"),
        F.lit(algorithm or "none").alias("backboning_algorithm"),
        F.col("backbone_nodes").alias("node_count"),
        F.col("backbone_edges").alias("edge_count"),
        F.lit(n_edges).cast("bigint").alias("original_edge_count"),
        F.col("edge_retention_rate"),
    )
