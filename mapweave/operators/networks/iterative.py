"""Iterative graph operators. Every round is one bounded plan; its result is written to the shared
checkpoint folder, so lineage does not grow and a lost executor costs one round."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from mapweave.operators.networks.graph import Graph
from mapweave.operators.networks.rounds import Links, both_ways_numbered, component_labels, number_nodes
from mapweave.operators.networks.searches import betweenness, closeness
from mapweave.session import materialize


#: Bound of all loops whose rounds follow a path; a longer one is an error, not a shorter result.
MAX_STEPS = 1000


def connected_components(graph: Graph) -> DataFrame:
    """(node_id, component): weak components, named by their smallest node id."""
    ids = number_nodes(graph.nodes)
    labels = component_labels(both_ways_numbered(graph.edges, ids))
    # numbers follow the order of node ids: the smallest number is that of the smallest id
    names = ids.select(F.col("id").alias("label"), F.col("node_id").alias("component"))
    found = labels.join(names, "label").select(F.col("node").alias("id"), "component")
    return ids.join(found, "id", "left").select("node_id", F.coalesce("component", "node_id").alias("component"))


def component_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("component").agg(F.count(F.lit(1)).alias("size"))


def is_two_colorable(graph: Graph) -> bool:
    """True when the nodes can be split so that no edge stays inside a side, whatever their types.

    Components of the double cover: a node and its mirror meet exactly when an odd cycle exists.
    """
    links = both_ways_numbered(graph.edges, number_nodes(graph.nodes), loops=True)
    mirrored = F.array(F.struct((F.col("a") * 2).alias("a"), (F.col("b") * 2 + 1).alias("b")),
                       F.struct((F.col("a") * 2 + 1).alias("a"), (F.col("b") * 2).alias("b")))
    labels = component_labels(links.select(F.explode(mirrored).alias("e")).select("e.a", "e.b"))
    sides = labels.groupBy(F.shiftright("node", 1).alias("of"), "label").agg(F.count(F.lit(1)).alias("n"))
    return sides.filter("n > 1").isEmpty()


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def eigenvector(graph: Graph, max_iter: int = 100, tol: float = 1e-6) -> DataFrame | None:
    """Eigenvector centrality by power iteration on A + I, unweighted; None without convergence.

    A round is one action: its table holds the vector before and after normalising and the next raw vector, and what the
    driver needs of it (its norm, and by how much the vector has changed) is observed while it is written.
    """
    ids = number_nodes(graph.nodes)
    n = ids.count()
    if n == 0:
        return None
    links = Links(both_ways_numbered(graph.edges, ids))
    raw, vector = None, ids.select(F.col("id").alias("node"), F.lit(None).cast("double").alias("before"), F.lit(1.0 / n).alias("x"))
    for _ in range(max_iter + 1):
        pulled = links.pull(vector, "x", F.sum)
        seen = Observation()
        step = vector.join(pulled, "node", "left").select(
            "node", "before", "x", (F.col("x") + F.coalesce("pulled", F.lit(0.0))).alias("y"))
        raw = materialize(step.observe(seen, F.sum(F.col("y") * F.col("y")).alias("square"),
                                       F.sum(F.abs(F.col("x") - F.col("before"))).alias("change")), replaces=raw)
        if seen.get["change"] is not None and seen.get["change"] < n * tol:
            return ids.join(raw.select(F.col("node").alias("id"), "x"), "id").select("node_id", F.col("x").alias("centrality"))
        vector = raw.select("node", F.col("x").alias("before"), (F.col("y") / (math.sqrt(seen.get["square"]) or 1.0)).alias("x"))
    return None


def centrality(graph: Graph, measure: str) -> DataFrame | None:
    """(node_id, centrality) by measure: degree, closeness, betweenness or eigenvector."""
    from mapweave.operators.networks.metrics import degree_centrality

    measures = {
        "degree": degree_centrality, "closeness": closeness, "betweenness": betweenness, "eigenvector": eigenvector,
    }
    if measure not in measures:
        raise ValueError(f"unknown centrality {measure!r}; use {', '.join(measures)}")
    return measures[measure](graph)


def strong_components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(node_id, component) of a directed graph: rounds of forward colouring and backward search.

    In a round, every open node takes the largest id that reaches it as its colour; the nodes that reach
    their colour's root inside the colour are one component and close. Nodes that lie on no cycle because
    they have no open predecessor or successor close before, alone.
    """
    open_nodes = materialize(nodes.select("node_id"))
    open_edges = materialize(edges.filter(F.col("src") != F.col("dst")).select("src", "dst").distinct())
    closed = []
    for _ in range(max_rounds):
        if open_nodes.isEmpty():
            break
        inner, links = _trim(open_nodes, open_edges)
        alone = open_nodes.join(inner, "node_id", "left_anti").select("node_id", F.col("node_id").alias("component"))
        closed.append(materialize(alone))
        color = _spread_largest(inner, links)
        same = links.join(color.withColumnsRenamed({"node_id": "src", "color": "c1"}), "src").join(
            color.withColumnsRenamed({"node_id": "dst", "color": "c2"}), "dst"
        ).filter(F.col("c1") == F.col("c2")).select("src", "dst")
        found = _reach_backward(color.filter(F.col("node_id") == F.col("color")).select("node_id"), materialize(same))
        component = materialize(
            color.join(found, "node_id", "left_semi").select("node_id", F.col("color").alias("component"))
        )
        closed.append(component)
        open_nodes = materialize(inner.join(component, "node_id", "left_anti"))
        open_edges = materialize(_inside(links, open_nodes))
    else:
        raise RuntimeError(f"strong components did not settle in {max_rounds} rounds")
    return _union(closed) if closed else nodes.select("node_id", F.col("node_id").alias("component")).limit(0)


def _inside(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.join(nodes.withColumnRenamed("node_id", "src"), "src", "left_semi").join(
        nodes.withColumnRenamed("node_id", "dst"), "dst", "left_semi"
    ).select("src", "dst")


def _trim(nodes: DataFrame, edges: DataFrame, max_rounds: int = MAX_STEPS) -> tuple[DataFrame, DataFrame]:
    """Nodes that keep a predecessor and a successor however often nodes without one are removed."""
    for _ in range(max_rounds):
        ends = edges.select(F.col("src").alias("node_id")).distinct()
        starts = edges.select(F.col("dst").alias("node_id")).distinct()
        kept = materialize(nodes.join(starts, "node_id", "left_semi").join(ends, "node_id", "left_semi"))
        if kept.count() == nodes.count():
            return kept, edges
        nodes, edges = kept, materialize(_inside(edges, kept))
    raise RuntimeError(f"trimming did not settle in {max_rounds} rounds")


def _spread_largest(nodes: DataFrame, links: DataFrame, max_rounds: int = MAX_STEPS) -> DataFrame:
    color = materialize(nodes.select("node_id", F.col("node_id").alias("color"), F.lit(True).alias("moved")))
    for _ in range(max_rounds):
        offers = (
            links.join(color.filter("moved").select(F.col("node_id").alias("src"), "color"), "src")
            .groupBy(F.col("dst").alias("node_id"))
            .agg(F.max("color").alias("offer"))
        )
        better = F.coalesce(F.col("offer") > F.col("color"), F.lit(False))
        color_next = materialize(
            color.join(offers, "node_id", "left").select(
                "node_id", F.when(better, F.col("offer")).otherwise(F.col("color")).alias("color"),
                better.alias("moved"),
            ),
            replaces=color,
        )
        color = color_next
        if color.filter("moved").isEmpty():
            return color.select("node_id", "color")
    raise RuntimeError(f"colours did not settle in {max_rounds} rounds")


def _reach_backward(roots: DataFrame, links: DataFrame, max_rounds: int = MAX_STEPS) -> DataFrame:
    found = [materialize(roots)]
    for _ in range(max_rounds):
        step = (
            links.join(found[-1].select(F.col("node_id").alias("dst")), "dst")
            .select(F.col("src").alias("node_id"))
            .distinct()
            .join(_union(found), "node_id", "left_anti")
        )
        frontier = materialize(step)
        if frontier.isEmpty():
            return _union(found)
        found.append(frontier)
    raise RuntimeError(f"a path is longer than {max_rounds} steps")
