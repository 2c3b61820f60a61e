"""Rounds over a graph whose edges stay where they are: nodes are numbered once, links are written bucketed by the node they
pull from, and each round moves values of nodes only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from mapweave.session import materialize, materialize_bucketed

#: A node with more than a 1000th of all links is a hub: there are fewer than 1000 of them, so their values may be broadcast.
HUBS = 1000


def number_nodes(nodes: DataFrame) -> DataFrame:
    """(node_id, id): 64-bit numbers in the order of the node ids, written."""
    return materialize(nodes.select("node_id").distinct().orderBy("node_id").withColumn("id", F.monotonically_increasing_id()))


def numbered_edges(edges: DataFrame, ids: DataFrame, loops: bool = False) -> DataFrame:
    """(a, b): the edges between numbers of their ends; without loops unless asked."""
    one, two = (ids.select(F.col("node_id").alias(end), F.col("id").alias(name)) for end, name in (("src", "a"), ("dst", "b")))
    found = edges.select("src", "dst").join(one, "src").join(two, "dst").select("a", "b")
    return found if loops else found.where("a <> b")


def both_ways_numbered(edges: DataFrame, ids: DataFrame, loops: bool = False) -> DataFrame:
    """(a, b): every edge in both directions, once each."""
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    return numbered_edges(edges, ids, loops).select(F.explode(ways).alias("w")).select("w.a", "w.b").distinct()


class Links:
    """Links (a, b): a pulls values from b.

    Those from ordinary nodes are bucketed by ``b``, so a round's join shuffles the nodes' values only. A hub's links would all
    lie in one bucket: they are kept apart, in no order, and meet the hubs' values by broadcast. Both are reduced per ``a`` before
    the shuffle.
    """

    def __init__(self, links: DataFrame):
        links = materialize(links)
        total = links.agg(F.count(F.lit(1)).alias("n")).first()["n"]
        self.total = total
        self.hubs = F.broadcast(materialize(links.groupBy("b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * HUBS > total).select("b")))
        self.plain = materialize_bucketed(links.join(self.hubs, "b", "left_anti"), "b")
        self.of_hubs = materialize(links.join(self.hubs, "b", "left_semi"))

    def pull(self, state: DataFrame, value: str, reduce: Callable[[str], Column]) -> DataFrame:
        """(node, pulled): for each node the reduced values of those it pulls from; ``state`` is (node, value, ...)."""
        far = state.select(F.col("node").alias("b"), value)
        parts = self.plain.join(far, "b").select("a", value).unionByName(
            self.of_hubs.join(F.broadcast(far.join(self.hubs, "b", "left_semi")), "b").select("a", value))
        return parts.groupBy(F.col("a").alias("node")).agg(reduce(value).alias("pulled"))


def component_labels(links: DataFrame) -> DataFrame:
    """(node, label) of the nodes that ``links`` (a, b; both ways) join: the smallest number that can be reached.

    In a round, all nodes of a label take the smallest label that any of them sees, and then that label's own: about log2
    of the longest way, in any order of the numbers. How many labels fell is observed while the round is written.
    """
    links = Links(links)
    own = links.plain.unionByName(links.of_hubs).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
    state = materialize(own.select("node", F.least("node", "low").alias("label")))
    if links.total == 0:
        return state
    while True:
        near = links.pull(state, "label", F.min)
        fell = Observation()
        hooks = materialize(state.join(near, "node").groupBy("label").agg(F.min("pulled").alias("low")).select(
            "label", F.least("label", "low").alias("hook")).observe(fell, F.count_if(F.col("hook") < F.col("label")).alias("n")))
        if not fell.get["n"]:
            return state
        # a hook is a node with a label of its own, and that label has a hook, too
        onward = hooks.select("label", F.col("hook").alias("node")).join(state.withColumnRenamed("label", "next"), "node")
        roots = onward.join(hooks.select(F.col("label").alias("next"), F.col("hook").alias("root")), "next").select("label", "root")
        state = materialize(state.join(roots, "label").select("node", F.col("root").alias("label")), replaces=state)
