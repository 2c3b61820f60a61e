"""Connected components of a table of links, in rounds of written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from mapweave.llm.common import materialize


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b: long) to (node, label): the smallest node that can be reached. Only linked nodes have a row, each once, however
    often a link is repeated. Links with a null end and links of a node with itself link nothing; without links there are no rows.

    Every round all nodes of a label take the smallest label that any of them sees, then the label of that label, by the
    same step. So whole clusters meet, in any order of the ids: a path of n nodes takes about log2 n rounds. It ends
    when no node sees a smaller label than its own; until then each round lowers some label.
    """
    edges = links.where("a <> b").select("a", "b")
    edges = materialize(edges.union(edges.select("b", "a")).distinct())
    state = materialize(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    if state.isEmpty():
        return state
    while True:
        near = edges.join(state.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = Observation()
        hooks = materialize(state.join(near, "node").groupBy("label").agg(F.min("near").alias("near")).select(
            "label", F.least("label", "near").alias("hook")).observe(lower, F.count_if(F.col("hook") < F.col("label")).alias("n")))
        if not lower.get["n"]:
            return state
        # a hook is a node with a label of its own, and that label has a hook
        onward = hooks.select("label", F.col("hook").alias("node")).join(state.withColumnRenamed("label", "next"), "node")
        roots = onward.join(hooks.select(F.col("label").alias("next"), F.col("hook").alias("root")), "next").select("label", "root")
        state = materialize(state.join(roots, "label").select("node", F.col("root").alias("label")), replaces=state)
