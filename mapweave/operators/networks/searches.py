"""Breadth-first searches from many sources at once.

Sources are numbered and share rows: a row of a level stands for a node and up to 64 sources (one bit each) or 16 sources (one
path count each), so a level is one join of its rows with the links and one aggregation with partial results, for all sources
of a batch together. Batches bound what is kept: a batch's levels are summed per node and removed before the next begins, and no
table of all pairs is ever written.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapweave.operators.networks.graph import Graph
from mapweave.operators.networks.rounds import both_ways_numbered, number_nodes, numbered_edges
from mapweave.session import materialize, recorded, remove_tables

BITS, LANES = 64, 16
#: Sources of a batch.
BATCH = 1 << 16
#: Bound of a search; a longer path is an error, not a shorter result.
MAX_LEVELS = 1000


def sources_for(error: float, confidence: float = 0.95) -> int:
    """How many sampled sources keep a node's betweenness within ``error`` of the exact value at this confidence (Hoeffding: a
    source's share of it lies between 0 and 1)."""
    return math.ceil(math.log(2 / (1 - confidence)) / (2 * error * error))


def _placed(nodes: DataFrame, width: int) -> DataFrame:
    """(node, word, lane): sources, ``width`` to a row."""
    slot = materialize(nodes.select("id").withColumn("slot", F.monotonically_increasing_id()))
    return slot.select(F.col("id").alias("node"), F.floor(F.col("slot") / width).alias("word"), (F.col("slot") % width).cast("int").alias("lane"))


def _batches(sources: DataFrame, batch: int, width: int):
    """The sources in batches of about ``batch``, whole words together."""
    n = max(1, math.ceil(sources.count() / batch))
    for i in range(n):
        yield sources.where(F.pmod(F.xxhash64("word"), F.lit(n)) == i)


def _summed(spark, make: Callable[[], DataFrame]) -> DataFrame:
    """``make()`` written; the tables made for it are removed."""
    with recorded() as paths:
        kept = materialize(make())
    remove_tables(spark, [p for p in paths if p != kept._mapweave_path])
    return kept


def _levels(start: DataFrame, spread: Callable[[DataFrame, DataFrame], DataFrame], directed: bool) -> list[DataFrame]:
    """Written levels from ``start`` on: ``spread`` makes the next of the last and the (word, node, mask) that are not new."""
    levels = [materialize(start)]
    while len(levels) <= MAX_LEVELS:
        # a neighbour of an undirected level lies in it, before it or after it; a directed edge may lead far back
        near = levels if directed else levels[-2:]
        known = reduce(DataFrame.unionByName, [x.select("word", "node", "mask") for x in near]).groupBy("word", "node").agg(F.bit_or("mask").alias("known"))
        level = materialize(spread(levels[-1], known))
        if level.isEmpty():
            return levels
        levels.append(level)
    raise RuntimeError(f"a path is longer than {MAX_LEVELS} steps")


def _links(graph: Graph, ids: DataFrame) -> DataFrame:
    """(a, b): from a to b, written."""
    return materialize(numbered_edges(graph.edges, ids).distinct() if graph.directed else both_ways_numbered(graph.edges, ids))


def closeness(graph: Graph, batch: int = BATCH) -> DataFrame:
    """Closeness with the component-size correction: (r-1)/sum(d) * (r-1)/(n-1), 0 for isolated nodes.

    Distances run towards the node, as incoming distances do in a directed graph. Each node counts the bits that
    reach it at every level.
    """
    ids = number_nodes(graph.nodes)
    links, n = _links(graph, ids), ids.count()

    def spread(last: DataFrame, known: DataFrame) -> DataFrame:
        met = last.join(links, last["node"] == links["a"]).groupBy("word", F.col("b").alias("node")).agg(F.bit_or("mask").alias("met"))
        fresh = F.col("met").bitwiseAND(F.bitwise_not(F.coalesce("known", F.lit(0).cast("long"))))
        return met.join(known, ["word", "node"], "left").select("word", "node", fresh.alias("mask")).where("mask <> 0")

    def distances(sources: DataFrame) -> DataFrame:
        start = sources.groupBy("word", "node").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("lane"))).alias("mask"))
        levels = _levels(start, spread, graph.directed)
        counted = [x.select("node", F.bit_count("mask").alias("k"), F.lit(d).cast("long").alias("d")) for d, x in enumerate(levels)]
        return reduce(DataFrame.unionByName, counted).groupBy("node").agg(F.sum(F.col("k") * F.col("d")).alias("total"), F.sum("k").alias("reached"))

    parts = [_summed(links.sparkSession, lambda s=s: distances(s)) for s in _batches(_placed(ids, BITS), batch, BITS)]
    sums = reduce(DataFrame.unionByName, parts).groupBy(F.col("node").alias("id")).agg(F.sum("total").alias("total"), (F.sum("reached") - 1).alias("others"))
    score = F.try_divide(F.col("others") * 1.0, F.col("total")) * F.try_divide(F.col("others") * 1.0, F.lit(n - 1))
    return ids.join(sums, "id", "left").select("node_id", F.coalesce(score, F.lit(0.0)).alias("centrality"))


def _lanes(make: Callable[[str], Column], name: str = "p") -> list[Column]:
    return [make(f"{name}{i}") for i in range(LANES)]


def betweenness(graph: Graph, sources: int | None = None, seed: int = 0, batch: int = BATCH // 4) -> DataFrame:
    """Normalised betweenness by Brandes' accumulation, from the farthest level to the nearest, all sources of a batch together.

    ``sources``: only so many sampled sources, their sum scaled up; ``sources_for`` gives the number for an error bound.
    """
    ids = number_nodes(graph.nodes)
    links, n = _links(graph, ids), ids.count()
    picked = ids if sources is None or sources >= n else ids.orderBy(F.xxhash64("node_id", F.lit(seed)), "node_id").limit(sources)
    used = n if sources is None else min(sources, n)
    names = [f"p{i}" for i in range(LANES)]
    mask = reduce(lambda a, b: a + b, [F.when(F.col(p) > 0, F.lit(1 << i)).otherwise(0) for i, p in enumerate(names)]).cast("long").alias("mask")

    def spread(last: DataFrame, known: DataFrame) -> DataFrame:
        met = last.join(links, last["node"] == links["a"]).groupBy("word", F.col("b").alias("node")).agg(*_lanes(lambda p: F.sum(p).alias(p)))
        old = F.coalesce("known", F.lit(0).cast("long"))
        fresh = [F.when(old.bitwiseAND(1 << i) == 0, F.col(p)).otherwise(F.lit(0.0)).alias(p) for i, p in enumerate(names)]
        return met.join(known, ["word", "node"], "left").select("word", "node", *fresh).select("*", mask).where("mask <> 0")

    def credits(start: DataFrame) -> DataFrame:
        begun = start.groupBy("word", "node").agg(*[F.max((F.col("lane") == i).cast("double")).alias(p) for i, p in enumerate(names)]).select("*", mask)
        levels, credit, done = _levels(begun, spread, graph.directed), None, []
        for level in range(len(levels) - 1, 1, -1):
            far = levels[level].select("word", F.col("node").alias("b"), *names)
            if credit is not None:
                far = far.join(credit.withColumnRenamed("node", "b"), ["word", "b"], "left")
            share = [F.when(F.col(p) > 0, (F.lit(1.0) + (F.coalesce(f"d{i}", F.lit(0.0)) if credit is not None else 0.0)) / F.col(p)).otherwise(F.lit(0.0)).alias(f"s{i}")
                     for i, p in enumerate(names)]
            back = far.select("word", "b", *share).join(links, "b").groupBy("word", F.col("a").alias("node")).agg(*_lanes(lambda s: F.sum(s).alias(s), "s"))
            near = levels[level - 1]
            credit = materialize(near.join(back, ["word", "node"]).select("word", "node", *[(F.col(p) * F.col(f"s{i}")).alias(f"d{i}") for i, p in enumerate(names)]))
            done.append(credit.select("node", reduce(lambda a, b: a + b, _lanes(F.col, "d")).alias("delta")))
        if not done:
            return start.select("node", F.lit(0.0).alias("delta")).groupBy("node").agg(F.sum("delta").alias("delta"))
        return reduce(DataFrame.unionByName, done).groupBy("node").agg(F.sum("delta").alias("delta"))

    parts = [_summed(links.sparkSession, lambda s=s: credits(s)) for s in _batches(_placed(picked, LANES), batch, LANES)]
    sums = reduce(DataFrame.unionByName, parts).groupBy(F.col("node").alias("id")).agg(F.sum("delta").alias("total"))
    scale = (1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0) * (n / used if used else 1.0)
    return ids.join(sums, "id", "left").select("node_id", (F.coalesce("total", F.lit(0.0)) * scale).alias("centrality"))
