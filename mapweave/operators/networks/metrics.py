"""One-pass measures of a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapweave.functions.skew import top_n
from mapweave.operators.networks.graph import Graph, both_ways, degrees, endpoints
from mapweave.operators.networks.rounds import numbered_edges
from mapweave.session import materialize


def top_nodes(graph: Graph, node_type: str | None = None, n: int = 10) -> DataFrame:
    """Nodes of the highest degree with attributes and mean edge weight; ties in id order."""
    per_node = endpoints(graph.edges, "weight").groupBy("node_id").agg(
        F.count(F.lit(1)).alias("degree"), F.avg("weight").alias("avg_weight")
    )
    chosen = graph.nodes.filter(F.col("node_type") == node_type) if node_type else graph.nodes
    return (
        chosen.join(per_node, "node_id", "left")
        .na.fill(0, ["degree"])
        .na.fill(0.0, ["avg_weight"])
        .orderBy(F.desc("degree"), "node_id")
        .limit(n)
    )


def category_counts(graph: Graph) -> DataFrame:
    """Entity nodes per label."""
    return (
        graph.nodes.filter(F.col("node_type") == "entity")
        .groupBy("category")
        .agg(F.count(F.lit(1)).alias("n_nodes"))
    )


def normalize_weights(graph: Graph, low: float = 0.0, high: float = 1.0) -> Graph:
    """Weights scaled to [low, high]; all become ``high`` when they are equal."""
    span = graph.edges.agg(F.min("weight").alias("lo"), F.max("weight").alias("hi"))
    lo, hi = span.select("lo").scalar(), span.select("hi").scalar()
    scaled = F.when(hi == lo, F.lit(float(high))).otherwise(
        low + F.try_divide(F.col("weight") - lo, hi - lo) * (high - low)
    )
    return graph.with_edges(graph.edges.withColumn("weight", scaled), keep_isolated=True)


def bipartite_violations(graph: Graph, expected: tuple[str, str] | None = None) -> DataFrame:
    """Rows (problem, detail, n): nodes without a type, types beyond two or unexpected, edges inside a type."""
    untyped = graph.nodes.filter(F.col("node_type").isNull()).agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("missing node_type").alias("problem"), F.lit("").alias("detail"), "n"
    )
    types = graph.nodes.filter(F.col("node_type").isNotNull()).groupBy("node_type").agg(F.count(F.lit(1)).alias("n"))
    count = types.agg(F.count(F.lit(1)).alias("n")).select(
        F.when(F.col("n") != 2, F.lit("not two node types")).alias("problem"), F.lit("").alias("detail"), "n"
    ).filter(F.col("problem").isNotNull())
    kind = graph.nodes.select("node_id", "node_type")
    inside = (
        graph.edges.select("src", "dst")
        .join(kind.withColumnsRenamed({"node_id": "src", "node_type": "t1"}), "src")
        .join(kind.withColumnsRenamed({"node_id": "dst", "node_type": "t2"}), "dst")
        .filter(F.col("t1") == F.col("t2"))
        .groupBy(F.lit("edge inside a type").alias("problem"), F.col("t1").alias("detail"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    out = untyped.filter(F.col("n") > 0).unionByName(count).unionByName(inside)
    if expected:
        odd = types.filter(~F.col("node_type").isin(*expected)).select(
            F.lit("unexpected node type").alias("problem"), F.col("node_type").alias("detail"), "n"
        )
        out = out.unionByName(odd)
    return out


def is_bipartite_typed(graph: Graph, expected: tuple[str, str] | None = None) -> bool:
    """True without violations; a node without a type is an error."""
    problems = {row["problem"] for row in bipartite_violations(graph, expected).select("problem").distinct().collect()}
    if "missing node_type" in problems:
        raise ValueError("a node has no node_type")
    return not problems


def bipartite_sets(graph: Graph) -> DataFrame:
    """(node_type, node_id) of the two sides; an error unless there are exactly two types."""
    types = [r["node_type"] for r in graph.nodes.select("node_type").distinct().limit(3).collect()]
    if len(types) != 2:
        raise ValueError("a bipartite graph needs exactly two node types")
    return graph.nodes.select("node_type", "node_id")


def density(n: Column, m: Column, directed: bool = False) -> Column:
    """2m / (n(n-1)), directed m / (n(n-1)); 0 for at most one node."""
    return F.coalesce(F.try_divide(m * (1.0 if directed else 2.0), n * (n - 1)), F.lit(0.0))


def quick_statistics(graph: Graph) -> DataFrame:
    """One row: nodes, edges, density, average degree."""
    spark = graph.edges.sparkSession
    row = spark.range(1).select(
        graph.nodes.agg(F.count(F.lit(1)).alias("n")).scalar().alias("nodes"),
        graph.edges.agg(F.count(F.lit(1)).alias("n")).scalar().alias("edges"),
    )
    return row.withColumns(
        {
            "density": density(F.col("nodes"), F.col("edges"), graph.directed),
            "average_degree": F.coalesce(F.try_divide(F.col("edges") * 2.0, F.col("nodes")), F.lit(0.0)),
        }
    )


def type_counts(graph: Graph) -> DataFrame:
    return graph.nodes.groupBy(F.coalesce("node_type", F.lit("unknown")).alias("node_type")).agg(
        F.count(F.lit(1)).alias("n_nodes")
    )


def statistics(graph: Graph, component_sizes: DataFrame | None = None) -> DataFrame:
    """Long table (metric, value) of sizes, density, degrees, weights, types and components."""
    node_side = degrees(graph).agg(
        F.count(F.lit(1)).alias("nodes"), F.sum("degree").alias("ends"),
        F.min("degree").alias("min_degree"), F.max("degree").alias("max_degree"),
    )
    edge_side = graph.edges.agg(
        F.count(F.lit(1)).alias("edges"), F.avg("weight").alias("avg_weight"), F.min("weight").alias("min_weight"),
        F.max("weight").alias("max_weight"), F.sum("weight").alias("total_weight"),
    )
    edges = edge_side.select("edges").scalar()
    measured = node_side.withColumns(
        {
            "density": density(F.col("nodes"), edges, graph.directed),
            "avg_degree": F.coalesce(F.try_divide("ends", "nodes"), F.lit(0.0)),
        }
    )

    def long(df: DataFrame, names: list[str]) -> DataFrame:
        pairs = ", ".join(f"'{c}', double({c})" for c in names)
        return df.selectExpr(f"stack({len(names)}, {pairs}) AS (metric, value)")

    out = long(measured, ["nodes", "density", "avg_degree", "min_degree", "max_degree"]).unionByName(
        long(edge_side, ["edges", "avg_weight", "min_weight", "max_weight", "total_weight"])
    )
    out = out.unionByName(
        type_counts(graph).select(
            F.concat(F.lit("type:"), "node_type").alias("metric"), F.col("n_nodes").cast("double").alias("value")
        )
    )
    if component_sizes is not None:
        parts = component_sizes.agg(
            F.count(F.lit(1)).alias("components"), F.max("size").alias("largest"), F.sum("size").alias("all_nodes")
        ).withColumn("largest_share", F.coalesce(F.try_divide("largest", "all_nodes"), F.lit(0.0)))
        out = out.unionByName(long(parts, ["components", "largest", "largest_share"]))
    return out


def degree_centrality(graph: Graph) -> DataFrame:
    """degree / (n - 1), and 1 in a graph of one node."""
    n = graph.nodes.agg(F.count(F.lit(1)).alias("n")).scalar()
    return degrees(graph).select(
        "node_id", F.when(n == 1, 1.0).otherwise(F.try_divide(F.col("degree"), n - 1)).alias("centrality")
    )


def attach(graph: Graph, scores: DataFrame, name: str, score_col: str = "centrality") -> Graph:
    """Nodes with one more attribute; null where a node has no score."""
    column = scores.select("node_id", F.col(score_col).alias(name))
    return Graph(graph.nodes.join(column, "node_id", "left"), graph.edges, graph.directed)


def project(graph: Graph, node_type: str, chunk: int = 2000) -> DataFrame:
    """(a, b, weight): pairs of nodes of one type with the number of neighbours they share.

    The pairs are the result. A neighbour with many members is split into runs of about ``chunk`` members:
    each run meets every run of the same neighbour once, so the pairs of one hub come from many tasks, and
    they are counted before they are shuffled.
    """
    members = graph.nodes.filter(F.col("node_type") == node_type).select(F.col("node_id").alias("member"))
    links = both_ways(graph.edges).withColumnRenamed("node_id", "member").join(members, "member", "left_semi")
    sizes = links.groupBy("neighbor").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("runs"))
    salted = links.join(sizes, "neighbor").withColumn("run", F.pmod(F.hash("member"), F.col("runs")))
    left = salted.select("neighbor", F.col("run").alias("run_a"), F.col("member").alias("a"),
                         F.explode(F.sequence(F.lit(0), F.col("runs") - 1)).alias("run_b"))
    right = salted.select(
        "neighbor", F.explode(F.sequence(F.lit(0), F.col("runs") - 1)).alias("run_a"), F.col("run").alias("run_b"),
        F.col("member").alias("b"),
    )
    return (
        left.join(right, ["neighbor", "run_a", "run_b"])
        .filter(F.col("a") < F.col("b"))
        .groupBy("a", "b")
        .agg(F.count(F.lit(1)).alias("weight"))
    )


def clustering(graph: Graph) -> DataFrame:
    """(node_id, triangles, clustering) from bitmaps of neighbours, without a row for any wedge or triangle.

    Nodes are numbered by degree and edges point to the higher number, which bounds the out-degree of every node by sqrt(2m).
    Out-neighbours are bitmaps of 64-bit words (blocks of 4 KB would be nearly empty in a sparse graph). An edge u to v has as many triangles
    as the words of both have common bits; the third corners are counted by bit, per word, while the words are aggregated.
    """
    ends = degrees(graph)
    numbered = materialize(ends.orderBy("degree", "node_id").withColumn("id", F.monotonically_increasing_id()))
    edges = numbered_edges(graph.edges, numbered.select("node_id", "id"))
    edges = materialize(edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("v") % 64).cast("int"))
    words = materialize(edges.groupBy("u", F.shiftright("v", 6).alias("word")).agg(F.bit_or(bit).alias("bits")))
    # only ends that have out-neighbours themselves close a triangle
    far = words.select(F.col("u").alias("v"), "word", F.col("bits").alias("far_bits"))
    inner = edges.join(far.select("v").distinct(), "v", "left_semi")
    met = inner.join(words, "u").join(far, ["v", "word"]).select("u", "v", "word", F.col("bits").bitwiseAND(F.col("far_bits")).alias("common"))
    met = materialize(met.where("common <> 0"))
    sides = met.select(F.explode(F.array("u", "v")).alias("id"), F.bit_count("common").cast("long").alias("n"))
    # sixteen bits of a word at a time
    quarter = met.select("word", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("q"), "common").select(
        "word", "q", F.call_function("shiftright", "common", F.col("q") * 16).alias("common"))
    counts = quarter.groupBy("word", "q").agg(
        *[F.sum(F.call_function("shiftright", "common", F.lit(i)).bitwiseAND(1)).alias(f"b{i}") for i in range(16)])
    tops = counts.select("word", "q", F.posexplode(F.array(*[f"b{i}" for i in range(16)])).alias("i", "n")).where("n > 0").select(
        (F.col("word") * 64 + F.col("q") * 16 + F.col("i")).alias("id"), "n")
    triangles = sides.unionByName(tops).groupBy("id").agg(F.sum("n").alias("triangles"))
    return numbered.join(triangles, "id", "left").na.fill(0, ["triangles"]).select(
        "node_id", "triangles",
        F.coalesce(F.try_divide(F.col("triangles") * 2.0, F.col("degree") * (F.col("degree") - 1)), F.lit(0.0)).alias("clustering"))


def top_per_type(graph: Graph, n: int = 10) -> DataFrame:
    """The ``n`` nodes of the highest degree of every type."""
    ranked = graph.nodes.select("node_id", "node_type", "label").join(degrees(graph), "node_id")
    return top_n(ranked, ["node_type"], [F.desc("degree"), F.col("node_id")], n, "position")
