"""How much queries overlap in the sites they return."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mapweave.functions.skew import top_n


def _jaccard(shared, size_a, size_b):
    return F.coalesce(F.try_divide(shared * 1.0, size_a + size_b - shared), F.lit(0.0))


class QueryOverlap:
    """Pairwise overlap of queries without comparing every pair.

    Sites returned by more than ``hub_degree`` queries (hubs) would open groups whose pairs grow with the
    square of the data. Queries are therefore grouped into classes of the same size and the same set of
    hubs. All pairs of two classes share the same hubs, so their contribution is arithmetic. Only pairs that
    also share an ordinary site are listed, and corrected by the difference. Results are exact.
    """

    def __init__(self, queries: DataFrame, edges: DataFrame, hub_degree: int = 1000, top: int = 20):
        self.queries, self.top = queries, top
        links = edges.select("query_id", "site").distinct()
        reach = links.groupBy("site").agg(F.count(F.lit(1)).alias("reach"))
        marked = links.join(reach, "site").withColumn("hub", F.col("reach") > hub_degree)
        self.profile = marked.groupBy("query_id").agg(
            F.count(F.lit(1)).alias("size"),
            F.array_sort(F.collect_set(F.when(F.col("hub"), F.col("site")))).alias("hubs"),
        )
        self.ordinary = marked.filter(~F.col("hub")).select("query_id", "site")
        ids = top_n(
            self.profile.withColumn("class", F.struct("size", "hubs")), ["class"], [F.col("query_id")], top + 1
        )
        self.class_ids = ids.select("class", "query_id")
        self.classes = self.profile.filter(F.size("hubs") > 0).groupBy(F.struct("size", "hubs").alias("class")).agg(
            F.count(F.lit(1)).alias("n")
        )

    def class_pairs(self) -> DataFrame:
        """Pairs of classes with a common hub: (c1, c2, shared, pairs)."""
        spread = self.classes.select("class", "n", F.explode("class.hubs").alias("hub"))
        left = spread.withColumnsRenamed({"class": "c1", "n": "n1"})
        right = spread.withColumnsRenamed({"class": "c2", "n": "n2"})
        met = left.join(right, "hub").filter(F.col("c1") <= F.col("c2")).groupBy("c1", "c2", "n1", "n2").agg(
            F.count(F.lit(1)).alias("shared")
        )
        same = F.col("c1") == F.col("c2")
        pairs = F.when(same, F.col("n1") * (F.col("n1") - 1) / 2).otherwise(F.col("n1") * F.col("n2"))
        return met.select("c1", "c2", "shared", pairs.alias("pairs")).filter(F.col("pairs") > 0)

    def listed_pairs(self) -> DataFrame:
        """Pairs with a common ordinary site: (q1, q2, shared, size1, size2, by_hubs)."""
        left = self.ordinary.select("site", F.col("query_id").alias("q1"))
        right = self.ordinary.select("site", F.col("query_id").alias("q2"))
        met = left.join(right, "site").filter(F.col("q1") < F.col("q2")).groupBy("q1", "q2").agg(
            F.count(F.lit(1)).alias("n")
        )
        one = self.profile.select(F.col("query_id").alias("q1"), F.col("size").alias("size1"), F.col("hubs").alias("h1"))
        two = self.profile.select(F.col("query_id").alias("q2"), F.col("size").alias("size2"), F.col("hubs").alias("h2"))
        by_hubs = F.size(F.array_intersect("h1", "h2")).cast("bigint")
        return met.join(one, "q1").join(two, "q2").select(
            "q1", "q2", (F.col("n") + by_hubs).alias("shared"), "size1", "size2", by_hubs.alias("by_hubs")
        )

    def summary(self) -> DataFrame:
        """One row: compared pairs (with a result at either side) and their average Jaccard similarity."""
        spark = self.queries.sparkSession
        by_class = self.class_pairs().agg(
            F.coalesce(F.sum(F.col("pairs") * _jaccard(F.col("shared"), F.col("c1.size"), F.col("c2.size"))), F.lit(0.0))
            .alias("s")
        )
        correction = self.listed_pairs().agg(
            F.coalesce(
                F.sum(
                    _jaccard(F.col("shared"), F.col("size1"), F.col("size2"))
                    - _jaccard(F.col("by_hubs"), F.col("size1"), F.col("size2"))
                ),
                F.lit(0.0),
            ).alias("s")
        )
        n = self.queries.agg(F.count(F.lit(1)).alias("n"))
        with_results = self.profile.join(self.queries.select("query_id"), "query_id", "left_semi").agg(
            F.count(F.lit(1)).alias("n")
        )
        row = spark.range(1).select(
            n.scalar().alias("n"), (n.scalar() - with_results.scalar()).alias("z"),
            (by_class.scalar() + correction.scalar()).alias("total"),
        )
        compared = (F.col("n") * (F.col("n") - 1) - F.col("z") * (F.col("z") - 1)) / 2
        return row.select(
            compared.cast("bigint").alias("total_comparisons"),
            F.coalesce(F.try_divide(F.col("total"), compared), F.lit(0.0)).alias("avg_jaccard"),
        )

    def top_pairs(self) -> DataFrame:
        """The ``top`` pairs by shared sites, ties by query ids: (q1, q2, shared, jaccard).

        Pairs that share hubs only come from their classes. Among them only the highest numbers of shared hubs
        that together hold ``top`` pairs can win, and of two classes only the ``top`` + 1 smallest ids.
        """
        by_class = self.class_pairs()
        levels = by_class.groupBy("shared").agg(F.sum("pairs").alias("pairs"))
        downwards = W.orderBy(F.desc("shared"))  # one row per number of shared hubs
        floors = (
            levels.withColumn("reach", F.sum("pairs").over(downwards))
            .filter(F.col("reach") >= self.top)
            .agg(F.coalesce(F.max("shared"), F.lit(1)).alias("floor"))
        )
        good = by_class.filter(F.col("shared") >= floors.scalar())
        one = self.class_ids.select(F.col("class").alias("c1"), F.col("query_id").alias("a"))
        two = self.class_ids.select(F.col("class").alias("c2"), F.col("query_id").alias("b"))
        from_classes = (
            good.join(one, "c1").join(two, "c2").filter((F.col("c1") != F.col("c2")) | (F.col("a") < F.col("b")))
            .select(
                F.least("a", "b").alias("q1"), F.greatest("a", "b").alias("q2"), "shared",
                F.when(F.col("a") < F.col("b"), F.col("c1.size")).otherwise(F.col("c2.size")).alias("size1"),
                F.when(F.col("a") < F.col("b"), F.col("c2.size")).otherwise(F.col("c1.size")).alias("size2"),
            )
        )
        listed = self.listed_pairs().select("q1", "q2", "shared", "size1", "size2")
        best = from_classes.unionByName(listed).groupBy("q1", "q2", "size1", "size2").agg(F.max("shared").alias("shared"))
        return best.orderBy(F.desc("shared"), "q1", "q2").limit(self.top).select(
            "q1", "q2", "shared", _jaccard(F.col("shared"), F.col("size1"), F.col("size2")).alias("jaccard")
        )
