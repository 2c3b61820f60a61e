"""Results over time: overlap of periods, new and vanished items, domain trends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mapweave.functions.skew import top_n


def index_periods(results: DataFrame, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """Adds ``period``, 0-based in order of (date_from, date_to). Only the few distinct periods are ranked."""
    periods = results.select(*keys, "date_from", "date_to").distinct()
    order = W.partitionBy(*keys).orderBy("date_from", "date_to")
    numbered = periods.withColumn("period", (F.dense_rank().over(order) - 1).cast("bigint"))
    return results.join(numbered, [*keys, "date_from", "date_to"])


def assign_periods(results: DataFrame, time_col: str, periods: Sequence[tuple[str, str]]) -> DataFrame:
    """One row per result and period [start, end) that contains it; periods may overlap.

    The periods are literals tested within the row, so no join is needed.
    """
    table = F.array(
        *[
            F.struct(
                F.lit(i).cast("bigint").alias("period"),
                F.expr(f"TIMESTAMP_NTZ '{a}'").alias("start"),
                F.expr(f"TIMESTAMP_NTZ '{b}'").alias("end"),
            )
            for i, (a, b) in enumerate(periods)
        ]
    )
    inside = F.filter(table, lambda p: (F.col(time_col) >= p["start"]) & (F.col(time_col) < p["end"]))
    return results.select("*", F.explode(inside).alias("__p")).select(*results.columns, F.col("__p.period").alias("period"))


def consecutive_overlap(results: DataFrame, item: str, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """Items of a period that occur in the next one: count and percent of the earlier period."""
    items = results.select(*keys, "period", item).distinct()
    following = items.withColumn("period", F.col("period") - 1).withColumn("again", F.lit(1))
    joined = items.join(following, [*keys, "period", item], "left")
    last = joined.groupBy(*keys, "period").agg(
        F.count(F.lit(1)).alias("n_items"), F.count("again").alias("overlap")
    )
    final = W.partitionBy(*keys)
    return (
        last.withColumn("last", F.max("period").over(final))
        .filter(F.col("period") < F.col("last"))
        .select(
            *keys, "period", "n_items", "overlap",
            F.round(F.coalesce(F.try_divide(F.col("overlap") * 100.0, F.col("n_items")), F.lit(0.0)), 2).alias("percent"),
        )
    )


def new_and_vanished(results: DataFrame, item: str, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """(keys, item, change): items of the last period only (new) or of the first only (vanished).

    Empty for a single period. Presence in the two periods is a pair of flags per item, so no self join is needed.
    """
    bounds = results.groupBy(*keys).agg(F.min("period").alias("first"), F.max("period").alias("last"))
    flags = (
        results.select(*keys, "period", item)
        .join(bounds, list(keys))
        .groupBy(*keys, item)
        .agg(
            F.bool_or(F.col("period") == F.col("first")).alias("in_first"),
            F.bool_or(F.col("period") == F.col("last")).alias("in_last"),
        )
    )
    return flags.filter(F.col("in_first") != F.col("in_last")).select(
        *keys, item, F.when(F.col("in_last"), "new").otherwise("vanished").alias("change")
    )


def period_domains(results: DataFrame, n: int = 10, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """Top ``n`` domains of every period with the period's totals."""
    counts = results.groupBy(*keys, "period", "domain").agg(F.count(F.lit(1)).alias("count"))
    totals = counts.groupBy(*keys, "period").agg(
        F.sum("count").alias("n_results"), F.count(F.lit(1)).alias("n_domains")
    )
    best = top_n(counts, [*keys, "period"], [F.desc("count"), F.col("domain")], n, "position")
    return best.join(totals, [*keys, "period"])


def domain_trends(top_domains: DataFrame, n: int = 10, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """Emerging, declining and stable domains from the top lists of the periods.

    emerging: first listed after the first period; else declining: last listed before the last period; else
    stable: listed in at least 70 % of the periods. The best ``n`` of each kind, by greatest (stable: average)
    count. Keys with fewer than two periods give no rows.
    """
    n_periods = top_domains.groupBy(*keys).agg((F.max("period") + 1).alias("n_periods"))
    seen = top_domains.groupBy(*keys, "domain").agg(
        F.min("period").alias("first"), F.max("period").alias("last"), F.count(F.lit(1)).alias("appearances"),
        F.max("count").alias("max_count"), F.avg("count").alias("avg_count"),
    )
    trend = (
        F.when(F.col("first") > 0, "emerging")
        .when(F.col("last") < F.col("n_periods") - 1, "declining")
        .when(F.col("appearances") >= F.col("n_periods") * 0.7, "stable")
    )
    marked = (
        seen.join(n_periods, list(keys))
        .filter(F.col("n_periods") >= 2)
        .withColumn("trend", trend)
        .filter(F.col("trend").isNotNull())
        .withColumn("score", F.when(F.col("trend") == "stable", F.col("avg_count")).otherwise(F.col("max_count") * 1.0))
    )
    return top_n(marked, [*keys, "trend"], [F.desc("score"), F.col("domain")], n, "position")
