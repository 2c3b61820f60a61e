"""Comparing search sessions: sets of URLs and domains, rankings, spheres, discourse."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mapweave.functions.skew import top_n
from mapweave.functions.urls import sphere

REPORTS = ("full", "urls", "domains", "rankings", "spheres", "discourse")


def _check(session_ids: Sequence[int]) -> list[int]:
    ids = list(dict.fromkeys(session_ids))
    if len(ids) < 2:
        raise ValueError("at least two sessions are needed")
    return ids


def chosen(results: DataFrame, session_ids: Sequence[int]) -> DataFrame:
    return results.filter(F.col("session_id").isin(*session_ids))


def _placed(results: DataFrame, session_ids: Sequence[int]) -> DataFrame:
    """Results of the sessions with ``place``, the session's position in the list."""
    known = F.array(*[F.lit(s).cast("bigint") for s in session_ids])
    return chosen(results, session_ids).withColumn("place", (F.array_position(known, F.col("session_id")) - 1).cast("int"))


def signatures(results: DataFrame, session_ids: Sequence[int], item: str) -> DataFrame:
    """(places, n): distinct items per set of sessions they occur in.

    An item of any frequency is one row per task, and its list is at most as long as the list of sessions.
    """
    per_item = _placed(results, session_ids).groupBy(item).agg(F.sort_array(F.collect_set("place")).alias("places"))
    return per_item.groupBy("places").agg(F.count(F.lit(1)).alias("n"))


def set_overlap(results: DataFrame, session_ids: Sequence[int], item: str) -> DataFrame:
    """Long table (metric, label, value): sizes, exclusive parts, exclusive pairs, all, Jaccard per pair.

    Pairs are made from the counted signatures, not from items, so any number of sessions can be compared.
    """
    ids = _check(session_ids)
    spark = results.sparkSession
    cells = signatures(results, ids, item)
    zero = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("double")
    one = cells.select(F.explode("places").alias("place"), "n", (F.size("places") == 1).alias("alone")).groupBy("place").agg(
        F.sum("n").alias("size"), F.sum(F.when(F.col("alone"), F.col("n"))).alias("only"))
    names = spark.createDataFrame([(i, str(s)) for i, s in enumerate(ids)], "place int, label string")
    one = names.join(one, "place", "left").select("place", "label", zero("size").alias("size"), zero("only").alias("only"))
    in_pairs = F.flatten(F.transform("places", lambda x: F.transform(
        F.filter("places", lambda y: y > x), lambda y: F.struct(x.alias("i"), y.alias("j")))))
    two = cells.select(F.explode(in_pairs).alias("p"), "n", (F.size("places") == 2).alias("alone")).groupBy("p.i", "p.j").agg(
        F.sum("n").alias("both"), F.sum(F.when(F.col("alone"), F.col("n"))).alias("and"))
    pairs = spark.createDataFrame([(i, j, f"{a}_{b}") for (i, a), (j, b) in combinations(enumerate(ids), 2)], "i int, j int, label string")
    sizes = one.select("place", "size")
    pairs = (
        pairs.join(two, ["i", "j"], "left")
        .join(sizes.toDF("i", "size_i"), "i").join(sizes.toDF("j", "size_j"), "j")
        .select("label", zero("and").alias("and"), zero("both").alias("intersection"),
                (F.col("size_i") + F.col("size_j") - zero("both")).alias("union"))
        .withColumn("jaccard", F.round(F.coalesce(F.try_divide("intersection", "union"), F.lit(0.0)), 3))
    )

    def long(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
        cells_ = F.array(*[F.struct(F.lit(m).alias("metric"), "label", F.col(m).alias("value")) for m in metrics])
        return df.select(F.inline(cells_))

    whole = cells.agg(
        F.sum(F.when(F.size("places") == len(ids), F.col("n"))).alias("all"), F.sum("n").alias("total")
    ).select(F.lit("").alias("label"), zero("all").alias("all"), zero("total").alias("total"))
    return long(one, ["size", "only"]).unionByName(long(pairs, ["and", "jaccard", "intersection", "union"])).unionByName(
        long(whole, ["all", "total"] if len(ids) > 2 else ["total"]))


def unique_results(results: DataFrame, session_ids: Sequence[int], session_id: int) -> DataFrame:
    """URLs found by one session only, with the last result of each."""
    ids = _check(session_ids)
    last = F.max_by(F.struct("title", "domain", "rank"), F.col("result_id"))
    return (
        _placed(results, ids)
        .groupBy("url")
        .agg(F.min("place").alias("low"), F.max("place").alias("high"), last.alias("r"))
        .filter((F.col("low") == F.col("high")) & (F.col("low") == ids.index(session_id)))
        .select("url", "r.*")
    )


def common_ranks(results: DataFrame, session_ids: Sequence[int]) -> DataFrame:
    """(url, ranks): URLs that every session found, with the rank of the last result in each, in the order of the list."""
    ids = _check(session_ids)
    last = _placed(results, ids).groupBy("url", "place").agg(F.max_by("rank", "result_id").alias("rank"))
    return (
        last.groupBy("url")
        .agg(F.sort_array(F.collect_list(F.struct("place", "rank"))).alias("found"))
        .filter(F.size("found") == len(ids))
        .select("url", F.transform("found", lambda x: x["rank"]).alias("ranks"))
    )


def rank_differences(results: DataFrame, session_ids: Sequence[int], n: int = 20) -> DataFrame:
    """URLs of all sessions whose rank differs most: (url, ranks, difference)."""
    ids = _check(session_ids)
    return (
        common_ranks(results, ids)
        .select(
            "url",
            F.array_join(F.transform("ranks", lambda r: r.cast("string")), ",").alias("listed"),
            (F.array_max("ranks") - F.array_min("ranks")).alias("difference"),
        )
        .withColumnRenamed("listed", "ranks")
        .orderBy(F.desc("difference"), "url")
        .limit(n)
    )


def _incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by Lentz's continued fraction."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - _incomplete_beta(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1.0 - x)) / a
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 500):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            total *= c * d
        if abs(c * d - 1.0) < 1e-14:
            break
    return front * total


def correlation_p_value(rho: float, n: int) -> float:
    """Two-sided p-value of a rank correlation by Student's t with n - 2 degrees of freedom."""
    if n < 3 or rho is None or math.isnan(rho):
        return float("nan")
    if abs(rho) >= 1.0:
        return 0.0
    freedom = n - 2
    t2 = rho * rho * freedom / (1.0 - rho * rho)
    return _incomplete_beta(freedom / 2.0, 0.5, freedom / (freedom + t2))


def _p_values(rho: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([float("nan") if r is None else correlation_p_value(r, int(k)) for r, k in zip(rho, n)])


def rank_correlation(results: DataFrame, session_ids: Sequence[int]) -> DataFrame:
    """(session_a, session_b, n, rho, p_value) over the URLs of all sessions.

    Tied ranks are averaged. The average comes from a count per rank value, so a session is never sorted
    as one group.
    """
    ids = _check(session_ids)
    long = common_ranks(results, ids).select("url", F.posexplode("ranks").alias("place", "rank"))
    histogram = long.groupBy("place", "rank").agg(F.count(F.lit(1)).alias("ties"))
    lower = W.partitionBy("place").orderBy("rank").rowsBetween(W.unboundedPreceding, -1)
    average = histogram.select(
        "place", "rank", (F.coalesce(F.sum("ties").over(lower), F.lit(0)) + (F.col("ties") + 1) / 2).alias("avg_rank")
    )
    ranked = long.join(average, ["place", "rank"]).groupBy("url").agg(F.sort_array(F.collect_list(F.struct("place", "avg_rank"))).alias("found"))
    in_pairs = F.flatten(F.transform("found", lambda x: F.transform(
        F.filter("found", lambda y: y["place"] > x["place"]),
        lambda y: F.struct(x["place"].alias("i"), y["place"].alias("j"), x["avg_rank"].alias("x"), y["avg_rank"].alias("y")))))
    measured = ranked.select(F.inline(in_pairs)).groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"), F.corr("x", "y").alias("rho"))
    pairs = results.sparkSession.createDataFrame(
        [(i, j, a, b) for (i, a), (j, b) in combinations(enumerate(ids), 2)], "i int, j int, session_a bigint, session_b bigint")
    out = pairs.join(measured, ["i", "j"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    p_values = F.pandas_udf(_p_values, T.DoubleType())  # one row per pair of sessions
    return out.select(
        "session_a", "session_b", "n", F.round("rho", 3).alias("rho"), F.round(p_values("rho", "n"), 4).alias("p_value")
    )


def domain_profile(results: DataFrame, session_ids: Sequence[int]) -> DataFrame:
    """(session_id, n_domains, n_results, entropy): Shannon entropy (bits) of results over domains."""
    counts = chosen(results, session_ids).groupBy("session_id", "domain").agg(F.count(F.lit(1)).alias("c"))
    # -sum(c/n log2(c/n)) = log2(n) - sum(c log2 c) / n needs no second pass over the counts.
    sums = counts.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n_domains"), F.sum("c").alias("n_results"),
        F.sum(F.col("c") * F.log2("c")).alias("weighted"),
    )
    entropy = F.log2("n_results") - F.col("weighted") / F.col("n_results")
    return sums.select("session_id", "n_domains", "n_results", F.round(entropy, 3).alias("entropy"))


def domain_sets(results: DataFrame, session_ids: Sequence[int]) -> DataFrame:
    """(domain, n_results, sessions, kind): kind is common (all sessions), unique (one) or shared."""
    ids = _check(session_ids)
    n = F.size("places")
    return (
        _placed(results, ids)
        .groupBy("domain")
        .agg(F.collect_set("place").alias("places"), F.count(F.lit(1)).alias("n_results"))
        .select(
            "domain", "n_results", n.cast("bigint").alias("n_sessions"),
            F.when(n == len(ids), "common").when(n == 1, "unique").otherwise("shared").alias("kind"),
        )
    )


def rank_volatility(results: DataFrame, session_ids: Sequence[int], n: int = 10) -> DataFrame:
    """URLs with several appearances whose rank varies most."""
    return (
        chosen(results, session_ids)
        .groupBy("url")
        .agg(
            F.count(F.lit(1)).alias("appearances"), F.min("rank").alias("best"), F.max("rank").alias("worst"),
        )
        .filter(F.col("appearances") > 1)
        .withColumn("volatility", F.col("worst") - F.col("best"))
        .orderBy(F.desc("volatility"), "url")
        .limit(n)
    )


def session_spheres(results: DataFrame, session_ids: Sequence[int]) -> DataFrame:
    """Results per session and sphere. Every (session, URL) is classified once and weighted."""
    per_url = chosen(results, session_ids).groupBy("session_id", "url").agg(F.count(F.lit(1)).alias("n"))
    return (
        per_url.select("session_id", sphere("url")["sphere"].alias("sphere"), "n")
        .groupBy("session_id", "sphere")
        .agg(F.sum("n").alias("n_results"))
    )


def session_contents(results: DataFrame, content_urls: DataFrame, session_ids: Sequence[int]) -> DataFrame:
    """Distinct (session, content) pairs: contents fetched from the URLs a session found."""
    urls = chosen(results, session_ids).select("session_id", "url").distinct()
    return urls.join(content_urls, "url").select("session_id", "content_id").distinct()


def discourse(
    pairs: DataFrame, keywords: DataFrame, mentions: DataFrame, n_sessions: int, n: int = 20
) -> DataFrame:
    """Top keywords (by frequency) and entities (by rows) of each session, marked when every session lists them."""
    terms = (
        keywords.join(pairs, "content_id").groupBy("session_id", F.col("lemma").alias("term"))
        .agg(F.sum("frequency").alias("weight")).withColumn("kind", F.lit("keyword"))
    )
    names = (
        mentions.join(pairs, "content_id").groupBy("session_id", F.col("text").alias("term"))
        .agg(F.count(F.lit(1)).alias("weight")).withColumn("kind", F.lit("entity"))
    )
    best = top_n(
        terms.unionByName(names), ["kind", "session_id"], [F.desc("weight"), F.col("term")], n, "position"
    )
    listed = F.count(F.lit(1)).over(W.partitionBy("kind", "term"))  # at most one row per session
    return best.withColumn("is_shared", listed == n_sessions)


def compare(
    results: DataFrame,
    session_ids: Sequence[int],
    kind: str = "full",
    content_urls: DataFrame | None = None,
    keywords: DataFrame | None = None,
    mentions: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """The report as named tables. An error on fewer than two sessions or a session without results."""
    if kind not in REPORTS:
        raise ValueError(f"unknown comparison {kind!r}; use one of {', '.join(REPORTS)}")
    ids = _check(session_ids)
    present = {r[0] for r in chosen(results, ids).select("session_id").distinct().collect()}
    missing = [s for s in ids if s not in present]
    if missing:
        raise ValueError(f"sessions without results: {missing}")
    report = {}
    if kind in ("full", "urls"):
        report["urls"] = set_overlap(results, ids, "url")
    if kind in ("full", "domains"):
        report["domains"] = set_overlap(results, ids, "domain")
        report["domain_sets"] = domain_sets(results, ids)
        report["domain_profile"] = domain_profile(results, ids)
    if kind in ("full", "rankings"):
        report["rankings"] = rank_volatility(results, ids)
    if kind in ("full", "spheres"):
        report["spheres"] = session_spheres(results, ids)
    if kind == "discourse" and content_urls is None:
        raise ValueError("the discourse report needs content_urls")
    if kind in ("full", "discourse") and content_urls is not None:
        pairs = session_contents(results, content_urls, ids)
        report["discourse"] = discourse(pairs, keywords, mentions, len(ids))
    return report


def long_report(report: dict[str, DataFrame]) -> DataFrame:
    """All sections of a report as (section, metric, label, value)."""

    def unpivoted(df: DataFrame, label: Column, names: Sequence[str]) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])
        return df.select(label.alias("label"), F.explode(pairs).alias("p")).select("p.metric", "label", "p.value")

    session = F.col("session_id").cast("string")
    shape = {
        "urls": lambda df: df, "domains": lambda df: df,
        "domain_sets": lambda df: df.select(F.col("kind").alias("metric"), F.col("domain").alias("label"), F.col("n_results").alias("value")),
        "domain_profile": lambda df: unpivoted(df, session, ("n_domains", "n_results", "entropy")),
        "rankings": lambda df: unpivoted(df, F.col("url"), ("appearances", "best", "worst", "volatility")),
        "spheres": lambda df: df.select(F.col("sphere").alias("metric"), session.alias("label"), F.col("n_results").alias("value")),
        "discourse": lambda df: df.select(
            F.concat("kind", F.when(F.col("is_shared"), F.lit(" shared")).otherwise(F.lit(""))).alias("metric"),
            F.concat_ws(" ", session, F.col("position").cast("string"), "term").alias("label"), F.col("weight").alias("value")),
    }
    parts = [shape[name](df).select(F.lit(name).alias("section"), "metric", "label", F.col("value").cast("double").alias("value"))
             for name, df in report.items()]
    return reduce(DataFrame.unionByName, parts)
