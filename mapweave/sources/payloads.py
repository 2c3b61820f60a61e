"""Search-engine payloads (JSON text) to result rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mapweave.functions.urls import netloc

CONTIGUOUS = "organic array<struct<link string, title string, snippet string>>"
POSITIONAL = (
    "organic_results array<struct<link string, url string, title string, snippet string, description string>>"
)
PAGED = "items array<struct<link string, title string, snippet string>>"


def _text(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def parse_contiguous(
    payloads: DataFrame, keys: Sequence[str], page: str, payload: str, max_results: Column | int
) -> DataFrame:
    """Items without URL or title are skipped; ranks count the kept items over all pages, up to ``max_results``.

    The rank inside a page is known in the row. The items of earlier pages are a running sum over the pages
    of a query, so items are never sorted.
    """
    limit = F.lit(max_results) if isinstance(max_results, int) else max_results
    parsed = F.from_json(F.col(payload), CONTIGUOUS)["organic"]
    kept = F.filter(parsed, lambda i: (_text(i["link"]) != "") & (_text(i["title"]) != ""))
    return _number_pages(payloads.withColumn("__items", kept).withColumn("__limit", limit), keys, page)


def parse_paged(payloads: DataFrame, keys: Sequence[str], page: str, payload: str) -> DataFrame:
    """Items of successive pages, none skipped; ranks count on over the pages."""
    parsed = F.from_json(F.col(payload), PAGED)["items"]
    every = payloads.withColumn("__items", parsed).withColumn("__limit", F.lit(None).cast("bigint"))
    return _number_pages(every, keys, page)


def _number_pages(pages: DataFrame, keys: Sequence[str], page: str) -> DataFrame:
    before = W.partitionBy(*keys).orderBy(page).rowsBetween(W.unboundedPreceding, -1)
    count = F.when(F.col("__items").isNull(), 0).otherwise(F.size("__items"))
    offset = F.coalesce(F.sum("__n").over(before), F.lit(0))
    sizes = pages.select(*keys, page, count.alias("__n")).withColumn("__offset", offset).drop("__n")
    rows = (
        pages.join(sizes, [*keys, page])
        .select(*keys, "__limit", "__offset", F.posexplode("__items").alias("__pos", "__item"))
        .withColumn("rank", (F.col("__offset") + F.col("__pos") + 1).cast("bigint"))
    )
    return rows.filter(F.col("__limit").isNull() | (F.col("rank") <= F.col("__limit"))).select(
        *keys, "rank", _text(F.col("__item.link")).alias("url"), _text(F.col("__item.title")).alias("title"),
        _text(F.col("__item.snippet")).alias("description"), netloc(_text(F.col("__item.link"))).alias("domain"),
    )


def parse_positional(payloads: DataFrame, keys: Sequence[str], payload: str) -> DataFrame:
    """Rank is the position in the array; items without URL leave a gap."""
    rows = payloads.select(
        *keys, F.posexplode(F.from_json(F.col(payload), POSITIONAL)["organic_results"]).alias("__pos", "i")
    )

    def first(a: str, b: str) -> Column:
        return _text(F.coalesce(F.nullif(F.col(a), F.lit("")), F.col(b)))

    return (
        rows.select(
            *keys, (F.col("__pos") + 1).cast("bigint").alias("rank"), first("i.link", "i.url").alias("url"),
            _text(F.col("i.title")).alias("title"), first("i.snippet", "i.description").alias("description"),
        )
        .filter(F.col("url") != "")
        .withColumn("domain", netloc("url"))
    )
